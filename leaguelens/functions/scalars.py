"""Column functions of the league: derived scores and outcomes, texts for people, and the kernels of the rating maths."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 173.7178
SEAT_IMPUTED = 3.0


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def walkover_default_score(max_score) -> Column:
    """SCL-3: more than half of the maximum, the same for whole and fractional halves."""
    return (F.floor(col(max_score) / 2) + 1).cast("double")


def side_kind(name, score, other_name) -> Column:
    """SCL-2: STANDARD, WALKOVER or TIMEOUT, of the affected side only."""
    return F.when(F.upper(col(name)) == "WALKOVER", "WALKOVER").when((F.upper(col(score)) == "TIMEOUT") & (F.upper(col(other_name)) != "WALKOVER"), "TIMEOUT").otherwise("STANDARD")


def side_result(name, score, other_name, other_score, default_score) -> Column:
    """SCL-1: struct (score, outcome) of one side of a round file's row."""
    kind, other = side_kind(name, score, other_name), side_kind(other_name, other_score, name)
    mine, theirs = col(score).try_cast("double"), col(other_score).try_cast("double")
    points = F.when(kind == "WALKOVER", 0.0).when(other == "WALKOVER", col(default_score)).when(kind == "TIMEOUT", 0.0).otherwise(F.coalesce(mine, F.lit(0.0)))
    outcome = F.when(kind != "STANDARD", 0.0).when(other != "STANDARD", 1.0).when(mine > theirs, 1.0).when(mine == theirs, 0.5).otherwise(0.0)
    return F.struct(points.cast("double").alias("score"), outcome.cast("double").alias("outcome"))


def legacy_sign(outcome) -> Column:
    """SCL-4: 1 / 0.5 / 0 as 1 / 0 / -1."""
    return F.when(col(outcome) == 1.0, 1).when(col(outcome) == 0.5, 0).when(col(outcome) == 0.0, -1)


def sign_points(sign) -> Column:
    """SCL-4, back: 1 / 0 / -1 as 1 / 0.5 / 0."""
    return F.when(col(sign) == 1, 1.0).when(col(sign) == 0, 0.5).when(col(sign) == -1, 0.0)


def outcome_letter(outcome) -> Column:
    """SCL-5: W, D or L; a question mark if unknown."""
    return F.when(col(outcome) == 1.0, "W").when(col(outcome) == 0.5, "D").when(col(outcome) == 0.0, "L").otherwise("?")


def score_text(score) -> Column:
    """SCL-6: whole numbers without decimals, others with two."""
    s = col(score)
    return F.when(s == F.floor(s), s.cast("long").cast("string")).otherwise(F.format_string("%.2f", s))


def score_pair_text(mine, mine_kind, theirs, their_kind) -> Column:
    """SCL-6: own and opponent's score; TIMEOUT where one ran out of time, ? and 0 where one is missing."""
    own = F.when(col(mine_kind) == "TIMEOUT", "TIMEOUT").otherwise(F.coalesce(score_text(mine), F.lit("?")))
    other = F.when(col(their_kind) == "TIMEOUT", "TIMEOUT").otherwise(F.coalesce(score_text(theirs), F.lit("0")))
    return F.concat(own, F.lit("-"), other)


def delta_text(change, decimals: int = 0) -> Column:
    """SCL-7: +n, -n or =."""
    body = F.format_string(f"%.{decimals}f", F.abs(col(change)).cast("double"))
    return F.when(col(change) > 0, F.concat(F.lit("+"), body)).when(col(change) < 0, F.concat(F.lit("-"), body)).when(col(change) == 0, "=")


def hall_text(name) -> Column:
    """SCL-8: Hall n for a number, x Hall for a name, ? for null."""
    n = col(name)
    return F.when(n.isNull(), "?").when(n.try_cast("int").isNotNull(), F.concat(F.lit("Hall "), n)).otherwise(F.concat(n, F.lit(" Hall")))


def round_code(label) -> Column:
    """SCL-9: Round 12 as R12."""
    return F.regexp_replace(col(label), r"(?i)^round\s*", "R")


def short_name(name, length: int) -> Column:
    """SCL-9: the words before the last one shortened to initials, where the name is too long; then cut."""
    words = F.split(col(name), " ")
    initials = F.concat_ws(" ", F.transform(F.slice(words, F.lit(1), F.size(words) - 1), lambda w: F.concat(F.substring(w, 1, 1), F.lit("."))), F.element_at(words, -1))
    return F.when(F.length(col(name)) <= length, col(name)).otherwise(F.substring(initials, 1, length))


def display_elo(rating) -> Column:
    """SCL-10: the rating rounded half up."""
    return F.floor(col(rating) + 0.5).cast("long")


def g(rd) -> Column:
    """SCL-11: weight of an opponent by the rating deviation."""
    phi = col(rd) / SCALE
    return 1 / F.sqrt(1 + 3 * phi * phi / (math.pi * math.pi))


def combined_g(rd_a, rd_b) -> Column:
    """SCL-11: the same for both deviations together."""
    return g(F.sqrt(col(rd_a) * col(rd_a) + col(rd_b) * col(rd_b)))


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def logit(p) -> Column:
    return F.log(col(p) / (1 - col(p)))


def expected_score(rating, opponent, rd) -> Column:
    """SCL-11: expected points against an opponent of the given rating and deviation."""
    return sigmoid(g(rd) * (col(rating) - col(opponent)) / SCALE)


def seat_or_default(seat) -> Column:
    """SCL-12."""
    return F.coalesce(col(seat).cast("double"), F.lit(SEAT_IMPUTED))


def round_text(label, round_order) -> Column:
    """SCL-13: the stored label, else Round n."""
    return F.coalesce(col(label), F.concat(F.lit("Round "), col(round_order).cast("string")))


def name_key(name) -> Column:
    """SCL-14: lower case, no commas, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(name)), ",", ""), r"\s+", " "))
