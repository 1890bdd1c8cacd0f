"""Checks of round files and of stored data: accepted rows, and rejected ones with the rule they break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaguelens.sources.round_files import ROUND_HEADER


def headers(spark, paths, expected: tuple[str, ...] = ROUND_HEADER) -> DataFrame:
    """VAL-1: file, ok: whether a file's first line is the header, in any case; a byte order mark is accepted."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_n"), "value")
    first = lines.groupBy("file").agg(F.min_by("value", "_n").alias("line"))
    return first.select("file", (F.lower(F.regexp_replace(F.regexp_replace("line", "^﻿", ""), r"\s", "")) == ",".join(expected)).alias("ok"))


def _number(text) -> Column:
    return F.col(text).try_cast("double")


def _sound(text) -> Column:
    n = _number(text)
    return n.isNotNull() & ~F.isnan(n) & (n >= 0) & (n < float("inf"))


def row_rule(corrupt: str | None = None) -> Column:
    """VAL-2 to VAL-5: the first rule that a row of a round file breaks; null if it breaks none."""
    up = lambda c: F.upper(F.trim(c))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    w1, w2, t1, t2 = up("name1") == "WALKOVER", up("name2") == "WALKOVER", up("score1") == "TIMEOUT", up("score2") == "TIMEOUT"
    shape = blank("name1") | blank("name2")
    if corrupt:
        shape = shape | F.col(corrupt).isNotNull()
    walkover = (w1 & w2) | (w1 & blank("hall2")) | (w2 & blank("hall1")) | t1 | t2
    timeout = blank("hall1") | blank("hall2") | (t1 & t2) | (t1 & ~blank("score2") & ~_sound("score2")) | (t2 & ~blank("score1") & ~_sound("score1"))
    standard = blank("hall1") | blank("hall2") | ~_sound("score1") | ~_sound("score2")
    return F.when(shape, "VAL-2").when(w1 | w2, F.when(walkover, "VAL-3")).when(t1 | t2, F.when(timeout, "VAL-4")).when(standard, "VAL-5")


def split_rows(rows: DataFrame, corrupt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected ones with their rule."""
    marked = rows.withColumn("rule", row_rule(corrupt))
    return marked.where("rule is null").drop("rule"), marked.where("rule is not null")


def empty_files(files: DataFrame, rows: DataFrame) -> DataFrame:
    """VAL-6: files (file) without any data row."""
    return files.join(rows.select("file").distinct(), "file", "left_anti")


def round_order(arrived: DataFrame) -> DataFrame:
    """VAL-7: arrived (year, round_order) with ok: rounds from 1 on without a gap; all after a gap are rejected."""
    w = Window.partitionBy("year").orderBy("round_order")
    d = arrived.select("year", "round_order").distinct()
    return d.withColumn("ok", (F.col("round_order") >= 1) & (F.row_number().over(w) == F.col("round_order")))


def unknown_halls(sides: DataFrame, halls: DataFrame) -> DataFrame:
    """VAL-8: rows of sides (hall) whose hall no row of halls (hall_name) has, in any case; halls are few."""
    known = halls.select(F.lower("hall_name").alias("_h")).distinct()
    return sides.join(known, F.lower("hall") == F.col("_h"), "left_anti")


def twice_in_round(sides: DataFrame) -> DataFrame:
    """VAL-9: players with more than one place in a round; the sentinel may have many."""
    n = sides.where("player_id <> 'WLKOVR'").groupBy("year", "round_order", "player_id").agg(F.count("*").alias("places"))
    return n.where("places > 1")


def walkover_without_type(sides: DataFrame, typed: DataFrame) -> DataFrame:
    """VAL-10: rounds with a walkover but without a match type; typed: (year, round_order) of rounds that have one."""
    void = sides.where("player_id = 'WLKOVR'").select("year", "round_order").distinct()
    return void.join(typed, ["year", "round_order"], "left_anti")


def score_warnings(sides: DataFrame, max_score: float) -> DataFrame:
    """VAL-11: sides with a score above the maximum."""
    return sides.where(F.col("score") > max_score)


def fielded_warnings(sides: DataFrame, most: int = 5) -> DataFrame:
    """VAL-12: halls that field more than `most` players in a round."""
    n = sides.where("player_id <> 'WLKOVR'").groupBy("year", "round_order", "hall_id").agg(F.count("*").alias("fielded"))
    return n.where(F.col("fielded") > most)


def hall_conflicts(sides: DataFrame, status: DataFrame) -> DataFrame:
    """VAL-13: players that play for another hall than that of their season."""
    s = status.select("player_id", "year", F.col("hall_id").alias("own_hall"))
    return sides.where("player_id <> 'WLKOVR'").join(s, ["player_id", "year"]).where("hall_id <> own_hall")


def bad_outcomes(sides: DataFrame, strict: bool = False) -> DataFrame:
    """VAL-14: rows whose outcome isn't 0, 0.5 or 1; in strict mode the job fails at the first."""
    bad = sides.where(F.col("outcome").isNull() | ~F.col("outcome").isin(0.0, 0.5, 1.0))
    return bad.withColumn("outcome", F.raise_error(F.lit("outcome is none of 0, 0.5, 1")).cast("double")) if strict else bad


def _disagreeing(p: DataFrame) -> DataFrame:
    """Timeouts with a point or a score, and standard boards won with the lower score, or drawn with unequal ones."""
    late = p.where("participation_type = 'TIMEOUT' and (score <> 0 or outcome <> 0)").select("match_id")
    two = p.where("participation_type = 'STANDARD'").groupBy("match_id").agg(F.count("*").alias("n"), F.max("score").alias("high"), F.min("score").alias("low"), F.max_by("outcome", "score").alias("won"), F.max("outcome").alias("most"))
    odd = two.where("n = 2 and ((high = low and most <> 0.5) or (high > low and won <> 1))").select("match_id")
    return late.unionByName(odd)


def violations(participants: DataFrame, rounds: DataFrame, status: DataFrame, ratings: DataFrame) -> DataFrame:
    """VAL-15: rule, n of every broken invariant of the stored tables; no rows if all hold."""
    p = participants
    by_match = p.groupBy("match_id").agg(F.count("*").alias("n"), F.sum("outcome").alias("s"))
    checks = {
        "two participants": by_match.where("n <> 2"),
        "outcomes sum to one": by_match.where("s <> 1"),
        "score and outcome agree": _disagreeing(p),
        "player once in a round": twice_in_round(p),
        "five per hall": fielded_warnings(p),
        "outcome domain": bad_outcomes(p),
        "known round": p.join(rounds.select("round_id"), "round_id", "left_anti"),
        "status hall": hall_conflicts(p, status),
        "finite ratings": ratings.where("rating_value is null or isnan(rating_value) or rating_deviation <= 0"),
        "rated has status": ratings.join(status, ["player_id", "year"], "left_anti"),
    }
    out = None
    for rule, rows in checks.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = one if out is None else out.unionByName(one)
    return out.where("n > 0")
