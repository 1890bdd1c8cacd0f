"""Scalar functions, filters, sorts and set operations over the league."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from leaguelens.functions import scalars as S
from leaguelens.operators import setops
from leaguelens.plans.base import query
from leaguelens.sources.league_view import BASE_RD, SENTINEL
from leaguelens.sources.round_files import raw_rows

RAW = """, raw AS (SELECT year, round_order, pair * 10 + board_seat AS row_no,
 CASE WHEN player_id0 = 'WLKOVR' THEN 'WALKOVER' ELSE 'Player ' || player_id0 END AS name1, CASE WHEN hall_id0 = -1 THEN '' ELSE CAST(hall_id0 AS VARCHAR) END AS hall1,
 CASE WHEN NOT rated THEN '' WHEN kind0 = 'TIMEOUT' THEN 'TIMEOUT' ELSE CAST(CAST(score0 AS BIGINT) AS VARCHAR) END AS score1,
 CASE WHEN player_id1 = 'WLKOVR' THEN 'WALKOVER' ELSE 'Player ' || player_id1 END AS name2, CASE WHEN hall_id1 = -1 THEN '' ELSE CAST(hall_id1 AS VARCHAR) END AS hall2,
 CASE WHEN NOT rated THEN '' WHEN kind1 = 'TIMEOUT' THEN 'TIMEOUT' ELSE CAST(CAST(score1 AS BIGINT) AS VARCHAR) END AS score2, match_id FROM boards)
"""


@query("scl_1", "SELECT match_id, score0 AS score_a, outcome0 AS outcome_a, score1 AS score_b, outcome1 AS outcome_b FROM boards")
def scl_1(lg):
    """Scores and outcomes derived again from the raw rows of the round files."""
    default = S.walkover_default_score(F.lit(370.0))
    a, b = S.side_result("name1", "score1", "name2", "score2", default), S.side_result("name2", "score2", "name1", "score1", default)
    out = raw_rows(lg).select("match_id", a.alias("a"), b.alias("b"))
    return out.select("match_id", F.col("a.score").alias("score_a"), F.col("a.outcome").alias("outcome_a"), F.col("b.score").alias("score_b"), F.col("b.outcome").alias("outcome_b"))


@query("scl_2", "SELECT match_id, kind0 AS kind_a, kind1 AS kind_b FROM boards")
def scl_2(lg):
    return raw_rows(lg).select("match_id", S.side_kind("name1", "score1", "name2").alias("kind_a"), S.side_kind("name2", "score2", "name1").alias("kind_b"))


@query("scl_3", "SELECT DISTINCT score + 0.5 AS max_score, floor((score + 0.5) / 2) + 1 AS default_score FROM sides WHERE rated UNION SELECT DISTINCT score, floor(score / 2) + 1 FROM sides WHERE rated")
def scl_3(lg):
    scores = lg.played.select("score").distinct()
    every = scores.select((F.col("score") + 0.5).alias("max_score")).unionByName(scores.select(F.col("score").alias("max_score")))
    return every.distinct().withColumn("default_score", S.walkover_default_score("max_score"))


@query("scl_4", "SELECT match_id, side, CAST(CASE outcome WHEN 1 THEN 1 WHEN 0.5 THEN 0 ELSE -1 END AS INTEGER) AS sign, outcome AS points FROM sides")
def scl_4(lg):
    s = lg.sides.select("match_id", "side", S.legacy_sign("outcome").alias("sign"))
    return s.withColumn("points", S.sign_points("sign"))


@query("scl_5", "SELECT match_id, side, CASE outcome WHEN 1 THEN 'W' WHEN 0.5 THEN 'D' ELSE 'L' END AS letter, 1 - outcome AS opp_outcome FROM sides")
def scl_5(lg):
    return lg.sides.select("match_id", "side", S.outcome_letter("outcome").alias("letter"), (1 - F.col("outcome")).alias("opp_outcome"))


@query(
    "scl_6",
    """SELECT match_id, side, CASE WHEN participation_type = 'TIMEOUT' THEN 'TIMEOUT' ELSE CAST(CAST(score AS BIGINT) AS VARCHAR) END || '-' || CASE WHEN opp_participation_type = 'TIMEOUT' THEN 'TIMEOUT' ELSE CAST(CAST(opp_score AS BIGINT) AS VARCHAR) END AS pair_text,
    CASE WHEN score / 4 = floor(score / 4) THEN CAST(CAST(score / 4 AS BIGINT) AS VARCHAR) ELSE printf('%.2f', score / 4) END AS quarter_text FROM sides""",
)
def scl_6(lg):
    return lg.sides.select("match_id", "side", S.score_pair_text("score", "participation_type", "opp_score", "opp_participation_type").alias("pair_text"), S.score_text(F.col("score") / 4).alias("quarter_text"))


@query(
    "scl_7",
    "SELECT match_id, side, CASE WHEN score > opp_score THEN '+' || CAST(CAST(score - opp_score AS BIGINT) AS VARCHAR) WHEN score < opp_score THEN '-' || CAST(CAST(opp_score - score AS BIGINT) AS VARCHAR) ELSE '=' END AS delta, CASE WHEN outcome > 0.5 THEN '+0.5' WHEN outcome < 0.5 THEN '-0.5' ELSE '=' END AS tenth FROM sides",
)
def scl_7(lg):
    return lg.sides.select("match_id", "side", S.delta_text(F.col("score") - F.col("opp_score")).alias("delta"), S.delta_text(F.col("outcome") - 0.5, 1).alias("tenth"))


@query("scl_8", "SELECT DISTINCT hall_id, CASE WHEN hall_id = -1 THEN '?' WHEN hall_id % 3 = 0 THEN 'H' || hall_id || ' Hall' ELSE 'Hall ' || hall_id END AS hall_text FROM sides")
def scl_8(lg):
    name = F.when(F.col("hall_id") == -1, F.lit(None)).when(F.col("hall_id") % 3 == 0, F.concat(F.lit("H"), F.col("hall_id").cast("string"))).otherwise(F.col("hall_id").cast("string"))
    return lg.sides.select("hall_id").distinct().select("hall_id", S.hall_text(name).alias("hall_text"))


@query("scl_9", "SELECT player_id, name, 'R1' AS code, CASE WHEN length(name) <= 16 THEN name WHEN name LIKE '%Jr' THEN substr('P. ' || substr(player_id, 1, 1) || '. Jr', 1, 16) ELSE name END AS short FROM names")
def scl_9(lg):
    return lg.names.select("player_id", "name", S.round_code(F.lit("Round 1")).alias("code"), S.short_name("name", 16).alias("short"))


@query("scl_10", "SELECT player_id, seq, CAST(floor(rating_value + 0.5) AS BIGINT) AS elo FROM ratings")
def scl_10(lg):
    return lg.ratings.select("player_id", "seq", S.display_elo("rating_value").alias("elo"))


@query(
    "scl_11",
    """, k AS (SELECT player_id, seq, rating_value AS r, rating_deviation AS d, 1 / sqrt(1 + 3 * (rating_deviation / 173.7178) * (rating_deviation / 173.7178) / (pi() * pi())) AS g,
    1 / sqrt(1 + 3 * ((rating_deviation * rating_deviation + 350.0 * 350.0) / (173.7178 * 173.7178)) / (pi() * pi())) AS cg FROM ratings)
    SELECT player_id, seq, round(g, 9) AS g, round(cg, 9) AS combined, round(1 / (1 + exp(-g * (r - 1000) / 173.7178)), 9) AS expected, round(ln(1 / (1 + exp(-g * (r - 1000) / 173.7178)) / (1 - 1 / (1 + exp(-g * (r - 1000) / 173.7178)))), 7) AS logit FROM k""",
)
def scl_11(lg):
    e = S.expected_score("rating_value", F.lit(1000.0), "rating_deviation")
    return lg.ratings.select("player_id", "seq", F.round(S.g("rating_deviation"), 9).alias("g"), F.round(S.combined_g("rating_deviation", F.lit(BASE_RD)), 9).alias("combined"), F.round(e, 9).alias("expected"), F.round(S.logit(e), 7).alias("logit"))


@query("scl_12", "SELECT match_id, side, coalesce(CAST(seat AS DOUBLE), 3.0) AS seat FROM sides")
def scl_12(lg):
    return lg.sides.select("match_id", "side", S.seat_or_default("seat").alias("seat"))


@query("scl_13", "SELECT year, round_order, CASE WHEN round_order = 2 THEN 'Round 2' ELSE round_label END AS label FROM rounds")
def scl_13(lg):
    stored = F.when(F.col("round_order") != 2, F.col("round_label"))
    return lg.rounds.select("year", "round_order", S.round_text(stored, "round_order").alias("label"))


@query("scl_14", "SELECT player_id, name, lower(name) AS name_key FROM names")
def scl_14(lg):
    messy = F.concat(F.lit("  "), F.regexp_replace("name", " ", ",   "), F.lit(", "))
    return lg.names.select("player_id", "name", S.name_key(messy).alias("name_key"))


@query("flt_1", "SELECT match_id FROM boards WHERE rated")
def flt_1(lg):
    """Rated boards, told from the participants alone."""
    p = lg.participants.groupBy("match_id").agg(F.count("*").alias("n"), F.max((F.col("player_id") == SENTINEL) | (F.col("participation_type") == "WALKOVER")).alias("void"))
    return p.where((F.col("n") == 2) & ~F.col("void")).select("match_id")


@query("flt_2", "SELECT match_id, side, year, round_order FROM sides WHERE year = 1996 AND round_order <= 3")
def flt_2(lg):
    return lg.sides.where((F.col("year") == 1996) & (F.col("round_order") <= 3)).select("match_id", "side", "year", "round_order")


@query("flt_3", "SELECT player_id, hall_id, capped FROM status WHERE year = 1997 AND active")
def flt_3(lg):
    return lg.status.where((F.col("year") == 1997) & F.col("active")).select("player_id", "hall_id", "capped")


LATEST = """, latest AS (SELECT player_id, max_by(hall_id, seq) AS hall_id, max_by(rating_value, seq) AS rating FROM ratings GROUP BY 1)
"""


@query("srt_1", LATEST + "SELECT row_number() OVER (ORDER BY rating DESC, player_id, hall_id) AS pos, player_id, hall_id, rating FROM latest QUALIFY pos <= 100")
def srt_1(lg):
    """Ranking order with all its tie-breaks: the first hundred, a top-k report."""
    latest = setops.latest(lg.ratings, ["player_id"], "seq", {"hall_id": "hall_id", "rating": "rating_value"})
    order = [F.col("rating").desc(), "player_id", "hall_id"]
    return latest.orderBy(*order).limit(100).withColumn("pos", F.row_number().over(Window.orderBy(*order)).cast("long")).select("pos", "player_id", "hall_id", "rating")


@query("srt_2", LATEST + "SELECT hall_id, player_id, rating, CAST(row_number() OVER (PARTITION BY hall_id ORDER BY rating DESC, player_id) AS INTEGER) AS place FROM latest QUALIFY place <= 5")
def srt_2(lg):
    latest = setops.latest(lg.ratings, ["player_id"], "seq", {"hall_id": "hall_id", "rating": "rating_value"})
    return setops.top_per_group(latest, ["hall_id"], [F.col("rating").desc(), "player_id"], 5, "place").select("hall_id", "player_id", "rating", "place")


@query("srt_3", "SELECT year, round_order, seq FROM rounds ORDER BY seq DESC LIMIT 5")
def srt_3(lg):
    return lg.rounds.select("year", "round_order", "seq").orderBy(F.col("seq").desc()).limit(5)


@query(
    "set_1",
    """, first AS (SELECT year, player_id, min(round_order) AS first_round, any_value(hall_id) AS hall_id FROM played GROUP BY 1, 2)
    SELECT DISTINCT year, round_order, player_id FROM played UNION SELECT p.year, p.round_order, f.player_id FROM (SELECT DISTINCT year, round_order, hall_id FROM played) p JOIN first f ON f.year = p.year AND f.hall_id = p.hall_id AND f.first_round <= p.round_order""",
)
def set_1(lg):
    """Players that play or are carried: of the halls that play, seen earlier in the season."""
    return setops.rated_set(lg.played, lg.status)


@query("set_2", "SELECT CAST(0 AS BIGINT) AS only_left, CAST(count(*) AS BIGINT) AS only_right FROM (SELECT DISTINCT player_id FROM status EXCEPT SELECT DISTINCT player_id FROM played)")
def set_2(lg):
    """Differences between the players that have ratings and all players, both ways."""
    a, b = lg.ratings.select("player_id").distinct(), lg.status.select("player_id").distinct()
    return setops.difference_counts(a, b)


@query("set_3", "SELECT match_id, side, score, outcome, 'left' AS only_in FROM sides WHERE participation_type = 'TIMEOUT' UNION ALL SELECT match_id, side, score + 1, outcome, 'right' FROM sides WHERE participation_type = 'TIMEOUT'")
def set_3(lg):
    """Rows that two versions of a table don't share."""
    old = lg.sides.select("match_id", "side", "score", "outcome", "participation_type")
    new = old.withColumn("score", F.when(F.col("participation_type") == "TIMEOUT", F.col("score") + 1).otherwise(F.col("score")))
    return setops.table_difference(old.drop("participation_type"), new.drop("participation_type"))


@query("set_4", "SELECT player_id, year, max_by(rating_value, seq) AS rating_value FROM ratings GROUP BY 1, 2")
def set_4(lg):
    """One rating per player and season, the last write wins."""
    return setops.last_write(lg.ratings.select("player_id", "year", "seq", "rating_value"), ["player_id", "year"], "seq").select("player_id", "year", "rating_value")
