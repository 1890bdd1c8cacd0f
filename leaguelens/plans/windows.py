"""Window functions over the league and over the events."""

from pyspark.sql import functions as F

from leaguelens.operators import running as W
from leaguelens.operators import standings
from leaguelens.plans.basics import RAW
from leaguelens.plans.base import query
from leaguelens.sources.round_files import raw_rows

WON = ", real AS (SELECT * FROM sides WHERE player_id <> 'WLKOVR')\n"


@query(
    "win_1",
    RAW + ", two AS (SELECT year, round_order, row_no, 1 AS side, name1 AS name, hall1 AS hall FROM raw UNION ALL SELECT year, round_order, row_no, 2, name2, hall2 FROM raw) SELECT *, CAST(row_number() OVER (PARTITION BY year, round_order, hall ORDER BY row_no, side) AS INTEGER) AS seat FROM two WHERE name <> 'WALKOVER'",
)
def win_1(lg):
    return W.seats_in_file_order(raw_rows(lg))


HALLS = ", he AS (SELECT year, round_order, seq, hall_id, avg(rating_value) AS hall_elo FROM (SELECT *, row_number() OVER (PARTITION BY seq, hall_id ORDER BY rating_value DESC, player_id) AS n FROM ratings) WHERE n <= 5 GROUP BY 1, 2, 3, 4)\n"


def hall_elos(lg):
    return standings.hall_elo(lg.ratings, ["year", "round_order", "seq", "hall_id"])


@query("win_2", HALLS + "SELECT year, round_order, hall_id, CAST(rank() OVER (PARTITION BY year, round_order ORDER BY round(hall_elo, 6) DESC) AS INTEGER) AS rank FROM he")
def win_2(lg):
    return W.competition_rank(hall_elos(lg).withColumn("hall_elo", F.round("hall_elo", 6)), ["year", "round_order"], "hall_elo").select("year", "round_order", "hall_id", "rank")


@query("win_3", "SELECT year, round_order, player_id, CAST(row_number() OVER (PARTITION BY year, round_order ORDER BY rating_value DESC, player_id, hall_id) AS INTEGER) AS position FROM ratings")
def win_3(lg):
    return W.position(lg.ratings, ["year", "round_order"], [F.col("rating_value").desc(), "player_id", "hall_id"]).select("year", "round_order", "player_id", "position")


@query("win_4", "SELECT player_id, seq, rating_value - lag(rating_value) OVER (PARTITION BY player_id ORDER BY seq) AS delta FROM ratings")
def win_4(lg):
    return W.change(lg.ratings, ["player_id"], "seq", "rating_value", "delta").select("player_id", "seq", "delta")


@query("win_5", WON + "SELECT player_id, year || ' ' || round_label AS label FROM (SELECT player_id, max(seq) AS seq FROM real GROUP BY 1) JOIN rounds USING (seq)")
def win_5(lg):
    return W.last_label(lg.sides, lg.rounds)


@query(
    "win_6",
    """SELECT match_id, player_id, seq, coalesce(sum(outcome) OVER f, 0) AS sum_last5, count(outcome) OVER f AS count_last5, round(avg((score - opp_score) / 370) OVER f, 8) + 0.0 AS margin_form, round(stddev_pop((score - opp_score) / 370) OVER f, 8) + 0.0 AS margin_spread, round(avg(seat) OVER t, 8) AS seat_last3
    FROM played WINDOW f AS (PARTITION BY player_id ORDER BY seq ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), t AS (PARTITION BY player_id ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""",
)
def win_6(lg):
    out = W.form(lg.sides)
    return out.withColumns({c: F.round(c, 8) + 0.0 for c in ("margin_form", "margin_spread")}).withColumn("seat_last3", F.round("seat_last3", 8))


@query(
    "win_7",
    """SELECT match_id, player_id, seq, count(*) OVER p AS career_boards, count(*) OVER y AS season_boards, coalesce(sum(outcome) OVER h, 0) AS won_vs_hall, count(*) OVER h AS boards_vs_hall, sum(CASE WHEN participation_type = 'TIMEOUT' THEN 1 ELSE 0 END) OVER q - CASE WHEN participation_type = 'TIMEOUT' THEN 1 ELSE 0 END AS timeouts
    FROM played WINDOW p AS (PARTITION BY player_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q AS (PARTITION BY player_id ORDER BY seq ROWS UNBOUNDED PRECEDING), y AS (PARTITION BY player_id, year ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), h AS (PARTITION BY player_id, opp_hall_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def win_7(lg):
    return W.running_counts(lg.sides)


@query("win_7_halls", "SELECT hall_id, seq, coalesce(sum(s) OVER w, 0) AS points, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS boards FROM (SELECT hall_id, seq, sum(outcome) AS s, count(*) AS n FROM played GROUP BY 1, 2) WINDOW w AS (PARTITION BY hall_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def win_7_halls(lg):
    return W.running_over_rounds(lg.played, ["hall_id"], "outcome", ("points", "boards"))


@query("win_7_league", "SELECT seq, coalesce(sum(s) OVER w, 0) AS points, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS boards FROM (SELECT seq, sum(score) AS s, count(*) AS n FROM played GROUP BY 1) WINDOW w AS (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def win_7_league(lg):
    return W.running_over_rounds(lg.played, [], "score", ("points", "boards"))


@query("win_8", "SELECT match_id, player_id, greatest(0, coalesce(round_order - lag(round_order) OVER (PARTITION BY player_id, year ORDER BY round_order) - 1, 0)) AS missed FROM played")
def win_8(lg):
    return W.rounds_missed(lg.sides)


STREAK = """, t AS (SELECT k, o, outcome, row_number() OVER (PARTITION BY k ORDER BY o DESC) AS n FROM src),
 d AS (SELECT k, max(CASE WHEN n = 1 THEN outcome END) AS latest FROM t GROUP BY 1),
 x AS (SELECT t.k, latest, coalesce(min(CASE WHEN outcome <> latest THEN n END) - 1, max(n)) AS len FROM t JOIN d ON d.k = t.k GROUP BY 1, 2)
"""
EVENTS = "WITH src AS (SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS o, CASE WHEN event_type IN ('purchase', 'signup') THEN 1.0 WHEN event_type = 'error' THEN 0.0 ELSE 0.5 END AS outcome FROM events)" + STREAK


def event_results(lg):
    e = lg.spark.read.parquet(f"{lg.sf_dir}/events.parquet")
    outcome = F.when(F.col("event_type").isin("purchase", "signup"), 1.0).when(F.col("event_type") == "error", 0.0).otherwise(0.5)
    return e.select("user_id", "ts", "event_id", "value", outcome.alias("outcome"))


@query("win_9", EVENTS + "SELECT k AS user_id, CAST(CASE latest WHEN 1 THEN len WHEN 0 THEN -len ELSE 0 END AS BIGINT) AS streak FROM x", plain=True)
def win_9(lg):
    """Streaks of the events' users."""
    return W.streaks(event_results(lg), "user_id", ["ts", "event_id"])


CACHE = WON + ", src AS (SELECT player_id AS k, seq AS o, outcome FROM real)" + STREAK + """, m AS (SELECT player_id, round(avg(CASE WHEN n <= 5 THEN (score - opp_score) / 370 END), 8) + 0.0 AS margin FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY seq DESC) AS n FROM real) GROUP BY 1),
 cache AS (SELECT k AS player_id, CAST(CASE latest WHEN 1 THEN len WHEN 0 THEN -len ELSE 0 END AS BIGINT) AS current_streak, margin AS avg_margin_last_5, CAST(1 AS BIGINT) AS boards_in_latest_round FROM x JOIN m ON m.player_id = x.k)
"""


@query("win_10", CACHE + "SELECT player_id, avg_margin_last_5, boards_in_latest_round FROM cache")
def win_10(lg):
    out = W.rolling_cache(lg.sides)
    return out.select("player_id", (F.round("avg_margin_last_5", 8) + 0.0).alias("avg_margin_last_5"), "boards_in_latest_round")


@query("rep_12", CACHE + "SELECT * FROM cache")
def rep_12(lg):
    out = W.rolling_cache(lg.sides)
    return out.withColumn("avg_margin_last_5", F.round("avg_margin_last_5", 8) + 0.0)


@query("win_11", "SELECT player_id, seq, hall_id, seat, outcome FROM played QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY seq DESC) = 1")
def win_11(lg):
    p = lg.played.groupBy("player_id").agg(F.max_by(F.struct("seq", "hall_id", "seat", "outcome"), "seq").alias("r"))
    return p.select("player_id", "r.*")


@query("win_12", "SELECT player_id, max(year) AS latest_year, max_by(name, last_seen_year * 10 + CASE WHEN name LIKE '%Jr' THEN 1 ELSE 0 END) AS name FROM status JOIN names USING (player_id) GROUP BY 1")
def win_12(lg):
    """Players by recency: latest year and last-known name."""
    latest = lg.status.groupBy("player_id").agg(F.max("year").alias("latest_year"))
    name = lg.names.groupBy("player_id").agg(F.max_by("name", F.struct("last_seen_year", "name")).alias("name"))
    return latest.join(name, "player_id")


@query("win_13", "SELECT hall_id, player_id, seat, round(sum(exp(-ln(2.0) / 10 * ((SELECT max(seq) FROM rounds) - seq))), 8) AS weight FROM played GROUP BY 1, 2, 3")
def win_13(lg):
    now = lg.rounds.agg(F.max("seq")).first()[0] or 0
    return lg.played.groupBy("hall_id", "player_id", "seat").agg(F.round(F.sum(W.recency_weight(now - F.col("seq"))), 8).alias("weight"))
