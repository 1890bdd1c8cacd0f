"""Joins over the league."""

from pyspark.sql import functions as F

from leaguelens.operators import asof, setops
from leaguelens.plans.base import query

V = "rating_value, rating_deviation, volatility"


@query("jn_1", "SELECT match_id, side, player_id, year, round_order, round_label, score FROM sides JOIN rounds USING (year, round_order, seq, round_id) WHERE player_id <> 'WLKOVR'")
def jn_1(lg):
    p = lg.participants.where("player_id <> 'WLKOVR'")
    return p.join(F.broadcast(lg.rounds.select("round_id", "round_label")), "round_id").select("match_id", "side", "player_id", "year", "round_order", "round_label", "score")


@query("jn_2", "SELECT match_id, player_id, hall_id, score, outcome, opp_player_id, opp_hall_id, opp_score FROM sides")
def jn_2(lg):
    return asof.opponents(lg.participants)


@query("jn_3", f"SELECT player_id, year, round_order, {V} FROM ratings WHERE year = 1998 AND round_order <= 3 QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY seq DESC) = 1")
def jn_3(lg):
    return asof.latest_rating(lg.ratings, asof.up_to(1998, 3))


@query("jn_4", f"SELECT player_id, year, round_order, {V} FROM ratings WHERE year < 1998 QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY seq DESC) = 1")
def jn_4(lg):
    return asof.latest_rating(lg.ratings, asof.before_year(1998))


@query("jn_5", f"SELECT player_id, year, round_order, {V} FROM ratings QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY seq DESC) = 1")
def jn_5(lg):
    return asof.latest_rating(lg.ratings)


@query(
    "jn_6",
    "SELECT match_id, player_id, seq, coalesce(lag(rating_value) OVER w, 1000) AS rating_value, coalesce(lag(rating_deviation) OVER w, 350) AS rating_deviation, CAST(0.06 AS DOUBLE) AS volatility FROM ratings JOIN played USING (player_id, seq) WINDOW w AS (PARTITION BY player_id ORDER BY seq)",
)
def jn_6(lg):
    return asof.seed_ratings(lg.played.select("match_id", "player_id", "seq"), lg.ratings)


@query("jn_7", "SELECT player_id, round_id, CASE WHEN year = 1997 THEN rating_value + 1 ELSE rating_value END AS rating_value, rating_deviation, volatility FROM ratings")
def jn_7(lg):
    columns = ["player_id", "round_id", *asof.VALUES]
    snapshot = lg.ratings.where("year = 1997").withColumn("rating_value", F.col("rating_value") + 1)
    return asof.overlay(lg.ratings.select(*columns), snapshot.select(*columns), ["player_id", "round_id"])


@query("jn_8", "SELECT player_id, year, hall_id, capped FROM status WHERE year < 2000 QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY year DESC, hall_id DESC) = 1")
def jn_8(lg):
    return asof.latest_status(lg.status, 2000)


@query("jn_9", "SELECT player_id, name FROM names QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY (first_seen_year <= 1998 AND last_seen_year >= 1998) DESC, last_seen_year DESC, name DESC) = 1")
def jn_9(lg):
    return asof.name_for_year(lg.names, 1998)


@query("jn_10", "SELECT upper(a.name) AS asked, n.player_id, n.name, n.last_seen_year, CAST(1 AS INTEGER) AS place FROM names a JOIN names n ON lower(a.name) = lower(n.name)")
def jn_10(lg):
    return asof.exact_candidates(lg.names.select(F.upper("name").alias("name")), lg.names)


@query(
    "jn_12",
    """, first AS (SELECT year, player_id, min(round_order) AS first_round FROM played GROUP BY 1, 2)
    SELECT DISTINCT p.year, p.round_order, f.player_id FROM (SELECT DISTINCT year, round_order, hall_id FROM played) p JOIN status s ON s.year = p.year AND s.hall_id = p.hall_id JOIN first f ON f.year = p.year AND f.player_id = s.player_id AND f.first_round <= p.round_order""",
)
def jn_12(lg):
    return setops.rated_set(lg.played, lg.status)


@query("jn_13", f"SELECT player_id, round_id, {V} FROM ratings WHERE round_id % 10 <> 2")
def jn_13(lg):
    """Rows of rounds that no snapshot has."""
    rows = lg.ratings.select("player_id", "round_id", *asof.VALUES)
    return asof.orphans(rows, rows.where("round_id % 10 = 2"), ["round_id"])


@query("jn_14", "SELECT match_id, side FROM sides WHERE round_id = 19971")
def jn_14(lg):
    return asof.orphans(lg.participants, lg.rounds.where("round_id <> 19971"), ["round_id"]).select("match_id", "side")


@query(
    "jn_15",
    """, h AS (SELECT hall_id, player_id FROM (SELECT hall_id, player_id, count(*) AS n FROM played GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY hall_id ORDER BY n DESC, player_id) <= 5),
    m AS (SELECT DISTINCT hall_id, opp_hall_id FROM played)
    SELECT m.hall_id, m.opp_hall_id, a.player_id AS ours, b.player_id AS theirs, CAST(s.seat AS INTEGER) AS seat FROM m JOIN h a ON a.hall_id = m.hall_id JOIN h b ON b.hall_id = m.opp_hall_id CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS seat) s""",
)
def jn_15(lg):
    """Ours x theirs x seat of the halls that have met; at most 125 rows for a pair of halls."""
    counts = lg.played.groupBy("hall_id", "player_id").agg(F.count("*").alias("n"))
    five = setops.top_per_group(counts, ["hall_id"], [F.col("n").desc(), "player_id"], 5).select("hall_id", "player_id")
    met = lg.played.select("hall_id", "opp_hall_id").distinct()
    ours = five.withColumnRenamed("player_id", "ours")
    theirs = five.select(F.col("hall_id").alias("opp_hall_id"), F.col("player_id").alias("theirs"))
    return met.join(ours, "hall_id").join(theirs, "opp_hall_id").withColumn("seat", F.explode(F.sequence(F.lit(1), F.lit(5)))).select("hall_id", "opp_hall_id", "ours", "theirs", "seat")


@query("jn_16", "SELECT match_id, 'v' || (match_id % 2) AS model_version, CASE WHEN score0 > score1 THEN outcome0 = 1 ELSE outcome1 = 1 END AS hit FROM boards WHERE rated AND outcome0 <> 0.5")
def jn_16(lg):
    """Predictions (here: the higher score wins) joined to outcomes."""
    p = lg.played.where("side = 0").select("match_id", F.concat(F.lit("v"), (F.col("match_id") % 2).cast("string")).alias("model_version"), F.when(F.col("score") > F.col("opp_score"), 0).otherwise(1).alias("winner"))
    o = lg.played.where("outcome <> 0.5").select("match_id", "side", "outcome")
    return p.join(o, "match_id").where("winner = side").select("match_id", "model_version", (F.col("outcome") == 1.0).alias("hit"))
