"""Aggregations over the league."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from leaguelens.operators import standings as A
from leaguelens.plans.base import query

# A plain stand-in for a model's predictions, so that SQL can repeat it: from the ratings' difference alone.
PREDICTED = """, pr AS (SELECT b.match_id, b.seq, b.outcome0 AS outcome, least(0.9, greatest(0.05, 0.475 + (a.rating_value - c.rating_value) / 400)) AS p_win, 'elo' AS model FROM boards b JOIN ratings a ON a.player_id = b.player_id0 AND a.seq = b.seq JOIN ratings c ON c.player_id = b.player_id1 AND c.seq = b.seq WHERE b.rated),
 preds AS (SELECT match_id, seq, outcome, p_win, 0.05 AS p_draw, 0.95 - p_win AS p_loss, model FROM pr UNION ALL SELECT match_id, seq, outcome, 0.475, 0.05, 0.475, 'flat' FROM pr)
"""


def predictions(lg):
    r = lg.ratings.select("player_id", "seq", "rating_value")
    b = lg.played.where("side = 0").select("match_id", "seq", "outcome", "player_id", "opp_player_id")
    both = b.join(r, ["player_id", "seq"]).join(r.select(F.col("player_id").alias("opp_player_id"), "seq", F.col("rating_value").alias("other")), ["opp_player_id", "seq"])
    win = F.least(F.lit(0.9), F.greatest(F.lit(0.05), 0.475 + (F.col("rating_value") - F.col("other")) / 400))
    elo = both.select("match_id", "seq", "outcome", win.alias("p_win")).select("*", F.lit(0.05).alias("p_draw"), (0.95 - F.col("p_win")).alias("p_loss"), F.lit("elo").alias("model"))
    flat = elo.select("match_id", "seq", "outcome", F.lit(0.475).alias("p_win"), F.lit(0.05).alias("p_draw"), F.lit(0.475).alias("p_loss"), F.lit("flat").alias("model"))
    return elo.unionByName(flat)


@query("agg_1", "SELECT year, max(round_order) AS latest FROM rounds GROUP BY year")
def agg_1(lg):
    return lg.participants.groupBy("year").agg(F.max("round_order").alias("latest"))


@query("agg_2", "SELECT year, player_id, min(round_order) AS first_round FROM sides WHERE player_id <> 'WLKOVR' GROUP BY 1, 2")
def agg_2(lg):
    return lg.participants.where("player_id <> 'WLKOVR'").groupBy("year", "player_id").agg(F.min("round_order").alias("first_round"))


@query("agg_3", "SELECT year, round_order, hall_id, round(avg(rating_value), 9) AS hall_elo FROM (SELECT *, row_number() OVER (PARTITION BY seq, hall_id ORDER BY rating_value DESC, player_id) AS n FROM ratings) WHERE n <= 5 GROUP BY 1, 2, 3")
def agg_3(lg):
    return A.hall_elo(lg.ratings, ["year", "round_order", "hall_id"]).withColumn("hall_elo", F.round("hall_elo", 9))


@query("agg_4", "SELECT year, hall_id, count(*) AS players, count(*) FILTER (capped) AS capped FROM status GROUP BY 1, 2")
def agg_4(lg):
    return lg.status.groupBy("year", "hall_id").agg(F.count("*").alias("players"), F.count_if("capped").alias("capped"))


@query("agg_5", "SELECT player_id, year, round(avg(seat), 9) AS avg_seat FROM sides WHERE player_id <> 'WLKOVR' GROUP BY 1, 2")
def agg_5(lg):
    return lg.participants.where("player_id <> 'WLKOVR'").groupBy("player_id", "year").agg(F.round(F.avg("seat"), 9).alias("avg_seat"))


@query("agg_6", "SELECT player_id, year, sum(outcome) AS points_won, sum(1 - outcome) AS points_lost FROM sides WHERE player_id <> 'WLKOVR' GROUP BY 1, 2")
def agg_6(lg):
    return lg.participants.where("player_id <> 'WLKOVR'").groupBy("player_id", "year").agg(F.sum("outcome").alias("points_won"), F.sum(1 - F.col("outcome")).alias("points_lost"))


@query("agg_7", "SELECT player_id, year, count(*) FILTER (outcome = 1) AS wins, count(*) FILTER (outcome = 0.5) AS draws, count(*) FILTER (outcome = 0) AS losses FROM sides WHERE player_id <> 'WLKOVR' GROUP BY 1, 2")
def agg_7(lg):
    n = lambda v: F.count_if(F.col("outcome") == v)
    return lg.participants.where("player_id <> 'WLKOVR'").groupBy("player_id", "year").agg(n(1.0).alias("wins"), n(0.5).alias("draws"), n(0.0).alias("losses"))


MATCHUPS = """, mu AS (SELECT year, round_order, seq, least(hall_id, opp_hall_id) AS hall_a, greatest(hall_id, opp_hall_id) AS hall_b, sum(CASE WHEN hall_id < opp_hall_id THEN outcome ELSE 0 END) AS points_a, sum(CASE WHEN hall_id < opp_hall_id THEN 0 ELSE outcome END) AS points_b FROM played GROUP BY 1, 2, 3, 4, 5
  UNION ALL SELECT year, round_order, seq, hall_id, NULL, sum(outcome), 0 FROM sides WHERE player_id <> 'WLKOVR' GROUP BY 1, 2, 3, 4 HAVING NOT bool_or(rated)),
 matchups AS (SELECT *, CASE WHEN points_a > points_b THEN 1.0 WHEN points_a = points_b THEN 0.5 ELSE 0.0 END AS outcome_a FROM mu),
 hr AS (SELECT year, round_order, hall_id, sum(points) AS points, sum(win) AS win FROM (SELECT year, round_order, hall_a AS hall_id, CASE WHEN hall_b IS NULL THEN 3.0 ELSE points_a END AS points, outcome_a AS win FROM matchups UNION ALL SELECT year, round_order, hall_b, points_b, 1 - outcome_a FROM matchups WHERE hall_b IS NOT NULL) GROUP BY 1, 2, 3),
 st AS (SELECT year, round_order, hall_id, CAST(sum(win) OVER w AS DOUBLE) AS match_wins, CAST(sum(points) OVER w AS DOUBLE) AS board_wins FROM hr WINDOW w AS (PARTITION BY year, hall_id ORDER BY round_order ROWS UNBOUNDED PRECEDING)),
 standings AS (SELECT *, CAST(rank() OVER (PARTITION BY year, round_order ORDER BY match_wins DESC, board_wins DESC) AS INTEGER) AS place FROM st)
"""


@query("agg_8", MATCHUPS + "SELECT year, round_order, hall_a, hall_b, CAST(points_a AS DOUBLE) AS points_a, CAST(points_b AS DOUBLE) AS points_b, CAST(outcome_a AS DOUBLE) AS outcome_a FROM matchups")
def agg_8(lg):
    return A.matchups(lg.sides).drop("seq")


@query("agg_9", MATCHUPS + "SELECT * FROM standings")
def agg_9(lg):
    return A.standings(lg.sides)


TALLY = """, tally AS (SELECT year, round_order, hall_id, opp_hall_id, count(*) AS boards, sum(outcome) AS points_for, sum(opp_outcome) AS points_against FROM sides WHERE player_id <> 'WLKOVR' AND hall_id <> opp_hall_id AND opp_hall_id <> -1 GROUP BY 1, 2, 3, 4)
"""


@query("agg_10", TALLY + "SELECT * FROM tally QUALIFY row_number() OVER (PARTITION BY year, round_order, hall_id ORDER BY boards DESC, points_for DESC, opp_hall_id) = 1")
def agg_10(lg):
    return A.primary_opponent(A.opponent_tally(lg.sides))


@query("agg_11", "SELECT year, round_order, hall_id, CASE WHEN bool_and(NOT rated AND opp_hall_id = -1) THEN 3.0 ELSE sum(outcome) END AS points, CASE WHEN bool_and(NOT rated AND opp_hall_id = -1) THEN 0.0 ELSE sum(opp_outcome) END AS against FROM sides WHERE player_id <> 'WLKOVR' GROUP BY 1, 2, 3")
def agg_11(lg):
    return A.hall_round_tally(lg.sides)


@query("agg_12", "SELECT round(coalesce(avg(CASE WHEN outcome0 = 0.5 THEN 1.0 ELSE 0.0 END), 0.05), 9) AS draw_rate FROM boards WHERE rated")
def agg_12(lg):
    return lg.played.where("side = 0").agg(F.round(F.coalesce(F.avg((F.col("outcome") == 0.5).cast("double")), F.lit(0.05)), 9).alias("draw_rate"))


RIGHT = "CASE outcome WHEN 1 THEN p_win WHEN 0.5 THEN p_draw ELSE p_loss END"
BRIER = "(p_win - CASE WHEN outcome = 1 THEN 1 ELSE 0 END) ** 2 + (p_draw - CASE WHEN outcome = 0.5 THEN 1 ELSE 0 END) ** 2 + (p_loss - CASE WHEN outcome = 0 THEN 1 ELSE 0 END) ** 2"


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 8) for n in names})


@query(
    "agg_13",
    PREDICTED + f"SELECT model, count(*) AS boards, round(avg({BRIER}), 8) AS brier, round(avg(-ln(greatest({RIGHT}, 1e-12))), 8) AS log_loss, round(avg((p_win + p_draw / 2 - outcome) ** 2), 8) AS es_mse, round(avg(CASE WHEN {RIGHT} >= greatest(p_win, p_draw, p_loss) THEN 1.0 ELSE 0.0 END), 8) AS accuracy FROM preds GROUP BY 1",
)
def agg_13(lg):
    return rounded(A.quality(predictions(lg), ["model"]), "brier", "log_loss", "es_mse", "accuracy")


@query("agg_14", PREDICTED + "SELECT model, CAST(least(9, floor((p_win + p_draw / 2) * 10)) AS INTEGER) AS bucket, count(*) AS boards, round(avg(p_win + p_draw / 2), 8) AS predicted, round(avg(outcome), 8) AS actual FROM preds GROUP BY 1, 2")
def agg_14(lg):
    return rounded(A.calibration(predictions(lg), ["model"]), "predicted", "actual")


@query("agg_15", PREDICTED + f"SELECT count(*) FILTER (m < b) AS better, count(*) FILTER (m > b) AS worse FROM (SELECT seq, avg({BRIER}) FILTER (model = 'elo') AS m, avg({BRIER}) FILTER (model = 'flat') AS b FROM preds GROUP BY 1)")
def agg_15(lg):
    return A.paired_rounds(predictions(lg), "elo", "flat")


@query("agg_16", PREDICTED + f"SELECT model, count(*) FILTER (outcome <> 0.5) AS decisive, count(*) FILTER (outcome <> 0.5 AND {RIGHT} >= greatest(p_win, p_draw, p_loss)) AS hits, round(avg({RIGHT}), 8) AS mean_probability FROM preds GROUP BY 1")
def agg_16(lg):
    """Live scorecard of logged predictions."""
    p = predictions(lg)
    right = F.when(F.col("outcome") == 1.0, F.col("p_win")).when(F.col("outcome") == 0.5, F.col("p_draw")).otherwise(F.col("p_loss"))
    out = p.groupBy("model").agg(F.count_if(F.col("outcome") != 0.5).alias("decisive"), F.count_if((F.col("outcome") != 0.5) & (right >= F.greatest("p_win", "p_draw", "p_loss"))).alias("hits"), F.avg(right).alias("mean_probability"))
    return rounded(out, "mean_probability")


@query("agg_17", PREDICTED + f"SELECT model, seq, round(avg({BRIER}), 8) AS brier FROM preds GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY model ORDER BY seq DESC) = 1")
def agg_17(lg):
    """The latest run of each family."""
    runs = A.quality(predictions(lg), ["model", "seq"]).select("model", "seq", F.round("brier", 8).alias("brier"))
    return runs.withColumn("_n", F.row_number().over(Window.partitionBy("model").orderBy(F.col("seq").desc()))).where("_n = 1").drop("_n")


SEATS = """, sc AS (SELECT hall_id, player_id, seat, count(*) AS n FROM played GROUP BY 1, 2, 3),
 pe2 AS (SELECT hall_id, player_id, -sum((n / t) * ln(n / t) / ln(2.0)) AS entropy FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY hall_id, player_id) AS DOUBLE) AS t FROM sc) GROUP BY 1, 2)
"""


@query("agg_18", SEATS + "SELECT hall_id, round(avg(entropy), 7) + 0.0 AS entropy FROM pe2 GROUP BY 1")
def agg_18(lg):
    """Mean seat entropy of a hall's players, in bits."""
    n = lg.played.groupBy("hall_id", "player_id", "seat").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("hall_id", "player_id"))
    e = n.withColumn("p", share).groupBy("hall_id", "player_id").agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))
    return e.groupBy("hall_id").agg((F.round(F.avg("entropy"), 7) + 0.0).alias("entropy"))


@query("agg_19", "SELECT count(*) AS boards, count(DISTINCT seq) AS rounds, count(DISTINCT year) AS years, round(avg(CASE WHEN outcome0 = 0.5 THEN 1.0 ELSE 0.0 END), 8) AS draw_share, count(*) FILTER (kind0 = 'TIMEOUT' OR kind1 = 'TIMEOUT') AS timeouts, count(*) FILTER (seat0 IS NULL OR seat1 IS NULL) AS null_seats FROM boards WHERE rated")
def agg_19(lg):
    return rounded(A.board_profile(lg.sides), "draw_share")
