"""Matchup models of the league."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from leaguelens.operators import boosting as B
from leaguelens.operators import embedding as E
from leaguelens.operators import features as X
from leaguelens.operators import models as M
from leaguelens.operators import registry as G
from leaguelens.operators.checkpoints import written
from leaguelens.plans.features import features, met_pairs, next_round
from leaguelens.plans.ratings import PAIRED, paired
from leaguelens.plans.aggregates import PREDICTED, predictions
from leaguelens.plans.base import query

BASE, LOGISTIC = M.BASELINE, M.LOGISTIC
_KEPT: dict[tuple, object] = {}


def boards(lg):
    return X.boards(features(lg))


@query("mdl_1")
def mdl_1(lg):
    b = boards(lg)
    return M.baseline(b, M.draw_rate(b)).select("match_id", "p_win", "p_draw", "p_loss")


@query("mdl_2")
def mdl_2(lg):
    """The weights of the logistic model over all boards."""
    b = boards(lg)
    m = M.fit_logistic(b, 6.0, 1.0)
    return b.agg(F.count("*").alias("trained_boards")).select("trained_boards", F.lit([float(x) for x in m.draw]).alias("draw_weights"), F.lit([float(x) for x in m.win]).alias("win_weights"))


@query("mdl_3")
def mdl_3(lg):
    b = boards(lg)
    return M.predict_logistic(b, M.fit_logistic(b, 6.0, 1.0)).select("match_id", "p_win", "p_draw", "p_loss")


def backtest(lg, grid=None):
    """Walk-forward predictions of a grid, computed once in an application and table folder."""
    grid = grid or tuple(c for c in M.GRID if c.name in (BASE, "logistic n0=6 ridge=3"))
    key = (lg.spark.sparkContext.applicationId, lg.sf_dir, grid)
    if key not in _KEPT:
        b = written(boards(lg))
        rounds = [r.seq for r in b.select("seq").distinct().orderBy("seq").collect()]  # rounds
        _KEPT[key] = written(M.walk_forward(b, grid, rounds[M.burn_in(b) :]))
    return _KEPT[key]


@query("mdl_10")
def mdl_10(lg):
    """Walk-forward predictions of the baseline and one logistic model, fitted anew before each round."""
    return backtest(lg)


@query("mdl_11")
def mdl_11(lg):
    """Quality of every candidate of the grid, each fitted anew before each round."""
    return M.scores(backtest(lg, M.GRID), ["model"])


@query("mdl_12")
def mdl_12(lg):
    return M.champion(M.scores(backtest(lg, M.GRID), ["model"]), BASE)


@query("rep_11")
def rep_11(lg):
    """The dashboard: each candidate's quality and place, the champion marked."""
    q = M.scores(backtest(lg, M.GRID), ["model"])
    best = M.champion(q, BASE).select("model", F.lit(True).alias("champion"))
    place = F.row_number().over(Window.orderBy("brier", "model"))  # one row for each candidate
    return q.join(F.broadcast(best), "model", "left").withColumn("champion", F.coalesce("champion", F.lit(False))).withColumn("place", place)


@query("agg_13_backtest")
def agg_13_backtest(lg):
    """Quality by model and round of the walk-forward predictions over the computed ratings."""
    return M.scores(backtest(lg), ["model", "seq"])


# Features of a board that SQL can repeat: differences of what the sides have done before.
SPLITS = """, hist AS (SELECT match_id, side, outcome, count(*) OVER p AS career, count(*) OVER y AS season, coalesce(sum(outcome) OVER p, 0) AS won FROM played
   WINDOW p AS (PARTITION BY player_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), y AS (PARTITION BY player_id, year ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 bx AS (SELECT a.match_id, a.outcome, CAST(a.career - b.career AS DOUBLE) AS x0, CAST(a.season - b.season AS DOUBLE) AS x1, CAST(a.won - b.won AS DOUBLE) AS x2 FROM hist a JOIN hist b ON a.match_id = b.match_id AND a.side = 0 AND b.side = 1 WHERE a.outcome <> 0.5),
 lx AS (""" + " UNION ALL ".join(f"SELECT {k} AS feature, x{k} AS value, sum(0.5 - outcome) AS g, 0.25 * count(*) AS h FROM bx GROUP BY 2" for k in range(3)) + """),
 cx AS (SELECT feature, (value + lead(value) OVER o) / 2 AS threshold, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY feature) AS gt, sum(h) OVER (PARTITION BY feature) AS ht FROM lx
   WINDOW o AS (PARTITION BY feature ORDER BY value), w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING))
"""


def plain_boards(lg):
    """match_id, outcome and x of decisive boards, by the counts before the round."""
    before = lambda *k: Window.partitionBy(*k).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    h = lg.played.select("match_id", "side", "outcome", F.count("*").over(before("player_id")).alias("career"), F.count("*").over(before("player_id", "year")).alias("season"), F.coalesce(F.sum("outcome").over(before("player_id")), F.lit(0.0)).alias("won"))
    two = h.groupBy("match_id").pivot("side", [0, 1]).agg(F.first(F.struct("outcome", "career", "season", "won")))
    x = F.array(*((F.col("0")[c] - F.col("1")[c]).cast("double") for c in ("career", "season", "won")))
    return two.select("match_id", F.col("0")["outcome"].alias("outcome"), x.alias("x")).where("outcome <> 0.5")


@query("mdl_4", SPLITS + "SELECT feature, threshold, round(0.5 * (gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1)), 6) AS gain, round(-gl / (hl + 1), 8) AS left_leaf, round(-(gt - gl) / (ht - hl + 1), 8) AS right_leaf FROM cx WHERE threshold IS NOT NULL AND hl >= 4 AND ht - hl >= 4")
def mdl_4(lg):
    """Gain and leaf values of every split of the first node, over features that SQL can repeat."""
    rows = plain_boards(lg).select("x", (0.5 - F.col("outcome")).alias("g"), F.lit(0.25).alias("h"))
    return B.split_gains(rows).select("feature", "threshold", F.round("gain", 6).alias("gain"), F.round("left", 8).alias("left_leaf"), F.round("right", 8).alias("right_leaf"))


def boosted(lg):
    """One boosted model over all boards: (boards, model)."""
    key = (lg.spark.sparkContext.applicationId, lg.sf_dir, "gbm")
    if key not in _KEPT:
        b = written(boards(lg))
        last = b.agg(F.max("seq")).first()[0]
        _, models = B.fit_rounds(b, [("gbm", 6.0, 1.0)], [(last if last is not None else -1) + 1])
        _KEPT[key] = b, next(iter(models.values()))
    return _KEPT[key]


@query("mdl_5")
def mdl_5(lg):
    """The trees of a boosted model: one row for each node that is reached."""
    _, m = boosted(lg)
    rows = []
    for f in (m.draw, m.win):
        for k, t in enumerate(f.trees):
            for n in range(len(t.feature)):
                if n == 0 or t.feature[(n - 1) // 2] >= 0:
                    feature = int(t.feature[n])
                    cut = float(m.edges[f.stage, f.n0][feature][t.cut[n]]) if feature >= 0 and t.cut[n] < len(m.edges[f.stage, f.n0][feature]) else None
                    rows.append((f.stage, k, n, feature, cut, bool(t.missing_left[n]), float(t.value[n])))
    return lg.spark.createDataFrame(rows, "stage string, tree int, node int, feature int, threshold double, missing_left boolean, value double")  # a model's nodes


@query("mdl_6")
def mdl_6(lg):
    b, m = boosted(lg)
    return B.predict(b, {"gbm": m}, ["match_id"]).drop("model")


def net(lg):
    """Vectors of four numbers, learned from all boards, once in an application and table folder."""
    key = (lg.spark.sparkContext.applicationId, lg.sf_dir, "net")
    if key not in _KEPT:
        b = written(boards(lg))
        _KEPT[key] = b, E.fit(b, 4)
    return _KEPT[key]


@query("mdl_7")
def mdl_7(lg):
    """The learned vector of every player and hall."""
    return net(lg)[1].vectors


@query("mdl_8")
def mdl_8(lg):
    """The interaction features of every board by those vectors."""
    b, n = net(lg)
    keys = b.select("match_id", *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("player_id", "hall_id")))
    return E.with_features(keys, n).select("match_id", F.col("embedded").alias("interaction"))


@query("mdl_13", "SELECT hall_id, 'elo.r' || (SELECT count(*) FROM rounds) || '.' || substr(sha256('{\"hall\":' || hall_id || '}'), 1, 8) AS model_version FROM (SELECT DISTINCT hall_id FROM status)")
def mdl_13(lg):
    """Version names of one model for each hall."""
    halls = lg.status.select("hall_id").distinct()
    return halls.select("hall_id", M.version("elo", F.lit(lg.rounds.count()), F.to_json(F.struct(F.col("hall_id").alias("hall")))).alias("model_version"))


LOGGED = PREDICTED + "SELECT match_id, model, CASE WHEN round(p_win, 9) = round(greatest(p_win, p_draw, p_loss), 9) THEN 'a' WHEN round(p_draw, 9) = round(greatest(p_win, p_draw, p_loss), 9) THEN 'draw' ELSE 'b' END AS predicted, round(greatest(p_win, p_draw, p_loss), 8) AS probability FROM preds"


@query("mdl_14", LOGGED)
def mdl_14(lg):
    """The log of the stand-in predictions of every board; ties as in prediction_log."""
    return M.prediction_log(predictions(lg)).withColumn("probability", F.round("probability", 8))


@query("mdl_14_all", LOGGED)
def mdl_14_all(lg):
    """As mdl_14."""
    return mdl_14(lg)


def trained(lg):
    """A registry that has been trained on all rounds but the last, has logged that one, and has been trained on all; once in
    an application and table folder."""
    from leaguelens.sources.round_files import shared_folder

    key = (lg.spark.sparkContext.applicationId, lg.sf_dir, "registry")
    if key not in _KEPT:
        b, r = written(boards(lg)), G.Registry(lg.spark, shared_folder(lg.spark, "registry"))
        last = b.agg(F.max("seq")).first()[0]
        r.retrain(b.where(F.col("seq") < F.lit(last)))
        r.log(b.where(F.col("seq") == F.lit(last)))
        r.retrain(b)
        _KEPT[key] = b, r
    return _KEPT[key]


@query("mdl_9")
def mdl_9(lg):
    """The exported vector of every player, by model version."""
    return trained(lg)[1].vectors()


@query("mdl_13_registry")
def mdl_13_registry(lg):
    """The stored models of both cycles."""
    return trained(lg)[1].models().select("model_version", "family", "name", "metrics", "trained_boards", "trained_rounds", "is_champion")


@query("mdl_14_champion")
def mdl_14_champion(lg):
    """What the champion said of the last round before it was trained on it."""
    return trained(lg)[1].predictions()


@query("rep_11_scorecard")
def rep_11_scorecard(lg):
    """How often the logged champions were right."""
    b, r = trained(lg)
    return G.scorecard(r.predictions(), b)


@query("mdl_18")
def mdl_18(lg):
    """Every two players who have met, meeting again in the next round: the champion's probabilities beside the baseline's."""
    from leaguelens.operators.families import family

    b, r = trained(lg)
    best = r.champion()
    again = X.hypothetical(met_pairs(lg), X.latest_sides(features(lg)), next_round(lg))
    one = lambda df, name: df.select("player_a", "player_b", *(F.col(c).alias(f"{name}_{c}") for c in ("p_win", "p_draw", "p_loss")))
    base = one(M.baseline(again, M.draw_rate(b)), BASE)
    if best.version is None:  # too little to train on
        return base.withColumn("model_version", F.lit(None).cast("string"))
    said = one(family(best.family).predict(again, best.model, ["player_a", "player_b"]), "champion")
    return base.join(said, ["player_a", "player_b"]).withColumn("model_version", F.lit(best.version))


# Sides by the stand-in ratings, which SQL can repeat: as each player stands after the last board.
TRUST = """, lt AS (SELECT player_id, rating_deviation AS rd FROM ratings QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY seq DESC) = 1),
 cb AS (SELECT player_id, count(*) AS career FROM played GROUP BY 1),
 oh AS (SELECT player_id, max(n) AS n FROM (SELECT player_id, opp_hall_id, count(*) AS n FROM played GROUP BY 1, 2) GROUP BY 1),
 ql AS (SELECT p.player_id, avg(r.rating_value) - 1000 AS bias FROM played p JOIN ratings r ON r.player_id = p.opp_player_id AND r.seq = p.seq GROUP BY 1),
 sw AS (SELECT player_id, stddev_pop(rating_value) AS swing FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY seq DESC) AS n FROM ratings) WHERE n <= 5 GROUP BY 1),
 tr AS (SELECT lt.player_id, rd, career, oh.n * 1.0 / career AS insularity, round(bias, 9) AS bias, round(swing, 9) AS swing FROM lt JOIN cb USING (player_id) JOIN oh USING (player_id) JOIN ql USING (player_id) JOIN sw USING (player_id))
"""


def trust(lg):
    last = lg.ratings.groupBy("player_id").agg(F.max_by("rating_deviation", "seq").alias("rd"))
    met = lg.played.groupBy("player_id", "opp_hall_id").agg(F.count("*").alias("n")).groupBy("player_id").agg((F.max("n") / F.sum("n")).alias("insularity"), F.sum("n").alias("career"))
    theirs = lg.ratings.select(F.col("player_id").alias("opp_player_id"), "seq", "rating_value")
    bias = lg.played.join(theirs, ["opp_player_id", "seq"]).groupBy("player_id").agg(F.round(F.avg("rating_value") - 1000, 9).alias("bias"))
    n = F.row_number().over(Window.partitionBy("player_id").orderBy(F.col("seq").desc()))
    swing = lg.ratings.withColumn("n", n).where("n <= 5").groupBy("player_id").agg(F.round(F.stddev_pop("rating_value"), 9).alias("swing"))
    return last.join(met, "player_id").join(bias, "player_id").join(swing, "player_id")


@query(
    "mdl_16",
    TRUST
    + """SELECT player_id, score, CASE WHEN score >= 80 THEN 'High' WHEN score >= 55 THEN 'Medium' ELSE 'Low' END AS tier, flags FROM (SELECT player_id,
   CAST(greatest(0, 100 - CASE WHEN rd > 250 THEN 30 WHEN rd > 150 THEN 15 ELSE 0 END - CASE WHEN career < 3 THEN 25 WHEN career < 8 THEN 10 ELSE 0 END - CASE WHEN insularity > 0.75 THEN 20 WHEN insularity > 0.5 THEN 10 ELSE 0 END - CASE WHEN abs(bias) > 150 THEN 15 ELSE 0 END - CASE WHEN swing > 100 THEN 10 ELSE 0 END) AS INTEGER) AS score,
   concat_ws('; ', CASE WHEN rd > 250 THEN 'high rating uncertainty' WHEN rd > 150 THEN 'moderate rating uncertainty' END, CASE WHEN career < 3 THEN 'almost no history' WHEN career < 8 THEN 'limited history' END, CASE WHEN insularity > 0.75 THEN 'mostly one hall' WHEN insularity > 0.5 THEN 'somewhat insular' END, CASE WHEN bias > 150 THEN 'stronger opponents than average' WHEN bias < -150 THEN 'weaker opponents than average' END, CASE WHEN swing > 100 THEN 'rating has swung' END) AS flags FROM tr)""",
)
def mdl_16(lg):
    """Reliability of every player by the stand-in ratings."""
    r = trust(lg).select("player_id", M.reliability("rd", "career", "insularity", "bias", "swing").alias("r"))
    return r.select("player_id", "r.score", "r.tier", F.concat_ws("; ", "r.flags").alias("flags"))


@query("mdl_16_sides")
def mdl_16_sides(lg):
    """Reliability of every side of every board by the computed ratings."""
    return features(lg).select("match_id", "player_id", M.reliability("rd", "career_boards", "insularity", "opp_quality_bias", "stability").alias("r")).select("match_id", "player_id", "r.*")


@query("mdl_17_latest", TRUST + "SELECT player_id, concat_ws('; ', CASE WHEN rd > 200 THEN 'rating unsure' END, CASE WHEN career < 5 THEN 'few boards' END, CASE WHEN insularity > 0.6 THEN 'narrow schedule' END) AS note FROM tr")
def mdl_17_latest(lg):
    """The short note on every player by the stand-in ratings."""
    return trust(lg).select("player_id", F.concat_ws("; ", M.reliability_note("rd", "career", "insularity")).alias("note"))


# The baseline over the stand-in ratings before each round.
@query(
    "mdl_1_elo",
    PAIRED
    + """, dr AS (SELECT avg(CASE WHEN outcome = 0.5 THEN 1.0 ELSE 0.0 END) AS d FROM played WHERE side = 0),
 be AS (SELECT a.match_id, 1 / (1 + exp(-(a.rating - b.rating) / 173.7178 / sqrt(1 + 3 * (a.rd * a.rd + b.rd * b.rd) / (173.7178 * 173.7178) / (pi() * pi())))) AS e FROM en a JOIN en b ON a.match_id = b.match_id AND a.player_id < b.player_id)
 SELECT match_id, round(greatest(0, least(1 - d, e - d / 2)), 8) AS p_win, round(d, 8) AS p_draw, round(1 - d - greatest(0, least(1 - d, e - d / 2)), 8) AS p_loss FROM be CROSS JOIN dr""",
)
def mdl_1_elo(lg):
    p = paired(lg).where(F.col("player_id") < F.col("opp_player_id"))
    b = p.select("match_id", F.col("outcome").alias("outcome_a"), F.struct("rating", "rd").alias("a"), F.struct(F.col("opp_rating").alias("rating"), F.col("opp_rd").alias("rd")).alias("b"))
    return M.baseline(b, M.draw_rate(b)).select("match_id", *(F.round(c, 8).alias(c) for c in ("p_win", "p_draw", "p_loss")))


@query("mdl_15")
def mdl_15(lg):
    return M.top_factors(X.vectors(boards(lg), 6.0))


@query("mdl_17")
def mdl_17(lg):
    return features(lg).select("match_id", "player_id", M.reliability_note("rd", "career_boards", "insularity").alias("note"))
