"""Lineups of the league's halls; win probabilities come from the stand-in ratings."""

from pyspark.sql import functions as F

from leaguelens.operators import lineups as L
from leaguelens.operators import setops
from leaguelens.plans.aggregates import PREDICTED, predictions
from leaguelens.plans.base import query

LAST = "(SELECT max(seq) FROM rounds)"
DIST = """, sw AS (SELECT hall_id, player_id, max(seq) AS last_seq, """ + ", ".join(f"coalesce(sum(CASE WHEN seat = {s} THEN exp(-ln(2.0) / 10 * ({LAST} - seq)) END), 0) + 0.02 AS w{s}" for s in range(1, 6)) + """ FROM played GROUP BY 1, 2),
 sd AS (SELECT hall_id, player_id, last_seq, [w1 / t, w2 / t, w3 / t, w4 / t, w5 / t] AS probs FROM (SELECT *, w1 + w2 + w3 + w4 + w5 AS t FROM sw)),
 ro AS (SELECT *, CAST(row_number() OVER (PARTITION BY hall_id ORDER BY last_seq DESC, player_id) AS INTEGER) AS place FROM sd QUALIFY place <= 5)
"""


def now(lg) -> int:
    """The last round."""
    return lg.rounds.agg(F.max("seq")).first()[0] or 0


def roster(lg):
    return L.expected_roster(L.seat_distribution(lg.played, now(lg)))


@query("lin_1", DIST + "SELECT hall_id, player_id, " + ", ".join(f"round(probs[{s}], 8) AS p{s}" for s in range(1, 6)) + " FROM sd")
def lin_1(lg):
    d = L.seat_distribution(lg.played, now(lg))
    return d.select("hall_id", "player_id", *(F.round(F.col("probs")[s - 1], 8).alias(f"p{s}") for s in range(1, 6)))


@query("lin_2", DIST + "SELECT hall_id, player_id, place FROM ro")
def lin_2(lg):
    return roster(lg).select("hall_id", "player_id", "place")


PERMS = """, five AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
 perms AS (SELECT a.i AS a, b.i AS b, c.i AS c, d.i AS d, e.i AS e FROM five a, five b, five c, five d, five e WHERE a.i <> b.i AND a.i <> c.i AND a.i <> d.i AND a.i <> e.i AND b.i <> c.i AND b.i <> d.i AND b.i <> e.i AND c.i <> d.i AND c.i <> e.i AND d.i <> e.i),
 tm AS (SELECT hall_id, list(player_id ORDER BY place) AS ids, list(probs ORDER BY place) AS pr FROM ro GROUP BY 1 HAVING count(*) = 5),
 ow AS (SELECT hall_id, ids[a] || ',' || ids[b] || ',' || ids[c] || ',' || ids[d] || ',' || ids[e] AS ordering, pr[a][1] * pr[b][2] * pr[c][3] * pr[d][4] * pr[e][5] AS weight FROM tm CROSS JOIN perms)
"""


@query("lin_3", DIST + PERMS + "SELECT hall_id, CAST(row_number() OVER (PARTITION BY hall_id ORDER BY round(weight, 12) DESC, ordering) AS INTEGER) AS n, ordering, round(weight / sum(weight) OVER (PARTITION BY hall_id), 8) AS probability FROM ow QUALIFY n <= 24")
def lin_3(lg):
    return L.top_orderings(roster(lg)).select("hall_id", "n", F.concat_ws(",", "ordering").alias("ordering"), F.round("probability", 8).alias("probability"))


@query("lin_4", DIST + "SELECT hall_id, player_id, round(-list_sum(list_transform(probs, lambda p: p * ln(p) / ln(2.0))), 7) AS entropy, CASE WHEN -list_sum(list_transform(probs, lambda p: p * ln(p) / ln(2.0))) < 0.5 THEN 'fixed' WHEN -list_sum(list_transform(probs, lambda p: p * ln(p) / ln(2.0))) < 1.3 THEN 'leaning' ELSE 'variable' END AS habit FROM ro")
def lin_4(lg):
    """How fixed each expected player's seat is."""
    e = -F.aggregate(F.transform("probs", lambda p: p * F.log2(p)), F.lit(0.0), lambda s, v: s + v)
    return roster(lg).select("hall_id", "player_id", F.round(e, 7).alias("entropy"), F.when(e < 0.5, "fixed").when(e < 1.3, "leaning").otherwise("variable").alias("habit"))


def _convolved() -> str:
    """SQL of LIN-7: the distribution of the half points, board after board."""
    out = "d0 AS (SELECT DISTINCT year, round_order, hall_id, opp_hall_id, 0 AS s, CAST(1 AS DOUBLE) AS p FROM bs)"
    for k in range(1, 6):
        out += f", d{k} AS (SELECT d.year, d.round_order, d.hall_id, d.opp_hall_id, d.s + x.k AS s, sum(d.p * CASE x.k WHEN 2 THEN b.p_win WHEN 1 THEN b.p_draw ELSE 1 - b.p_win - b.p_draw END) AS p FROM d{k - 1} d JOIN bs b ON b.year = d.year AND b.round_order = d.round_order AND b.hall_id = d.hall_id AND b.opp_hall_id = d.opp_hall_id AND b.n = {k} CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) x GROUP BY ALL)"
    return out


@query(
    "lin_7",
    PREDICTED
    + ", b7 AS (SELECT s.*, coalesce(p.p_win, s.outcome) AS p_win, coalesce(p.p_draw, 0) AS p_draw, row_number() OVER m AS n, count(*) OVER (PARTITION BY s.year, s.round_order, s.hall_id, s.opp_hall_id) AS boards FROM sides s LEFT JOIN (SELECT * FROM preds WHERE model = 'elo') p USING (match_id) WHERE s.side = 0 AND s.hall_id <> -1 AND s.opp_hall_id <> -1 WINDOW m AS (PARTITION BY s.year, s.round_order, s.hall_id, s.opp_hall_id ORDER BY s.match_id)), bs AS (SELECT * FROM b7 WHERE boards = 5), "
    + _convolved()
    + " SELECT year, round_order, hall_id, opp_hall_id, round(coalesce(sum(p) FILTER (s > 5), 0), 9) AS win, round(coalesce(sum(p) FILTER (s = 5), 0), 9) AS tie, round(coalesce(sum(p) FILTER (s < 5), 0), 9) AS loss FROM d5 GROUP BY 1, 2, 3, 4",
)
def lin_7(lg):
    """Win, tie and loss of every match from its boards' probabilities."""
    p = predictions(lg).where("model = 'elo'").select("match_id", "p_win", "p_draw")
    b = lg.sides.where("side = 0 and hall_id <> -1 and opp_hall_id <> -1").join(p, "match_id", "left")
    b = b.withColumns({"p_win": F.coalesce("p_win", "outcome"), "p_draw": F.coalesce("p_draw", F.lit(0.0))})  # a walkover is sure
    m = b.groupBy("year", "round_order", "hall_id", "opp_hall_id").agg(F.collect_list(F.struct("p_win", "p_draw")).alias("boards"))  # five at most
    five = m.where(F.size("boards") == L.SEATS).withColumn("r", L.team_result(F.col("boards")))
    return five.select("year", "round_order", "hall_id", "opp_hall_id", *(F.round(f"r.{c}", 9).alias(c) for c in ("win", "tie", "loss")))


POOL = DIST + PERMS + """, lr AS (SELECT player_id, arg_max(rating_value, seq) AS rating FROM ratings GROUP BY 1),
 av AS (SELECT s.hall_id, s.player_id, lr.rating, row_number() OVER (PARTITION BY s.hall_id ORDER BY rating DESC, s.player_id) AS rn, count(*) OVER (PARTITION BY s.hall_id) AS np FROM status s JOIN lr USING (player_id) WHERE year = (SELECT max(year) FROM status)),
 po AS (SELECT hall_id, player_id, rating, rn FROM av WHERE np >= 5 AND (np <= 16 OR rn <= 12)),
 rr AS (SELECT ro.hall_id, ro.player_id, ro.place, lr.rating FROM ro JOIN lr USING (player_id)),
 mt AS (SELECT DISTINCT hall_id, opp_hall_id FROM played)
"""


def available(lg):
    """The last season's players of each hall with their stand-in ratings."""
    r = setops.latest(lg.ratings, ["player_id"], "seq", {"rating": "rating_value"})
    last = lg.status.agg(F.max("year").alias("year"))
    return lg.status.join(F.broadcast(last), "year", "left_semi").select("hall_id", "player_id").join(r, "player_id")  # one row


def rated_roster(lg):
    return roster(lg).join(setops.latest(lg.ratings, ["player_id"], "seq", {"rating": "rating_value"}), "player_id")


def met(lg):
    """All pairs of halls that have met."""
    return lg.played.select("hall_id", "opp_hall_id").distinct()


def elo(a, b):
    return F.struct(F.least(F.lit(0.9), F.greatest(F.lit(0.05), 0.475 + (a - b) / 400)).alias("p_win"), F.lit(0.05).alias("p_draw"))


@query("lin_5", POOL + "SELECT mt.hall_id, mt.opp_hall_id, a.player_id, b.player_id AS opp_player_id, CAST(s.i AS INTEGER) AS seat, round(least(0.9, greatest(0.05, 0.475 + (a.rating - b.rating) / 400)), 9) AS p_win FROM mt JOIN po a ON a.hall_id = mt.hall_id JOIN rr b ON b.hall_id = mt.opp_hall_id CROSS JOIN five s")
def lin_5(lg):
    """The pairing tensor of all pairs of halls that have met, by the stand-in ratings."""
    t = L.tensor(met(lg), L.pool(available(lg)), rated_roster(lg), ["rating"])
    return t.select("hall_id", "opp_hall_id", "player_id", "opp_player_id", "seat", F.round(elo(F.col("a.rating"), F.col("b.rating"))["p_win"], 9).alias("p_win"))


def model_tensor(lg):
    """The pairing tensor with the fitted model's and the baseline's probabilities over the computed ratings."""
    from leaguelens.operators import features as X
    from leaguelens.operators import models as M
    from leaguelens.plans.features import features, next_round
    from leaguelens.plans.models import boards

    sides = X.latest_sides(features(lg)).select("s.*").drop("hall_id", "outcome", "participation_type")
    columns = ["player_id", "hall_id", *X.SIDE]
    ours = L.pool(available(lg).drop("rating").join(sides, "player_id"))
    theirs = roster(lg).select("hall_id", "player_id").join(sides, "player_id")
    t = L.tensor(met(lg), ours, theirs, columns).withColumns({"round_order": F.lit(next_round(lg)), "max_score_norm": F.lit(37.0)})
    b = boards(lg)
    plain = M.baseline(t, M.draw_rate(b)).withColumnsRenamed({c: f"baseline_{c}" for c in ("p_win", "p_draw", "p_loss")})
    return M.predict_logistic(plain, M.fit_logistic(b, 6.0, 1.0)), ours, theirs


@query("lin_5_model")
def lin_5_model(lg):
    return model_tensor(lg)[0].select("hall_id", "opp_hall_id", "player_id", "opp_player_id", "seat", "p_win", "p_draw", "p_loss", "baseline_p_win", "baseline_p_draw", "baseline_p_loss")


@query("lin_6", POOL + ", sub AS (SELECT a.hall_id, a.player_id AS a, b.player_id AS b, c.player_id AS c, d.player_id AS d, e.player_id AS e FROM po a JOIN po b ON b.hall_id = a.hall_id AND b.player_id > a.player_id JOIN po c ON c.hall_id = a.hall_id AND c.player_id > b.player_id JOIN po d ON d.hall_id = a.hall_id AND d.player_id > c.player_id JOIN po e ON e.hall_id = a.hall_id AND e.player_id > d.player_id), "
       "ls AS (SELECT hall_id, [a, b, c, d, e] AS ids FROM sub) SELECT hall_id, ids[a] || ',' || ids[b] || ',' || ids[c] || ',' || ids[d] || ',' || ids[e] AS lineup FROM ls CROSS JOIN perms")
def lin_6(lg):
    """Every order of every five of each hall's pool."""
    return L.candidates(available(lg)).select("hall_id", F.concat_ws(",", "lineup").alias("lineup"))


def searched(lg):
    theirs = rated_roster(lg)
    return L.search(L.cells(met(lg), L.pool(available(lg)), theirs, L.top_orderings(roster(lg)), probability=elo))


@query("lin_8")
def lin_8(lg):
    """Best and safest lineups, out of the whole pool, for all pairs of halls that have met."""
    return searched(lg).select("hall_id", "opp_hall_id", "n_candidates", F.col("best.win").alias("expected_win"), F.col("best.lineup").alias("best_lineup"), F.col("safe.worst").alias("safe_win"), F.col("safe.lineup").alias("safe_lineup"))


@query("lin_8_model")
def lin_8_model(lg):
    """As lin_8, with the fitted model's probabilities over the computed ratings."""
    t, ours, theirs = model_tensor(lg)
    r = L.search(L.cells(met(lg), ours, theirs, L.top_orderings(roster(lg)), chances=t))
    return r.select("hall_id", "opp_hall_id", "n_candidates", F.col("best.win").alias("expected_win"), F.col("best.lineup").alias("best_lineup"), F.col("safe.worst").alias("safe_win"), F.col("safe.lineup").alias("safe_lineup"))


@query("lin_9")
def lin_9(lg):
    """The fixed patterns and the free optimum of all pairs of halls that have met."""
    return searched(lg).select("hall_id", "opp_hall_id", F.explode("patterns").alias("p")).select("hall_id", "opp_hall_id", "p.*")


@query("lin_10", POOL + """, tp AS (SELECT hall_id, string_split(ordering, ',') AS o FROM (SELECT *, row_number() OVER (PARTITION BY hall_id ORDER BY round(weight, 12) DESC, ordering) AS n FROM ow) WHERE n = 1),
 ns AS (SELECT mt.hall_id, mt.opp_hall_id, po.rn AS seat, least(0.9, greatest(0.05, 0.475 + (po.rating - lr.rating) / 400)) AS p FROM mt JOIN po ON po.hall_id = mt.hall_id AND po.rn <= 5 JOIN tp ON tp.hall_id = mt.opp_hall_id JOIN lr ON lr.player_id = tp.o[po.rn]),
 nw AS (SELECT hall_id, opp_hall_id, min(p) AS low, arg_min(seat, (p, seat)) AS worst FROM ns GROUP BY 1, 2)
 SELECT hall_id, opp_hall_id, CAST(CASE WHEN low < 0.5 THEN worst END AS INTEGER) AS sacrifice, round(low, 9) AS sacrifice_win, coalesce((SELECT string_agg(CAST(seat AS VARCHAR), ',' ORDER BY seat) FROM ns WHERE ns.hall_id = nw.hall_id AND ns.opp_hall_id = nw.opp_hall_id AND p >= 0.5 AND seat <> worst), '') AS favoured FROM nw""")
def lin_10(lg):
    """What there is to say of each hall's strongest five, in order, against the opponent's likeliest order."""
    five = L.pool(available(lg)).groupBy("hall_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("rating")).alias("_r"), "player_id", "rating"))), 1, L.SEATS).alias("t"))
    top = L.top_orderings(roster(lg), 1).select(F.col("hall_id").alias("opp_hall_id"), F.posexplode("ordering").alias("seat", "player_id"))
    r = setops.latest(lg.ratings, ["player_id"], "seq", {"rating": "rating_value"})
    theirs = top.join(r, "player_id").groupBy("opp_hall_id").agg(F.array_sort(F.collect_list(F.struct("seat", "rating"))).alias("o"))
    both = met(lg).join(five, "hall_id").join(theirs, "opp_hall_id")
    p = F.zip_with("t", "o", lambda a, b: elo(a["rating"], b["rating"])["p_win"])
    x = both.select("hall_id", "opp_hall_id", L.explained(p).alias("x"))
    return x.select("hall_id", "opp_hall_id", "x.sacrifice", F.round("x.sacrifice_win", 9).alias("sacrifice_win"), F.concat_ws(",", F.transform("x.favoured", lambda i: i.cast("string"))).alias("favoured"))


@query("lin_10_best")
def lin_10_best(lg):
    """The same of each best lineup, whether it is fragile, and the reliability flags of its players."""
    from leaguelens.operators import models as M
    from leaguelens.plans.models import trust

    told = searched(lg).select("hall_id", "opp_hall_id", "best", "safe", L.explained(F.col("boards")).alias("x"))
    s = told.select("hall_id", "opp_hall_id", "best", "safe", "x", F.posexplode("best.lineup").alias("seat", "player_id"))
    flags = trust(lg).select("player_id", M.reliability("rd", "career", "insularity", "bias", "swing")["flags"].alias("flags"))
    j = s.join(flags, "player_id", "left")
    g = j.groupBy("hall_id", "opp_hall_id").agg(F.first("best").alias("best"), F.first("safe").alias("safe"), F.first("x").alias("x"), F.array_sort(F.collect_list(F.struct("seat", "player_id", "flags"))).alias("reliability"))
    return g.select("hall_id", "opp_hall_id", "x.*", (F.col("best.win") - F.col("best.worst") > L.FRAGILE).alias("fragile"), F.col("best.worst").alias("worst_win"), F.col("safe.worst").alias("safe_win"), "reliability")


@query("agg_18_reactivity", ", mp AS (SELECT hall_id, opp_hall_id, seq, string_agg(seat || ':' || player_id, ',' ORDER BY seat, player_id) AS m FROM played WHERE seat IS NOT NULL GROUP BY 1, 2, 3), lm AS (SELECT *, lag(m) OVER (PARTITION BY hall_id, opp_hall_id ORDER BY seq) AS b FROM mp) SELECT hall_id, round(avg(CASE WHEN b IS NULL THEN NULL WHEN m <> b THEN 1.0 ELSE 0.0 END), 9) AS reactivity, count(b) AS rematches FROM lm GROUP BY 1")
def agg_18_reactivity(lg):
    return L.reactivity(lg.played).withColumn("reactivity", F.round("reactivity", 9))


@query("lin_4_captain", DIST + ", mp AS (SELECT hall_id, opp_hall_id, seq, string_agg(seat || ':' || player_id, ',' ORDER BY seat, player_id) AS m FROM played WHERE seat IS NOT NULL GROUP BY 1, 2, 3), lm AS (SELECT *, lag(m) OVER (PARTITION BY hall_id, opp_hall_id ORDER BY seq) AS b FROM mp), "
       "ra AS (SELECT hall_id, round(avg(CASE WHEN b IS NULL THEN NULL WHEN m <> b THEN 1.0 ELSE 0.0 END), 9) AS reactivity, count(b) AS rematches FROM lm GROUP BY 1), ee AS (SELECT hall_id, round(avg(-list_sum(list_transform(probs, lambda p: p * ln(p) / ln(2.0)))), 7) AS entropy FROM ro GROUP BY 1) "
       "SELECT hall_id, entropy, CASE WHEN entropy < 0.5 THEN 'fixed' WHEN entropy < 1.3 THEN 'leaning' ELSE 'variable' END AS habit, reactivity, rematches FROM ee LEFT JOIN ra USING (hall_id)")
def lin_4_captain(lg):
    """How fixed a hall's seats are on the whole, and how often they change for an opponent met again."""
    e = -F.aggregate(F.transform("probs", lambda p: p * F.log2(p)), F.lit(0.0), lambda s, v: s + v)
    m = roster(lg).groupBy("hall_id").agg(F.round(F.avg(e), 7).alias("entropy"))
    m = m.withColumn("habit", F.when(F.col("entropy") < 0.5, "fixed").when(F.col("entropy") < 1.3, "leaning").otherwise("variable"))
    return m.join(agg_18_reactivity(lg), "hall_id", "left")
