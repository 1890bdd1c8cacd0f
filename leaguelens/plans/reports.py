"""Reports over the league, on the stand-in ratings that SQL can repeat."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from leaguelens.operators import reports as P
from leaguelens.operators import standings
from leaguelens.plans.base import query

RANKING = """, lr AS (SELECT player_id, rating_value, rating_deviation FROM ratings WHERE year = 1998 AND round_order <= 3 QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY seq DESC) = 1),
 nm AS (SELECT player_id, name FROM names QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY (first_seen_year <= 1998 AND last_seen_year >= 1998) DESC, last_seen_year DESC, name DESC) = 1),
 lp AS (SELECT player_id, year || ' ' || round_label AS label FROM (SELECT player_id, max(seq) AS seq FROM sides WHERE player_id <> 'WLKOVR' AND year = 1998 AND round_order <= 3 GROUP BY 1) JOIN rounds USING (seq)),
 ranking AS (SELECT lr.player_id, rating_value, rating_deviation, s.hall_id, s.capped, nm.name, lp.label, CAST(floor(rating_value + 0.5) AS BIGINT) AS elo, row_number() OVER (ORDER BY rating_value DESC, nm.name, s.hall_id) AS position FROM lr JOIN status s ON s.player_id = lr.player_id AND s.year = 1998 JOIN nm ON nm.player_id = lr.player_id LEFT JOIN lp ON lp.player_id = lr.player_id)
"""
HALL = """, he AS (SELECT year, round_order, seq, hall_id, round(avg(rating_value), 6) AS hall_elo FROM (SELECT *, row_number() OVER (PARTITION BY seq, hall_id ORDER BY rating_value DESC, player_id) AS n FROM ratings) WHERE n <= 5 GROUP BY 1, 2, 3, 4),
 hk AS (SELECT *, CAST(rank() OVER (PARTITION BY seq ORDER BY hall_elo DESC) AS INTEGER) AS rank FROM he),
 tally AS (SELECT year, round_order, hall_id, opp_hall_id, count(*) AS boards, sum(outcome) AS points_for, sum(opp_outcome) AS points_against FROM sides WHERE player_id <> 'WLKOVR' AND hall_id <> opp_hall_id AND opp_hall_id <> -1 GROUP BY 1, 2, 3, 4),
 mo AS (SELECT * FROM tally QUALIFY row_number() OVER (PARTITION BY year, round_order, hall_id ORDER BY boards DESC, points_for DESC, opp_hall_id) = 1),
 hrs AS (SELECT hk.year, hk.round_order, hk.hall_id, hk.seq, hall_elo, rank, CAST(rank - lag(rank) OVER (PARTITION BY hk.hall_id ORDER BY hk.seq) AS INTEGER) AS rank_change, opp_hall_id, points_for, points_against FROM hk LEFT JOIN mo ON mo.year = hk.year AND mo.round_order = hk.round_order AND mo.hall_id = hk.hall_id)
"""
PROFILE = """, rk AS (SELECT player_id, seq, year, round_order, CAST(floor(rating_value + 0.5) AS BIGINT) AS elo, CAST(rank() OVER (PARTITION BY seq ORDER BY rating_value DESC) AS INTEGER) AS rank FROM ratings),
 rc AS (SELECT *, elo - lag(elo) OVER w AS elo_change, rank - lag(rank) OVER w AS rank_change FROM rk WINDOW w AS (PARTITION BY player_id ORDER BY seq)),
 pro AS (SELECT rc.*, p.seat, p.opp_player_id, p.opp_hall_id, CASE WHEN p.participation_type = 'TIMEOUT' THEN 'TIMEOUT' ELSE CAST(CAST(score AS BIGINT) AS VARCHAR) END || '-' || CASE WHEN opp_participation_type = 'TIMEOUT' THEN 'TIMEOUT' ELSE CAST(CAST(opp_score AS BIGINT) AS VARCHAR) END AS scores, CASE outcome WHEN 1 THEN 'W' WHEN 0.5 THEN 'D' ELSE 'L' END AS result FROM rc JOIN played p ON p.player_id = rc.player_id AND p.seq = rc.seq)
"""


def ranking(lg):
    return P.player_ranking(lg.ratings, lg.status, lg.names, lg.sides, lg.rounds, 1998, 3)


@query("rep_1", RANKING + "SELECT * FROM ranking")
def rep_1(lg):
    return ranking(lg)


@query("rep_2", RANKING + "SELECT hall_id, round(avg(CASE WHEN n <= 5 THEN rating_value END), 6) AS hall_elo, count(*) FILTER (capped) AS capped, count(*) AS players FROM (SELECT *, row_number() OVER (PARTITION BY hall_id ORDER BY rating_value DESC, player_id) AS n FROM ranking) GROUP BY 1")
def rep_2(lg):
    return P.hall_ranking(ranking(lg))


@query("rep_3", PROFILE + "SELECT * FROM pro")
def rep_3(lg):
    return P.player_rounds(lg.played, lg.ratings)


YEARS = ", fy AS (SELECT player_id, year, max_by(rating_value, seq) AS rating_value FROM ratings GROUP BY 1, 2), oy AS (SELECT player_id, year, round(avg(seat), 6) AS avg_seat, sum(outcome) AS won, sum(1 - outcome) AS lost FROM sides WHERE player_id <> 'WLKOVR' GROUP BY 1, 2)\n"


@query("rep_4", YEARS + "SELECT oy.*, rating_value FROM oy LEFT JOIN fy ON fy.player_id = oy.player_id AND fy.year = oy.year")
def rep_4(lg):
    return P.player_years(lg.sides, lg.ratings)


@query(
    "rep_5",
    PROFILE + "SELECT coalesce(a.seq, b.seq) AS seq, a.elo AS elo_a, a.rank AS rank_a, a.result AS result_a, b.elo AS elo_b, b.rank AS rank_b, b.result AS result_b FROM (SELECT * FROM pro WHERE player_id = '000000007') a FULL OUTER JOIN (SELECT * FROM pro WHERE player_id = '000000040') b ON a.seq = b.seq",
)
def rep_5(lg):
    return P.comparison(P.player_rounds(lg.played, lg.ratings), "000000007", "000000040")


@query("rep_6", HALL + "SELECT * FROM hrs")
def rep_6(lg):
    return P.hall_rounds(lg.sides, lg.ratings)


@query(
    "rep_7",
    HALL + "SELECT p.hall_id, p.year, p.points, p.avg_seat, h.hall_elo, h.rank FROM (SELECT hall_id, year, sum(outcome) AS points, round(avg(seat), 6) AS avg_seat FROM sides WHERE player_id <> 'WLKOVR' GROUP BY 1, 2) p LEFT JOIN (SELECT * FROM hk QUALIFY row_number() OVER (PARTITION BY hall_id, year ORDER BY seq DESC) = 1) h ON h.hall_id = p.hall_id AND h.year = p.year",
)
def rep_7(lg):
    return P.hall_years(lg.sides, lg.ratings)


@query(
    "rep_8",
    RANKING
    + """, al AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hall_id, capped ORDER BY rating_value DESC, player_id) AS c FROM ranking) WHERE NOT capped OR c <= 2),
 t5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hall_id ORDER BY rating_value DESC, player_id) AS n FROM al) WHERE n <= 5),
 tm AS (SELECT hall_id, list(elo ORDER BY n) AS team FROM t5 GROUP BY 1 HAVING count(*) = 5),
 five AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
 perms AS (SELECT a.i AS p1, b.i AS p2, c.i AS p3, d.i AS p4, e.i AS p5 FROM five a, five b, five c, five d, five e WHERE a.i <> b.i AND a.i <> c.i AND a.i <> d.i AND a.i <> e.i AND b.i <> c.i AND b.i <> d.i AND b.i <> e.i AND c.i <> d.i AND c.i <> e.i AND d.i <> e.i),
 met AS (SELECT DISTINCT hall_id, opp_hall_id FROM played)
 SELECT hall_id, opp_hall_id, avg(CASE WHEN s1 + s2 + s3 + s4 + s5 > 2.5 THEN 1.0 ELSE 0.0 END) AS win_share FROM (SELECT m.hall_id, m.opp_hall_id, """
    + ", ".join(f"CASE WHEN x.team[{k}] > y.team[p{k}] THEN 1.0 WHEN x.team[{k}] = y.team[p{k}] THEN 0.5 ELSE 0.0 END AS s{k}" for k in range(1, 6))
    + " FROM met m JOIN tm x ON x.hall_id = m.hall_id JOIN tm y ON y.hall_id = m.opp_hall_id CROSS JOIN perms) GROUP BY 1, 2",
)
def rep_8(lg):
    """Win shares of all pairs of halls that have met."""
    met = lg.played.select("hall_id", "opp_hall_id").distinct()
    return P.win_probability(met, P.teams(ranking(lg)))


@query(
    "rep_9",
    HALL + "SELECT m.year, m.round_order, m.hall_a, m.hall_b, m.points_a, m.points_b, x.hall_elo AS elo_a, y.hall_elo AS elo_b FROM (SELECT year, round_order, least(hall_id, opp_hall_id) AS hall_a, greatest(hall_id, opp_hall_id) AS hall_b, sum(CASE WHEN hall_id < opp_hall_id THEN outcome ELSE 0 END) AS points_a, sum(CASE WHEN hall_id < opp_hall_id THEN 0 ELSE outcome END) AS points_b FROM played GROUP BY 1, 2, 3, 4) m LEFT JOIN he x ON x.year = m.year AND x.round_order = m.round_order AND x.hall_id = m.hall_a LEFT JOIN he y ON y.year = m.year AND y.round_order = m.round_order AND y.hall_id = m.hall_b",
)
def rep_9(lg):
    """The matchups of every round with both halls' Elos."""
    keys = ["year", "round_order"]
    elo = standings.hall_elo(lg.ratings, [*keys, "hall_id"]).withColumn("hall_elo", F.round("hall_elo", 6))
    m = standings.matchups(lg.sides).where("hall_b is not null")
    side = lambda s: elo.select(*keys, F.col("hall_id").alias(f"hall_{s}"), F.col("hall_elo").alias(f"elo_{s}"))
    return m.join(side("a"), [*keys, "hall_a"], "left").join(side("b"), [*keys, "hall_b"], "left").select(*keys, "hall_a", "hall_b", "points_a", "points_b", "elo_a", "elo_b")


@query("rep_9_halls", "SELECT p.year, p.round_order, p.hall_id, p.player_id, p.seat, p.outcome, p.opp_player_id, p.opp_hall_id, r.rating_value, r.rating_value - lag(r.rating_value) OVER (PARTITION BY p.player_id ORDER BY p.seq) AS delta FROM played p JOIN ratings r ON r.player_id = p.player_id AND r.seq = p.seq")
def rep_9_halls(lg):
    """The players of every hall in every round with the change of their rating since their last round."""
    j = lg.played.join(lg.ratings.select("player_id", "seq", "rating_value"), ["player_id", "seq"])
    delta = F.col("rating_value") - F.lag("rating_value").over(Window.partitionBy("player_id").orderBy("seq"))
    return j.withColumn("delta", delta).select("year", "round_order", "hall_id", "player_id", "seat", "outcome", "opp_player_id", "opp_hall_id", "rating_value", "delta")


@query("rep_6_roster", "SELECT year, round_order, hall_id, player_id, rating_value, CAST(rank() OVER (PARTITION BY seq, hall_id ORDER BY rating_value DESC) AS INTEGER) AS hall_rank, CAST(rank() OVER (PARTITION BY seq ORDER BY rating_value DESC) AS INTEGER) AS global_rank FROM ratings")
def rep_6_roster(lg):
    """Every hall's players of a round with their rank in the hall and in the league."""
    best = F.col("rating_value").desc()
    rank = lambda *k: F.rank().over(Window.partitionBy(*k).orderBy(best))
    return lg.ratings.select("year", "round_order", "hall_id", "player_id", "rating_value", rank("seq", "hall_id").alias("hall_rank"), rank("seq").alias("global_rank"))


def computed(lg):
    """The computed ratings in the columns of the stand-in ones."""
    from leaguelens.plans.ratings import trajectory

    t = trajectory(lg).select("player_id", "seq", F.col("rating").alias("rating_value"), F.col("rd").alias("rating_deviation"), "volatility")
    return lg.played.select("player_id", "hall_id", "year", "round_order", "seq", "round_id").join(t, ["player_id", "seq"]).select(*lg.ratings.columns)


@query("rep_1_computed")
def rep_1_computed(lg):
    """The player ranking after the last round, by the computed ratings."""
    last = lg.rounds.agg(F.max_by(F.struct("year", "round_order"), "seq").alias("r")).first().r
    return P.player_ranking(computed(lg), lg.status, lg.names, lg.sides, lg.rounds, last.year, last.round_order)


@query("rep_6_computed")
def rep_6_computed(lg):
    """Hall profiles of every round by the computed ratings."""
    return P.hall_rounds(lg.sides, computed(lg))


@query("rep_10", "SELECT * FROM (PIVOT (SELECT player_id, 'r' || seq AS column_name, outcome FROM played) ON column_name USING max(outcome) GROUP BY player_id)")
def rep_10(lg):
    """Outcomes with a column for each round, however many there are."""
    return P.wide_by_round(lg.played, "player_id", "outcome")


@query("rep_10_all", "SELECT * FROM (PIVOT (SELECT p.player_id, p.seq, CAST(p.seat AS DOUBLE) AS seat, p.outcome, r.rating_value AS elo FROM played p JOIN ratings r ON r.player_id = p.player_id AND r.seq = p.seq) ON seq USING max(seat) AS seat, max(elo) AS elo, max(outcome) AS outcome GROUP BY player_id)")
def rep_10_all(lg):
    """Seat, rating and outcome of every player with columns for every round, however many there are."""
    rows = lg.played.join(lg.ratings.select("player_id", "seq", F.col("rating_value").alias("elo")), ["player_id", "seq"])
    rows = rows.withColumn("seat", F.col("seat").cast("double"))
    return P.wide_rounds(rows, "player_id", ["seat", "elo", "outcome"])
