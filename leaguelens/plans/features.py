"""Matchup features of the league."""

from pyspark.sql import functions as F

from leaguelens.operators import features as X
from leaguelens.operators.checkpoints import written
from leaguelens.plans.ratings import sides, trajectory
from leaguelens.plans.base import query

_KEPT: dict[tuple, object] = {}


def features(lg):
    """Computed once in an application and table folder, like the trajectory it is made from."""
    key = (lg.spark.sparkContext.applicationId, lg.sf_dir)
    if key not in _KEPT:
        _KEPT[key] = written(X.side_features(sides(lg), trajectory(lg, 1)))
    return _KEPT[key]


@query("fea_1", "SELECT match_id, seq, least(player_id0, player_id1) AS player_a, greatest(player_id0, player_id1) AS player_b, CASE WHEN player_id0 < player_id1 THEN outcome0 ELSE outcome1 END AS outcome_a, 37.0 AS max_score_norm FROM boards WHERE rated")
def fea_1(lg):
    b = X.boards(features(lg))
    return b.select("match_id", "seq", F.col("a.player_id").alias("player_a"), F.col("b.player_id").alias("player_b"), "outcome_a", "max_score_norm")


@query("fea_2", ", w AS (SELECT player_id, seq, count(*) FILTER (NOT rated) OVER (PARTITION BY player_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS walkovers_received, rated, match_id FROM sides WHERE player_id <> 'WLKOVR') SELECT match_id, player_id, walkovers_received FROM w WHERE rated")
def fea_2(lg):
    return features(lg).select("match_id", "player_id", "walkovers_received")


@query(
    "fea_2_counts",
    """SELECT match_id, player_id, count(*) OVER p AS career_boards, count(*) OVER y AS season_boards, round((coalesce(sum(outcome) OVER h, 0) + 1.5) / (count(*) OVER h + 3.0), 9) AS vs_hall_rate FROM played
    WINDOW p AS (PARTITION BY player_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), y AS (PARTITION BY player_id, year ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), h AS (PARTITION BY player_id, opp_hall_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def fea_2_counts(lg):
    """The features that don't depend on ratings."""
    return features(lg).select("match_id", "player_id", "career_boards", "season_boards", F.round("vs_hall_rate", 9).alias("vs_hall_rate"))


@query("fea_4")
def fea_4(lg):
    return X.boards(features(lg)).select("match_id", X.effective("a", 6.0).alias("effective_a"), X.effective("b", 6.0).alias("effective_b"))


@query("fea_5")
def fea_5(lg):
    return X.vectors(X.boards(features(lg)), 6.0).select("match_id", "anti", "sym")


@query("fea_6")
def fea_6(lg):
    """Vectors of swapped boards, one side's seat set to 1."""
    return X.vectors(X.with_seat(X.swapped(X.boards(features(lg))), "a", F.lit(1)), 6.0).select("match_id", "anti", "sym")


def met_pairs(lg):
    """player_a, player_b: every two players who have met, in either order once."""
    return lg.played.where("player_id < opp_player_id").select(F.col("player_id").alias("player_a"), F.col("opp_player_id").alias("player_b")).distinct()


def next_round(lg) -> int:
    """The number of the round after the last one."""
    last = lg.rounds.agg(F.max_by("round_order", "seq")).first()[0]
    return (last or 0) + 1


@query("fea_7")
def fea_7(lg):
    """Boards of all who have met as they would meet again in the next round."""
    return X.vectors(X.hypothetical(met_pairs(lg), X.latest_sides(features(lg)), next_round(lg)), 6.0).select("player_a", "player_b", "anti")


@query("fea_3", """SELECT b.match_id, CASE WHEN m.max_score > 0 THEN m.max_score ELSE 10 END / 10.0 AS max_score_norm, round((score0 - score1) / CASE WHEN m.max_score > 0 THEN m.max_score ELSE 10 END, 9) AS margin FROM boards b JOIN (SELECT seq, CASE WHEN round_order = 4 THEN 0.0 ELSE 370.0 END AS max_score FROM rounds) m USING (seq) WHERE rated""")
def fea_3(lg):
    """Margins by the largest score of each round's match type; the last round of a season has a type without one."""
    kinds = lg.rounds.select("seq", F.when(F.col("round_order") == 4, 0.0).otherwise(370.0).alias("max_score"))
    b = lg.played.where("side = 0").join(F.broadcast(kinds), "seq")  # rounds
    scale = X.margin_scale("max_score")
    return b.select("match_id", (scale / 10).alias("max_score_norm"), F.round((F.col("score") - F.col("opp_score")) / scale, 9).alias("margin"))
