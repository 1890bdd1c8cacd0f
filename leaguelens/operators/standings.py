"""Aggregations of boards: matchups, standings, tallies and quality measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_POINTS = 3.0  # a hall all of whose five boards were walkovers: floor(5 / 2) + 1


def hall_elo(ratings: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-3: mean of the five best ratings of each group, of what there is if fewer."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("rating_value").desc(), "player_id"))
    return ratings.withColumn("_place", place).where("_place <= 5").groupBy(*keys).agg(F.avg("rating_value").alias("hall_elo"))


def matchups(sides: DataFrame) -> DataFrame:
    """AGG-8: one row per round and pair of halls, the smaller hall first, with the points of both; halls whose boards
    of the round were all walkovers have a row without opponent."""
    rated = sides.where("rated")
    low, high = F.least("hall_id", "opp_hall_id"), F.greatest("hall_id", "opp_hall_id")
    first = F.col("hall_id") < F.col("opp_hall_id")
    met = rated.groupBy("year", "round_order", "seq", low.alias("hall_a"), high.alias("hall_b")).agg(F.sum(F.when(first, F.col("outcome")).otherwise(0.0)).alias("points_a"), F.sum(F.when(first, 0.0).otherwise(F.col("outcome"))).alias("points_b"))
    real = sides.where("player_id <> 'WLKOVR'")
    alone = real.groupBy("year", "round_order", "seq", F.col("hall_id").alias("hall_a")).agg(F.max("rated").alias("any"), F.sum("outcome").alias("points_a")).where("not any")
    alone = alone.select("year", "round_order", "seq", "hall_a", F.lit(None).cast("long").alias("hall_b"), "points_a", F.lit(0.0).alias("points_b"))
    both = met.unionByName(alone)
    result = F.when(F.col("points_a") > F.col("points_b"), 1.0).when(F.col("points_a") == F.col("points_b"), 0.5).otherwise(0.0)
    return both.withColumn("outcome_a", result)


def standings(sides: DataFrame) -> DataFrame:
    """AGG-9: after each round each hall's running match wins (1, or 0.5 for a tie) and board points, and its rank.

    A hall whose boards of a round were all walkovers gets the default points and one match win.
    """
    m = matchups(sides)
    a = m.select("year", "round_order", "seq", F.col("hall_a").alias("hall_id"), F.when(F.col("hall_b").isNull(), DEFAULT_POINTS).otherwise(F.col("points_a")).alias("points"), F.col("outcome_a").alias("win"))
    b = m.where("hall_b is not null").select("year", "round_order", "seq", F.col("hall_b").alias("hall_id"), F.col("points_b").alias("points"), (1 - F.col("outcome_a")).alias("win"))
    each = a.unionByName(b).groupBy("year", "round_order", "seq", "hall_id").agg(F.sum("points").alias("points"), F.sum("win").alias("win"))
    w = Window.partitionBy("year", "hall_id").orderBy("round_order").rowsBetween(Window.unboundedPreceding, 0)
    run = each.select("year", "round_order", "hall_id", F.sum("win").over(w).alias("match_wins"), F.sum("points").over(w).alias("board_wins"))
    place = F.rank().over(Window.partitionBy("year", "round_order").orderBy(F.col("match_wins").desc(), F.col("board_wins").desc()))
    return run.withColumn("place", place)


def opponent_tally(sides: DataFrame) -> DataFrame:
    """AGG-10: for each round and hall the points for and against each opposing hall; walkovers of a known hall count,
    boards within a hall don't."""
    real = sides.where("player_id <> 'WLKOVR' and hall_id <> opp_hall_id and opp_hall_id <> -1")
    return real.groupBy("year", "round_order", "hall_id", "opp_hall_id").agg(F.count("*").alias("boards"), F.sum("outcome").alias("points_for"), F.sum("opp_outcome").alias("points_against"))


def primary_opponent(tally: DataFrame) -> DataFrame:
    """AGG-10: the opposing hall with the most boards, then the most own points, then the smaller id."""
    order = F.row_number().over(Window.partitionBy("year", "round_order", "hall_id").orderBy(F.col("boards").desc(), F.col("points_for").desc(), "opp_hall_id"))
    return tally.withColumn("_n", order).where("_n = 1").drop("_n")


def hall_round_tally(sides: DataFrame) -> DataFrame:
    """AGG-11: a hall's points of a round; the default if all its boards were walkovers of an unknown hall."""
    real = sides.where("player_id <> 'WLKOVR'")
    t = real.groupBy("year", "round_order", "hall_id").agg(F.min((~F.col("rated")) & (F.col("opp_hall_id") == -1)).alias("void"), F.sum("outcome").alias("points"), F.sum("opp_outcome").alias("against"))
    return t.select("year", "round_order", "hall_id", F.when(F.col("void"), DEFAULT_POINTS).otherwise(F.col("points")).alias("points"), F.when(F.col("void"), 0.0).otherwise(F.col("against")).alias("against"))


def quality(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-13: boards, Brier score, log loss, squared error of the expected score, accuracy (ties in the largest
    probability count as hits) of predictions (p_win, p_draw, p_loss, outcome)."""
    p = [F.col("p_win"), F.col("p_draw"), F.col("p_loss")]
    hit = [(F.col("outcome") == v).cast("double") for v in (1.0, 0.5, 0.0)]
    right = sum((a * b for a, b in zip(p, hit, strict=True)), F.lit(0.0))
    brier = sum(((a - b) * (a - b) for a, b in zip(p, hit, strict=True)), F.lit(0.0))
    return predictions.groupBy(*keys).agg(
        F.count("*").alias("boards"),
        F.avg(brier).alias("brier"),
        F.avg(-F.log(F.greatest(right, F.lit(1e-12)))).alias("log_loss"),
        F.avg(F.pow(F.col("p_win") + F.col("p_draw") / 2 - F.col("outcome"), 2)).alias("es_mse"),
        F.avg((right >= F.greatest(*p)).cast("double")).alias("accuracy"),
    )


def calibration(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-14: ten buckets of the expected score with predicted and actual means."""
    es = F.col("p_win") + F.col("p_draw") / 2
    bucket = F.least(F.lit(9), F.floor(es * 10)).cast("int")
    return predictions.groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("boards"), F.avg(es).alias("predicted"), F.avg("outcome").alias("actual"))


def paired_rounds(predictions: DataFrame, model: str, baseline: str) -> DataFrame:
    """AGG-15: in how many rounds the model's mean Brier score is below and above the baseline's."""
    b = quality(predictions, ["model", "seq"]).groupBy("seq").agg(F.max(F.when(F.col("model") == model, F.col("brier"))).alias("m"), F.max(F.when(F.col("model") == baseline, F.col("brier"))).alias("b"))
    return b.agg(F.count_if(F.col("m") < F.col("b")).alias("better"), F.count_if(F.col("m") > F.col("b")).alias("worse"))


def board_profile(sides: DataFrame) -> DataFrame:
    """AGG-19: counts over the rated boards."""
    return sides.where("rated and side = 0").agg(
        F.count("*").alias("boards"),
        F.countDistinct("seq").alias("rounds"),
        F.countDistinct("year").alias("years"),
        F.avg((F.col("outcome") == 0.5).cast("double")).alias("draw_share"),
        F.count_if((F.col("participation_type") == "TIMEOUT") | (F.col("opp_participation_type") == "TIMEOUT")).alias("timeouts"),
        F.count_if(F.col("seat").isNull() | F.col("opp_seat").isNull()).alias("null_seats"),
    )
