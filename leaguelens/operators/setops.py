"""Sorts, top-k, set operations and keyed de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: str, columns: dict[str, str]) -> DataFrame:
    """For each key the columns of the row with the largest `order`; a partial aggregate, no sort of the groups."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*(F.col(v).alias(k) for k, v in columns.items())), F.col(order)).alias("_best"))
    return best.select(*keys, *(F.col(f"_best.{k}").alias(k) for k in columns))


def top_per_group(df: DataFrame, keys: list[str], order: list, k: int, name: str = "place") -> DataFrame:
    """SRT-2: the first k rows of each group; Spark cuts each task's groups to k before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def last_write(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """SET-4: one row per key, the one written last; equal orders are told apart by the row itself."""
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(order, *(c for c in others if c != order))).alias("_last"))
    return best.select(*keys, *(F.col(f"_last.{c}").alias(c) for c in others))


def rated_set(played: DataFrame, status: DataFrame) -> DataFrame:
    """SET-1 and JN-12: (year, round_order, player_id) of those who play, and of active players of the halls that play
    who were seen in the season before or in that round."""
    first = played.groupBy("year", "player_id").agg(F.min("round_order").alias("first_round"))
    seen = first.join(status.where("active").select("player_id", "year", "hall_id"), ["player_id", "year"])
    halls = played.select("year", "round_order", "hall_id").distinct()
    carried = halls.join(seen, ["year", "hall_id"]).where("first_round <= round_order")
    return played.select("year", "round_order", "player_id").unionByName(carried.select("year", "round_order", "player_id")).distinct()


def difference_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """SET-2: how many rows are on one side only; both 0 if the sets are equal."""
    one = left.exceptAll(right).agg(F.count("*").alias("only_left"))
    return one.crossJoin(right.exceptAll(left).agg(F.count("*").alias("only_right")))  # one row each


def table_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """SET-3: the rows that are not in both tables, with the side they are in; repeated rows count."""
    a = left.exceptAll(right).withColumn("only_in", F.lit("left"))
    return a.unionByName(right.exceptAll(left).withColumn("only_in", F.lit("right")))
