"""As-of lookups over histories, and the joins around the fact table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaguelens.sources.league_view import BASE_RATING, BASE_RD, BASE_VOLATILITY

VALUES = ("rating_value", "rating_deviation", "volatility")


def latest_rating(ratings: DataFrame, where: Column | None = None) -> DataFrame:
    """JN-3, JN-4, JN-5: each player's last rating among the rows that meet `where`; an aggregate, so no join."""
    rows = ratings if where is None else ratings.where(where)
    best = rows.groupBy("player_id").agg(F.max_by(F.struct("year", "round_order", *VALUES), F.struct("year", "round_order")).alias("r"))
    return best.select("player_id", "r.*")


def up_to(year: int, round_order: int) -> Column:
    return (F.col("year") == year) & (F.col("round_order") <= round_order)


def before_year(year: int) -> Column:
    return F.col("year") < year


def rating_asof(points: DataFrame, ratings: DataFrame, keys: list[str], order: str, strict: bool = True) -> DataFrame:
    """Each point with the values of the last rating before it (at it too, unless strict); nulls if there is none.

    Points and ratings are put on one time line per key, and the last rating is carried forward by a window, so the
    work is one shuffle by key and no pair of a point with all its earlier ratings is ever made.
    """
    marks = [c for c in points.columns]
    p = points.select(F.struct(*marks).alias("_point"), *keys, F.col(order).alias("_order"), F.lit(None).cast(ratings.select(F.struct(*VALUES)).schema[0].dataType).alias("_rating"), F.lit(0 if strict else 1).alias("_turn"))
    r = ratings.select(F.lit(None).cast(p.schema["_point"].dataType).alias("_point"), *keys, F.col(order).alias("_order"), F.struct(*VALUES).alias("_rating"), F.lit(1 if strict else 0).alias("_turn"))
    w = Window.partitionBy(*keys).orderBy("_order", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    line = p.unionByName(r).withColumn("_last", F.last("_rating", ignorenulls=True).over(w))
    return line.where(F.col("_point").isNotNull()).select("_point.*", *(F.col(f"_last.{v}").alias(v) for v in VALUES))


def seed_ratings(points: DataFrame, ratings: DataFrame) -> DataFrame:
    """JN-6: rating within the year, else of an earlier year, else the default. As the latest of all earlier ratings is
    the one within the year if there is one, a single as-of lookup on the global order gives the whole chain."""
    found = rating_asof(points, ratings, ["player_id"], "seq")
    defaults = dict(zip(VALUES, (BASE_RATING, BASE_RD, BASE_VOLATILITY), strict=True))
    return found.withColumns({v: F.coalesce(v, F.lit(d)) for v, d in defaults.items()})


def overlay(current: DataFrame, snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """JN-7: the snapshot's values where there is a snapshot row, else the current ones."""
    c, s = current.alias("c"), snapshot.alias("s")
    on = [F.col(f"c.{k}") == F.col(f"s.{k}") for k in keys]
    return c.join(s, on, "full").select(*(F.coalesce(f"s.{k}", f"c.{k}").alias(k) for k in keys), *(F.coalesce(f"s.{v}", f"c.{v}").alias(v) for v in VALUES))


def latest_status(status: DataFrame, before: int | None = None) -> DataFrame:
    """JN-8: each player's newest season row, of those before a year if given."""
    rows = status if before is None else status.where(F.col("year") < before)
    return rows.groupBy("player_id").agg(F.max_by(F.struct("year", "hall_id", "capped"), F.struct("year", "hall_id")).alias("r")).select("player_id", "r.*")


def name_for_year(names: DataFrame, year: int) -> DataFrame:
    """JN-9: the name whose span holds the year, the most recently seen first; else the latest name."""
    inside = (F.col("first_seen_year") <= year) & (F.col("last_seen_year") >= year)
    order = F.struct(inside.alias("in"), F.col("last_seen_year").alias("last"), F.col("name").alias("name"))
    return names.groupBy("player_id").agg(F.max(order).alias("o")).select("player_id", F.col("o.name").alias("name"))


def exact_candidates(asked: DataFrame, names: DataFrame) -> DataFrame:
    """JN-10: asked (name) with every player that has had the name, ranked latest first."""
    a = asked.select(F.col("name").alias("asked"), F.lower("name").alias("_key"))
    n = names.select("player_id", "name", "last_seen_year", F.lower("name").alias("_key"))
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.col("last_seen_year").desc(), "player_id", "name"))
    return a.join(n, "_key").select("asked", "player_id", "name", "last_seen_year", place.alias("place"))


def opponents(participants: DataFrame) -> DataFrame:
    """JN-2: each participant with the other one of its match, by one grouping of the two rows of a match."""
    row = F.struct("player_id", "hall_id", "score", "outcome")
    both = participants.groupBy("match_id").agg(F.collect_list(F.struct("side", row.alias("r"))).alias("two"))  # two rows each
    pair = both.where(F.size("two") == 2).select("match_id", F.array_sort("two").alias("two"))
    each = lambda a, b: F.struct(F.col("two")[a]["r"].alias("own"), F.col("two")[b]["r"].alias("opp"))
    out = pair.select("match_id", F.explode(F.array(each(0, 1), each(1, 0))).alias("x"))
    return out.select("match_id", *(F.col(f"x.own.{c}").alias(c) for c in ("player_id", "hall_id", "score", "outcome")), *(F.col(f"x.opp.{c}").alias(f"opp_{c}") for c in ("player_id", "hall_id", "score")))


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """JN-14: rows of child whose key the parent doesn't have."""
    return child.join(parent.select(*keys).distinct(), keys, "left_anti")
