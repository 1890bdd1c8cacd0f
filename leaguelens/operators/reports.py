"""Rankings, profiles, comparisons and win probabilities, each as one plan over all players or halls."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leaguelens.functions import scalars as S
from leaguelens.operators import asof, running, standings


def player_ranking(ratings: DataFrame, status: DataFrame, names: DataFrame, sides: DataFrame, rounds: DataFrame, year: int, round_order: int) -> DataFrame:
    """REP-1: active players of the year by their latest rating up to the round, with hall, name, last played round and
    position; ties go by name, then hall."""
    rows = asof.latest_rating(ratings, asof.up_to(year, round_order)).select("player_id", "rating_value", "rating_deviation")
    active = status.where((F.col("year") == year) & F.col("active")).select("player_id", "hall_id", "capped")
    last = running.last_label(sides.where(asof.up_to(year, round_order)), rounds)
    out = rows.join(active, "player_id").join(asof.name_for_year(names, year), "player_id").join(last, "player_id", "left")
    out = out.withColumn("elo", S.display_elo("rating_value"))
    return ranked(out, [F.col("rating_value").desc(), F.col("name"), F.col("hall_id")])


def ranked(df: DataFrame, order: list) -> DataFrame:
    """Positions over the whole table without a one-task window: rows are range-partitioned by the order, numbered inside
    their partition, and shifted by the sizes of the partitions before, which are as few as partitions."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    from leaguelens.operators.checkpoints import checkpointed

    placed = checkpointed(placed)  # the ranges must not be drawn twice
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.join(F.broadcast(before), "_part").withColumn("position", (F.col("_before") + number).cast("long")).drop("_part", "_before")


def hall_ranking(players: DataFrame) -> DataFrame:
    """REP-2: mean of each hall's five best players, and its capped players, of a player ranking."""
    elo = standings.hall_elo(players, ["hall_id"])
    capped = players.groupBy("hall_id").agg(F.count_if("capped").alias("capped"), F.count("*").alias("players"))
    return elo.join(capped, "hall_id").withColumn("hall_elo", F.round("hall_elo", 6))


def player_rounds(played: DataFrame, ratings: DataFrame) -> DataFrame:
    """REP-3: per player and round Elo, rank in the round, changes to the player's previous round, seat, opponent, scores."""
    r = running.competition_rank(ratings.select("player_id", "seq", "year", "round_order", "rating_value"), ["seq"], "rating_value")
    r = running.change(running.change(r.withColumn("elo", S.display_elo("rating_value")), ["player_id"], "seq", "elo", "elo_change"), ["player_id"], "seq", "rank", "rank_change")
    b = played.select("player_id", "seq", "seat", "opp_player_id", "opp_hall_id", S.score_pair_text("score", "participation_type", "opp_score", "opp_participation_type").alias("scores"), S.outcome_letter("outcome").alias("result"))
    return r.join(b, ["player_id", "seq"]).drop("rating_value")


def player_years(sides: DataFrame, ratings: DataFrame) -> DataFrame:
    """REP-4: per player and year the final rating, mean seat and points won and lost."""
    final = ratings.groupBy("player_id", "year").agg(F.max_by("rating_value", "seq").alias("rating_value"))
    own = sides.where("player_id <> 'WLKOVR'").groupBy("player_id", "year").agg(F.round(F.avg("seat"), 6).alias("avg_seat"), F.sum("outcome").alias("won"), F.sum(1 - F.col("outcome")).alias("lost"))
    return own.join(final, ["player_id", "year"], "left")


def comparison(profile: DataFrame, one: str, other: str) -> DataFrame:
    """REP-5: two players' rounds side by side."""
    side = lambda p, s: profile.where(F.col("player_id") == p).select("seq", F.col("elo").alias(f"elo_{s}"), F.col("rank").alias(f"rank_{s}"), F.col("result").alias(f"result_{s}"))
    return side(one, "a").join(side(other, "b"), "seq", "full")


def hall_rounds(sides: DataFrame, ratings: DataFrame) -> DataFrame:
    """REP-6: per hall and round Elo of the five best, rank, changes, points and primary opponent."""
    elo = standings.hall_elo(ratings, ["year", "round_order", "seq", "hall_id"]).withColumn("hall_elo", F.round("hall_elo", 6))
    elo = running.change(running.competition_rank(elo, ["seq"], "hall_elo"), ["hall_id"], "seq", "rank", "rank_change")
    main = standings.primary_opponent(standings.opponent_tally(sides)).select("year", "round_order", "hall_id", "opp_hall_id", "points_for", "points_against")
    return elo.join(main, ["year", "round_order", "hall_id"], "left")


def hall_years(sides: DataFrame, ratings: DataFrame) -> DataFrame:
    """REP-7: per hall and year the last round's Elo and rank, and the season's points."""
    r = hall_rounds(sides, ratings).groupBy("hall_id", "year").agg(F.max_by(F.struct("hall_elo", "rank"), "seq").alias("r"))
    points = sides.where("player_id <> 'WLKOVR'").groupBy("hall_id", "year").agg(F.sum("outcome").alias("points"), F.round(F.avg("seat"), 6).alias("avg_seat"))
    return points.join(r, ["hall_id", "year"], "left").select("hall_id", "year", "points", "avg_seat", "r.hall_elo", "r.rank")


def teams(players: DataFrame, capped_most: int = 2, size: int = 5) -> DataFrame:
    """REP-8: the best `size` players of each hall, at most `capped_most` of them capped; team is an array of Elos."""
    order = [F.col("rating_value").desc(), "player_id"]
    allowed = players.withColumn("_c", F.row_number().over(Window.partitionBy("hall_id", "capped").orderBy(*order))).where(~F.col("capped") | (F.col("_c") <= capped_most))
    best = allowed.withColumn("_n", F.row_number().over(Window.partitionBy("hall_id").orderBy(*order))).where(F.col("_n") <= size)
    team = best.groupBy("hall_id").agg(F.array_sort(F.collect_list(F.struct("_n", S.display_elo("rating_value").alias("elo")))).alias("t"))  # size rows
    return team.where(F.size("t") == size).select("hall_id", F.col("t.elo").alias("team"))


def win_probability(pairs: DataFrame, team: DataFrame, size: int = 5) -> DataFrame:
    """REP-8: share of the orders of the second team in which the first wins more than half of the boards by Elo, an
    equal board counting half; for every pair (hall_id, opp_hall_id)."""
    a, b = team.withColumnRenamed("team", "_a"), team.select(F.col("hall_id").alias("opp_hall_id"), F.col("team").alias("_b"))
    both = pairs.join(a, "hall_id").join(b, "opp_hall_id")
    orders = F.array(*(F.array(*(F.lit(i) for i in p)) for p in itertools.permutations(range(size))))
    points = lambda p: F.aggregate(F.zip_with("_a", F.transform(p, lambda i: F.col("_b")[i]), lambda x, y: F.when(x > y, 1.0).when(x == y, 0.5).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v)
    won = F.transform(orders, lambda p: F.when(points(p) > size / 2, 1.0).otherwise(0.0))
    return both.select("hall_id", "opp_hall_id", (F.aggregate(won, F.lit(0.0), lambda s, v: s + v) / F.size(won)).alias("win_share"))


def wide_by_round(rows: DataFrame, key: str, value: str, rounds: list[int] | None = None) -> DataFrame:
    """REP-10: a column for each round, by default for each that occurs. Rounds are few."""
    if rounds is None:
        rounds = [r.seq for r in rows.select("seq").distinct().orderBy("seq").collect()]
    return rows.groupBy(key).pivot("seq", rounds).agg(F.max(value)).select(key, *(F.col(str(r)).alias(f"r{r}") for r in rounds))


def wide_rounds(rows: DataFrame, key: str, values: list[str]) -> DataFrame:
    """REP-10: several values of each key with a column for each round that occurs: `<round>_<value>`. Rounds are few."""
    rounds = [r.seq for r in rows.select("seq").distinct().orderBy("seq").collect()]
    return rows.groupBy(key).pivot("seq", rounds).agg(*(F.max(v).alias(v) for v in values))
