"""Window functions over players' and halls' histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seats_in_file_order(rows: DataFrame) -> DataFrame:
    """WIN-1: seats counted per round and hall in file order, side 1 before side 2; the walkover side has none.

    rows: year, round_order, row_no, name1, hall1, name2, hall2. Result: one row per real side.
    """
    side = lambda k: F.struct(F.lit(k).alias("side"), F.col(f"name{k}").alias("name"), F.col(f"hall{k}").alias("hall"))
    one = rows.select("year", "round_order", "row_no", F.explode(F.array(side(1), side(2))).alias("s")).select("year", "round_order", "row_no", "s.*")
    seat = F.row_number().over(Window.partitionBy("year", "round_order", "hall").orderBy("row_no", "side"))
    return one.where(F.upper("name") != "WALKOVER").withColumn("seat", seat)


def competition_rank(df: DataFrame, keys: list[str], value: str, name: str = "rank") -> DataFrame:
    """WIN-2: one more than the number of strictly higher ones."""
    return df.withColumn(name, F.rank().over(Window.partitionBy(*keys).orderBy(F.col(value).desc())))


def position(df: DataFrame, keys: list[str], order: list, name: str = "position") -> DataFrame:
    """WIN-3: running number after a sort with tie-breaks."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def change(df: DataFrame, keys: list[str], order: str, column: str, name: str) -> DataFrame:
    """WIN-4: difference to the previous row of the key."""
    return df.withColumn(name, F.col(column) - F.lag(column).over(Window.partitionBy(*keys).orderBy(order)))


def last_label(sides: DataFrame, rounds: DataFrame) -> DataFrame:
    """WIN-5: label of each player's newest round with a board."""
    last = sides.where("player_id <> 'WLKOVR'").groupBy("player_id").agg(F.max("seq").alias("seq"))
    return last.join(F.broadcast(rounds.select("seq", F.concat(F.col("year").cast("string"), F.lit(" "), F.col("round_label")).alias("label"))), "seq").select("player_id", "label")


def form(sides: DataFrame, max_score: float = 370.0) -> DataFrame:
    """WIN-6: sum and count of a player's last five results, mean and spread of margins, and mean of the last three seats,
    all before the round."""
    five = Window.partitionBy("player_id").orderBy("seq").rowsBetween(-5, -1)
    three = Window.partitionBy("player_id").orderBy("seq").rowsBetween(-3, -1)
    margin = (F.col("score") - F.col("opp_score")) / max_score
    return sides.where("rated").withColumn("_m", margin).select(
        "match_id", "player_id", "seq",
        F.coalesce(F.sum("outcome").over(five), F.lit(0.0)).alias("sum_last5"),
        F.count("outcome").over(five).alias("count_last5"),
        F.avg("_m").over(five).alias("margin_form"),
        F.stddev_pop("_m").over(five).alias("margin_spread"),
        F.avg("seat").over(three).alias("seat_last3"),
    )


def running_counts(sides: DataFrame) -> DataFrame:
    """WIN-7: career, season and per-opposing-hall aggregates before the round."""
    before = lambda *k: Window.partitionBy(*k).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return sides.where("rated").select(
        "match_id", "player_id", "seq",
        F.count("*").over(before("player_id")).alias("career_boards"),
        F.count("*").over(before("player_id", "year")).alias("season_boards"),
        F.coalesce(F.sum("outcome").over(before("player_id", "opp_hall_id")), F.lit(0.0)).alias("won_vs_hall"),
        F.count("*").over(before("player_id", "opp_hall_id")).alias("boards_vs_hall"),
        F.count_if(F.col("participation_type") == "TIMEOUT").over(before("player_id")).alias("timeouts"),
    )


def running_over_rounds(rows: DataFrame, keys: list[str], value: str, names: tuple[str, str]) -> DataFrame:
    """WIN-7: sum and count of `value` over the rounds before, by key; keys may be empty for the whole league.

    Rows are first summed per key and round, so a league-wide running mean is a window over the rounds alone.
    """
    each = rows.groupBy(*keys, "seq").agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return each.select(*keys, "seq", F.coalesce(F.sum("_s").over(w), F.lit(0.0)).alias(names[0]), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias(names[1]))


def rounds_missed(sides: DataFrame) -> DataFrame:
    """WIN-8: rounds since the last one played this season, less one; 0 for the first."""
    gap = F.col("round_order") - F.lag("round_order").over(Window.partitionBy("player_id", "year").orderBy("round_order")) - 1
    return sides.where("rated").select("match_id", "player_id", F.greatest(F.lit(0), F.coalesce(gap, F.lit(0))).alias("missed"))


def streaks(rows: DataFrame, key: str, order: list) -> DataFrame:
    """WIN-9: length of each key's run of equal results that ends now, negative for losses, 0 after a draw."""
    w = Window.partitionBy(key).orderBy(*order)
    turned = F.when(F.col("outcome") == F.lag("outcome").over(w), 0).otherwise(1)
    runs = rows.withColumn("_turn", turned).withColumn("_run", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    each = runs.groupBy(key, "_run").agg(F.count("*").alias("n"), F.max("outcome").alias("outcome"))
    last = each.groupBy(key).agg(F.max_by(F.struct("n", "outcome"), "_run").alias("r"))
    return last.select(key, F.when(F.col("r.outcome") == 1.0, F.col("r.n")).when(F.col("r.outcome") == 0.0, -F.col("r.n")).otherwise(F.lit(0)).alias("streak"))


def rolling_cache(sides: DataFrame, include_walkovers: bool = True, max_score: float = 370.0) -> DataFrame:
    """REP-12, WIN-9 and WIN-10: streak, mean margin of the last five boards and boards of the latest round, by player.

    A walkover's winner is stored as STANDARD, so by default such a win counts for the streak and the margin.
    """
    rows = sides.where("player_id <> 'WLKOVR'")
    rows = rows if include_walkovers else rows.where("rated")
    n = F.row_number().over(Window.partitionBy("player_id").orderBy(F.col("seq").desc(), F.col("match_id").desc()))
    last5 = rows.withColumn("_n", n).where("_n <= 5").groupBy("player_id").agg(F.avg((F.col("score") - F.col("opp_score")) / max_score).alias("avg_margin_last_5"))
    newest = rows.groupBy("player_id", "seq").agg(F.count("*").alias("n")).groupBy("player_id").agg(F.max_by("n", "seq").alias("boards_in_latest_round"))
    return streaks(rows, "player_id", ["seq", "match_id"]).withColumnRenamed("streak", "current_streak").join(last5, "player_id").join(newest, "player_id")


def recency_weight(rounds_ago: Column) -> Column:
    """WIN-13: halves every ten rounds."""
    return F.exp(-F.log(F.lit(2.0)) / 10 * rounds_ago)
