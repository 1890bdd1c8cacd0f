"""A league derived from `orders`: rounds, halls, players and boards, by rules that plain SQL can repeat.

A customer is a player, seven customers in a row are a hall, a quarter is a round. A player enters a round with the
first order; the first five of a hall sit at boards 1 to 5. Halls are paired by a fixed mixing of hall and round, and
equal seats of two paired halls meet. A seat without an opponent is a walkover; an urgent order whose key ends in 0 is a
timeout. Everything is partitioned by round and hall or pair, so it grows with the orders alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_SCORE = 370.0
SEATS = 5
SENTINEL, UNKNOWN_HALL = "WLKOVR", -1
STANDARD, WALKOVER, TIMEOUT = "STANDARD", "WALKOVER", "TIMEOUT"
#: Glicko defaults.
BASE_RATING, BASE_RD, BASE_VOLATILITY = 1000.0, 350.0, 0.06


def player_text(key):
    return F.lpad(key.cast("string"), 9, "0")


@dataclass
class League:
    """Frames of one league; each is built once and planned lazily."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def orders(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/orders.parquet")

    @cached_property
    def entries(self) -> DataFrame:
        """One row per player and round: the lowest order key, with seat and score."""
        o = self.orders.select(
            F.year("o_orderdate").alias("year"),
            F.quarter("o_orderdate").alias("round_order"),
            F.col("o_custkey").alias("player"),
            F.struct("o_orderkey", "o_totalprice", "o_orderpriority").alias("o"),
        )
        first = o.groupBy("year", "round_order", "player").agg(F.min("o").alias("o"))
        hall = F.expr("player div 7")
        seat = F.row_number().over(Window.partitionBy("year", "round_order", "hall").orderBy("o.o_orderkey"))
        return (
            first.withColumn("hall", hall)
            .withColumn("seat", seat)
            .where(F.col("seat") <= SEATS)
            .select(
                "year", "round_order", "player", "hall", "seat",
                F.col("o.o_orderkey").alias("entry_key"),
                (F.round(F.col("o.o_totalprice") / 500000 * 37).cast("int") * 10).alias("points"),
                ((F.col("o.o_orderpriority") == "1-URGENT") & (F.col("o.o_orderkey") % 10 == 0)).alias("late"),
            )
        )

    @cached_property
    def pairs(self) -> DataFrame:
        """Each hall's pair and side in a round."""
        halls = self.entries.select("year", "round_order", "hall").distinct()
        mixed = (F.col("hall") * 7919 + (F.col("year") * 4 + F.col("round_order")) * 104729) % 10007
        place = F.row_number().over(Window.partitionBy("year", "round_order").orderBy(mixed, "hall")) - 1
        return halls.withColumn("place", place).select("year", "round_order", "hall", F.expr("place div 2").alias("pair"), (F.col("place") % 2).alias("side"))

    @cached_property
    def boards(self) -> DataFrame:
        """One row per board with both sides; what is missing on a side is null, but for its hall."""
        e = self.entries.join(self.pairs, ["year", "round_order", "hall"])
        keys = ["year", "round_order", "pair", "seat"]
        side = lambda k: e.where(F.col("side") == k).select(*keys, *(F.col(c).alias(f"{c}{k}") for c in ("player", "hall", "points", "late")))
        both = side(0).join(side(1), keys, "full")
        halls = self.pairs.groupBy("year", "round_order", "pair").agg(*(F.max(F.when(F.col("side") == k, F.col("hall"))).alias(f"pair_hall{k}") for k in (0, 1)))
        walkover = F.col("player0").isNull() | F.col("player1").isNull()
        late0 = ~walkover & F.coalesce("late0", F.lit(False))
        late1 = ~walkover & F.coalesce("late1", F.lit(False)) & ~late0
        default = F.floor(F.lit(MAX_SCORE) / 2) + 1
        board = both.join(halls, ["year", "round_order", "pair"])

        def score(k):
            mine, theirs, other = (F.col(f"player{k}"), late1 if k else late0, late0 if k else late1)
            return F.when(walkover, F.when(mine.isNull(), 0.0).otherwise(default)).when(theirs, 0.0).otherwise(F.col(f"points{k}")).cast("double")

        def outcome(k):
            mine, theirs = F.col(f"points{k}"), F.col(f"points{1 - k}")
            late, other = (late1, late0) if k else (late0, late1)
            played = F.when(mine > theirs, 1.0).when(mine == theirs, 0.5).otherwise(0.0)
            return F.when(walkover, F.when(F.col(f"player{k}").isNull(), 0.0).otherwise(1.0)).when(late, 0.0).when(other, 1.0).otherwise(played)

        def fields(k):
            kind = F.when(F.col(f"player{k}").isNull(), WALKOVER).when(late1 if k else late0, TIMEOUT).otherwise(STANDARD)
            there = F.col(f"player{k}").isNotNull()
            return [
                F.when(there, player_text(F.col(f"player{k}"))).otherwise(SENTINEL).alias(f"player_id{k}"),
                F.coalesce(f"hall{k}", f"pair_hall{k}", F.lit(UNKNOWN_HALL)).alias(f"hall_id{k}"),
                F.when(there, F.col("seat")).alias(f"hall_seat{k}"),
                kind.alias(f"kind{k}"),
                score(k).alias(f"score{k}"),
                outcome(k).alias(f"outcome{k}"),
            ]

        match_id = ((F.col("year") * 10 + F.col("round_order")).cast("long") * 100000 + F.col("pair")) * 10 + F.col("seat")
        return board.select(match_id.alias("match_id"), *keys, walkover.alias("is_walkover"), *fields(0), *fields(1)).join(F.broadcast(self.rounds.select("year", "round_order", "seq", "round_id")), ["year", "round_order"])

    @cached_property
    def rounds(self) -> DataFrame:
        """year, round_order, seq, round_id, round_label of each round; a small dimension."""
        days = self.orders.select(F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("round_order")).distinct()
        seq = (F.row_number().over(Window.orderBy("year", "round_order")) - 1).cast("long")  # one row per round: rounds are few
        return days.select("year", "round_order", seq.alias("seq"), (F.col("year") * 10 + F.col("round_order")).cast("long").alias("round_id"), F.concat(F.lit("Round "), F.col("round_order").cast("string")).alias("round_label"))

    @cached_property
    def sides(self) -> DataFrame:
        """Two rows per board, each with its opponent's columns: the fact table, without a self join."""

        def one(k):
            own = {"player_id": "player_id", "hall_id": "hall_id", "seat": "hall_seat", "participation_type": "kind", "score": "score", "outcome": "outcome"}
            mine = [F.col(f"{v}{k}").alias(n) for n, v in own.items()]
            theirs = [F.col(f"{v}{1 - k}").alias(f"opp_{n}") for n, v in own.items()]
            return F.struct(F.lit(k).alias("side"), *mine, *theirs)

        s = self.boards.select("match_id", "year", "round_order", "seq", "round_id", "pair", F.col("seat").alias("board_seat"), (~F.col("is_walkover")).alias("rated"), F.explode(F.array(one(0), one(1))).alias("s"))
        return s.select(*s.columns[:-1], "s.*")

    @cached_property
    def participants(self) -> DataFrame:
        """The stored columns of the fact table."""
        return self.sides.select("match_id", "round_id", "year", "round_order", "seq", "side", "player_id", "hall_id", "seat", "participation_type", "score", "outcome")

    @cached_property
    def played(self) -> DataFrame:
        """Sides of rated boards: two players, no walkover."""
        return self.sides.where("rated")

    @cached_property
    def status(self) -> DataFrame:
        """player_id, year, hall_id, capped, active: one row per player and season in which the player has a board."""
        real = self.sides.where(F.col("player_id") != SENTINEL).select("player_id", "year", "hall_id").distinct()
        return real.withColumn("capped", (F.col("player_id").cast("long") * 31) % 10 < 4).withColumn("active", F.lit(True))

    @cached_property
    def names(self) -> DataFrame:
        """player_id, name, first_seen_year, last_seen_year; every third season's name has a suffix."""
        name = F.concat(F.lit("Player "), F.col("player_id"), F.when(F.col("year") % 3 == 0, F.lit(" Jr")).otherwise(F.lit("")))
        return self.status.withColumn("name", name).groupBy("player_id", "name").agg(F.min("year").alias("first_seen_year"), F.max("year").alias("last_seen_year"))

    @cached_property
    def ratings(self) -> DataFrame:
        """A stand-in for ratings that is plain SQL: 1000 + 10 x running points won - running points lost."""
        w = Window.partitionBy("player_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
        p = self.played
        return p.select(
            "player_id", "hall_id", "year", "round_order", "seq", "round_id",
            (BASE_RATING + 10 * F.sum("outcome").over(w) - F.sum(1 - F.col("outcome")).over(w)).alias("rating_value"),
            F.greatest(F.lit(50.0), BASE_RD - 5 * F.count("*").over(w)).cast("double").alias("rating_deviation"),
            F.lit(BASE_VOLATILITY).alias("volatility"),
        )


def league(spark: SparkSession, sf_dir: str) -> League:
    return League(spark, sf_dir)


#: The same league in DuckDB SQL. Every oracle starts from these expressions.
SQL = """
WITH o AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS round_order, o_custkey AS player, o_orderkey, o_totalprice, o_orderpriority FROM orders),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY year, round_order, player ORDER BY o_orderkey) AS n FROM o) WHERE n = 1),
e0 AS (SELECT *, player // 7 AS hall, CAST(row_number() OVER (PARTITION BY year, round_order, player // 7 ORDER BY o_orderkey) AS INTEGER) AS seat FROM f),
entries AS (SELECT year, round_order, player, hall, seat, CAST(round(o_totalprice / 500000 * 37) AS INTEGER) * 10 AS points, (o_orderpriority = '1-URGENT' AND o_orderkey % 10 = 0) AS late FROM e0 WHERE seat <= 5),
pairs AS (SELECT year, round_order, hall, (place - 1) // 2 AS pair, (place - 1) % 2 AS side FROM (
  SELECT year, round_order, hall, row_number() OVER (PARTITION BY year, round_order ORDER BY (hall * 7919 + (year * 4 + round_order) * 104729) % 10007, hall) AS place FROM (SELECT DISTINCT year, round_order, hall FROM entries))),
pe AS (SELECT e.*, p.pair, p.side FROM entries e JOIN pairs p USING (year, round_order, hall)),
b0 AS (SELECT year, round_order, pair, seat, a.player AS player0, a.hall AS hall0, a.points AS points0, a.late AS late0, b.player AS player1, b.hall AS hall1, b.points AS points1, b.late AS late1
  FROM (SELECT * FROM pe WHERE side = 0) a FULL OUTER JOIN (SELECT * FROM pe WHERE side = 1) b USING (year, round_order, pair, seat)),
ph AS (SELECT year, round_order, pair, max(CASE WHEN side = 0 THEN hall END) AS ph0, max(CASE WHEN side = 1 THEN hall END) AS ph1 FROM pairs GROUP BY ALL),
b1 AS (SELECT b0.*, ph0, ph1, (player0 IS NULL OR player1 IS NULL) AS wo FROM b0 JOIN ph USING (year, round_order, pair)),
b2 AS (SELECT *, (NOT wo AND coalesce(late0, false)) AS l0, (NOT wo AND coalesce(late1, false) AND NOT coalesce(late0, false)) AS l1 FROM b1),
rounds AS (SELECT year, round_order, CAST(row_number() OVER (ORDER BY year, round_order) - 1 AS BIGINT) AS seq, CAST(year * 10 + round_order AS BIGINT) AS round_id, 'Round ' || round_order AS round_label FROM (SELECT DISTINCT year, round_order FROM o)),
boards AS (SELECT (CAST(year * 10 + round_order AS BIGINT) * 100000 + pair) * 10 + seat AS match_id, year, round_order, seq, round_id, pair, seat AS board_seat, NOT wo AS rated,
  CASE WHEN player0 IS NULL THEN 'WLKOVR' ELSE lpad(CAST(player0 AS VARCHAR), 9, '0') END AS player_id0, CASE WHEN player1 IS NULL THEN 'WLKOVR' ELSE lpad(CAST(player1 AS VARCHAR), 9, '0') END AS player_id1,
  coalesce(hall0, ph0, -1) AS hall_id0, coalesce(hall1, ph1, -1) AS hall_id1,
  CASE WHEN player0 IS NOT NULL THEN seat END AS seat0, CASE WHEN player1 IS NOT NULL THEN seat END AS seat1,
  CASE WHEN player0 IS NULL THEN 'WALKOVER' WHEN l0 THEN 'TIMEOUT' ELSE 'STANDARD' END AS kind0, CASE WHEN player1 IS NULL THEN 'WALKOVER' WHEN l1 THEN 'TIMEOUT' ELSE 'STANDARD' END AS kind1,
  CAST(CASE WHEN player0 IS NULL THEN 0 WHEN wo THEN 186 WHEN l0 THEN 0 ELSE points0 END AS DOUBLE) AS score0, CAST(CASE WHEN player1 IS NULL THEN 0 WHEN wo THEN 186 WHEN l1 THEN 0 ELSE points1 END AS DOUBLE) AS score1,
  CAST(CASE WHEN player0 IS NULL THEN 0 WHEN wo THEN 1 WHEN l0 THEN 0 WHEN l1 THEN 1 WHEN points0 > points1 THEN 1 WHEN points0 = points1 THEN 0.5 ELSE 0 END AS DOUBLE) AS outcome0,
  CAST(CASE WHEN player1 IS NULL THEN 0 WHEN wo THEN 1 WHEN l1 THEN 0 WHEN l0 THEN 1 WHEN points1 > points0 THEN 1 WHEN points0 = points1 THEN 0.5 ELSE 0 END AS DOUBLE) AS outcome1
  FROM b2 JOIN rounds USING (year, round_order)),
sides AS (SELECT match_id, year, round_order, seq, round_id, pair, board_seat, rated, 0 AS side, player_id0 AS player_id, hall_id0 AS hall_id, seat0 AS seat, kind0 AS participation_type, score0 AS score, outcome0 AS outcome,
    player_id1 AS opp_player_id, hall_id1 AS opp_hall_id, seat1 AS opp_seat, kind1 AS opp_participation_type, score1 AS opp_score, outcome1 AS opp_outcome FROM boards
  UNION ALL SELECT match_id, year, round_order, seq, round_id, pair, board_seat, rated, 1, player_id1, hall_id1, seat1, kind1, score1, outcome1, player_id0, hall_id0, seat0, kind0, score0, outcome0 FROM boards),
played AS (SELECT * FROM sides WHERE rated),
status AS (SELECT DISTINCT player_id, year, hall_id, (CAST(player_id AS BIGINT) * 31) % 10 < 4 AS capped, true AS active FROM sides WHERE player_id <> 'WLKOVR'),
names AS (SELECT player_id, name, min(year) AS first_seen_year, max(year) AS last_seen_year FROM (SELECT *, 'Player ' || player_id || CASE WHEN year % 3 = 0 THEN ' Jr' ELSE '' END AS name FROM status) GROUP BY ALL),
ratings AS (SELECT player_id, hall_id, year, round_order, seq, round_id,
    1000 + 10 * sum(outcome) OVER w - sum(1 - outcome) OVER w AS rating_value, CAST(greatest(50.0, 350.0 - 5 * count(*) OVER w) AS DOUBLE) AS rating_deviation, CAST(0.06 AS DOUBLE) AS volatility
  FROM played WINDOW w AS (PARTITION BY player_id ORDER BY seq ROWS UNBOUNDED PRECEDING))
"""


def sql(select: str) -> str:
    """An oracle: the league's expressions, then further ones (starting with a comma) or the select itself."""
    return SQL.rstrip() + "\n" + select.strip()
