"""Glicko-2 over the whole history: round solves, forward pass, fixed-opponent passes, idle steps and distilled ratings.

A player has at most one board in a round, so a round is a set of independent two-player solves. The forward pass walks
the rounds on the driver; each round is one join of its boards with the players' states and ends in a checkpoint. Only
players of the round are touched: idle rounds have a closed form, which is applied when a state is next read. The passes
after it take opponents from the pass before, so each is one job in which players are independent of each other.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaguelens.functions import scalars as S
from leaguelens.operators.checkpoints import new_table, written

BASE_RATING, MAX_RD, BASE_VOLATILITY = 1000.0, 350.0, 0.06
TAU, TOLERANCE = 1.2, 1e-6
PASSES = 5


# -- RAT-1, 2, 5: plain expressions -----------------------------------------------------------------------------------


def board_terms(rating, opp_rating, opp_rd, outcome) -> Column:
    """RAT-1: struct (information, surprise) of one board."""
    weight, e = S.g(opp_rd), S.expected_score(rating, opp_rating, opp_rd)
    return F.struct((weight * weight * e * (1 - e)).alias("information"), (weight * (S.col(outcome) - e)).alias("surprise"))


def variance_and_delta(boards: DataFrame, keys: list[str]) -> DataFrame:
    """RAT-2: variance and delta of each key's boards (rating, opp_rating, opp_rd, outcome)."""
    t = boards.select(*keys, board_terms("rating", "opp_rating", "opp_rd", "outcome").alias("t"))
    sums = t.groupBy(*keys).agg(F.sum("t.information").alias("i"), F.sum("t.surprise").alias("s"))
    return sums.select(*keys, (1 / F.col("i")).alias("variance"), (F.col("s") / F.col("i")).alias("delta"))


def idle_rd(rd, volatility, rounds) -> Column:
    """RAT-5: the deviation after some idle rounds."""
    phi, sigma = S.col(rd) / S.SCALE, S.col(volatility)
    return F.least(F.sqrt(phi * phi + S.col(rounds) * sigma * sigma) * S.SCALE, F.lit(MAX_RD))


# -- RAT-3, 4, 6: arrays of boards ------------------------------------------------------------------------------------


def new_volatility(rd: np.ndarray, sigma: np.ndarray, variance: np.ndarray, delta: np.ndarray) -> np.ndarray:
    """RAT-3: the root of the volatility equation for many players at once, by the Illinois method."""
    phi2, d2 = (rd / S.SCALE) ** 2, delta * delta
    alpha = np.log(sigma * sigma)

    def f(x):
        e = np.exp(x)
        whole = phi2 + variance + e
        return e * (d2 - whole) / (2 * whole * whole) - (x - alpha) / TAU**2

    a, over = alpha.copy(), d2 > phi2 + variance
    with np.errstate(invalid="ignore", divide="ignore"):
        b = np.where(over, np.log(np.where(over, d2 - phi2 - variance, 1.0)), alpha - TAU)
    for _ in range(100):
        low = ~over & (f(b) < 0)
        if not low.any():
            break
        b = np.where(low, b - TAU, b)
    fa, fb = f(a), f(b)
    for _ in range(1000):
        busy = (np.abs(b - a) > TOLERANCE) & (np.abs(fb - fa) >= 1e-10)
        if not busy.any():
            break
        with np.errstate(invalid="ignore", divide="ignore"):
            c = np.where(busy, a + (a - b) * fa / (fb - fa), b)
        fc = f(c)
        cross = fc * fb < 0
        a, fa = np.where(busy & cross, b, a), np.where(busy, np.where(cross, fb, fa / 2), fa)
        b, fb = np.where(busy, c, b), np.where(busy, fc, fb)
    return np.exp(a / 2)


def updated(rating, rd, sigma, opp_rating, opp_rd, outcome) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """RAT-4: (rating, rd, volatility) of many players after one board each."""
    weight = 1 / np.sqrt(1 + 3 * (opp_rd / S.SCALE) ** 2 / math.pi**2)
    e = 1 / (1 + np.exp(-weight * (rating - opp_rating) / S.SCALE))
    variance = 1 / (weight * weight * e * (1 - e))
    surprise = weight * (outcome - e)
    new_sigma = new_volatility(rd, sigma, variance, variance * surprise)
    wide = (rd / S.SCALE) ** 2 + new_sigma**2
    phi2 = 1 / (1 / wide + 1 / variance)
    return rating + phi2 * surprise * S.SCALE, np.sqrt(phi2) * S.SCALE, new_sigma


def solved(a: tuple, b: tuple, outcome_a: np.ndarray, iterations: int = 3) -> tuple[tuple, tuple]:
    """RAT-6: both players' states after their board, from the states at its start: each iteration takes the opponent
    from the one before and starts from the entry state again."""
    x, y = a, b
    for _ in range(iterations):
        x, y = updated(*a, y[0], y[1], outcome_a), updated(*b, x[0], x[1], 1 - outcome_a)
    return x, y


def idle(rd, sigma, rounds):
    return np.minimum(np.sqrt((rd / S.SCALE) ** 2 + rounds * sigma * sigma) * S.SCALE, MAX_RD)


# -- RAT-7: forward pass ----------------------------------------------------------------------------------------------


#: Rounds after which the latest states are gathered in one table.
SUMMARY = 8


def fold_rounds(boards: DataFrame, rounds: list[int], fields: list[str], solve: Callable, extra: tuple[str, ...] = (), start: DataFrame | None = None) -> DataFrame:
    """Walks the rounds with a state per player: player_id, seq (of the last board) and double `fields`.

    boards: seq, player_a, player_b, outcome_a and the columns `extra`. solve gets the board's columns as a dict of
    arrays (a_<field>, a_seq, ... with NaN where there is no state yet) and returns two lists of new fields, of a and b.
    Result: the state after every board, one table with a partition for each round. Each round is one job of two shuffles, which
    writes the states of its own players alone: by player, where the sides of its boards meet the latest states, and by
    board, where both sides meet. Boards are a partition for each round, so it reads its own; the states are those of the rounds
    since the last summary and the summary, which holds one state for each player and is written anew every SUMMARY rounds.
    start: states to begin from, if rounds were walked before.
    """
    schema = "player_id string, seq long, " + ", ".join(f"{f} double" for f in fields)
    spark = boards.sparkSession
    columns = ["seq", "player_a", "player_b", "outcome_a", *extra]
    row = F.struct("seq", *fields)
    one_each = lambda df: df.groupBy("player_id").agg(F.max_by(row, "seq").alias("s")).select("player_id", "s.*")
    held_sides, steps = new_table(spark), new_table(spark)
    own = boards.select(*columns).where(F.col("seq").isin(rounds) if rounds else F.lit(False)).withColumn("_board", F.monotonically_increasing_id())
    sides = own.select("*", F.explode(F.array(*(F.struct(F.lit(k).alias("_side"), F.col(f"player_{s}").alias("player_id")) for k, s in enumerate("ab")))).alias("_s")).select("_board", *columns, "_s.*")
    sides.withColumn("_round", F.col("seq")).hint("rebalance", "_round").write.partitionBy("_round").parquet(held_sides)
    kinds = sides.schema
    rounds = sorted({r.seq for r in spark.read.schema(kinds).parquet(held_sides).select("seq").distinct().collect()}) if rounds else []
    since = []
    if start is not None:
        since.append(new_table(spark))
        one_each(start.select("player_id", "seq", *fields)).write.parquet(since[0])
    line = Window.partitionBy("player_id").orderBy("_turn", "_last").rowsBetween(Window.unboundedPreceding, 0)
    board = F.struct("_board", "_side", *columns)

    def run(batches):
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            values = {n: c.to_numpy(zero_copy_only=False).astype(float) for n, c in col.items() if n not in ("player_a", "player_b")}
            new = solve(values)
            for k, side in enumerate("ab"):
                yield pa.RecordBatch.from_arrays([col[f"player_{side}"].cast(pa.string()), col["seq"].cast(pa.int64()), *(pa.array(v, pa.float64()) for v in new[k])], ["player_id", "seq", *fields])

    for k, seq in enumerate(rounds):
        if len(since) > SUMMARY:
            summary = new_table(spark)
            one_each(spark.read.schema(schema).parquet(*since)).write.parquet(summary)
            since = [summary]
        now = spark.read.schema(kinds).parquet(f"{held_sides}/_round={seq}").select("player_id", F.lit(1).alias("_turn"), F.lit(None).cast("long").alias("_last"), board.alias("_b"))
        held = spark.read.schema(schema).parquet(*since) if since else spark.createDataFrame([], schema)
        states = held.select("player_id", F.lit(0).alias("_turn"), F.col("seq").alias("_last"), row.alias("_state"))
        met = now.unionByName(states, allowMissingColumns=True).withColumn("_state", F.last("_state", ignorenulls=True).over(line)).where(F.col("_b").isNotNull())
        of = lambda side, field: F.max(F.when(F.col("_b._side") == side, F.col(f"_state.{field}"))).cast("double")
        both = met.groupBy("_b._board", *(F.col(f"_b.{c}").alias(c) for c in columns)).agg(*(of(n, f).alias(f"{s}_{f}") for n, s in enumerate("ab") for f in ["seq", *fields]))
        path = f"{steps}/round={k}"
        both.drop("_board").mapInArrow(run, schema).write.parquet(path)
        since.append(path)
    return spark.read.schema(schema).parquet(*(f"{steps}/round={k}" for k in range(len(rounds)))) if rounds else spark.createDataFrame([], schema)


def _entry(v: dict, side: str) -> tuple:
    """A side's state at the start of the round: defaults for a newcomer, and the deviation grown over idle rounds."""
    new = np.isnan(v[f"{side}_seq"])
    sigma = np.where(new, BASE_VOLATILITY, v[f"{side}_volatility"])
    rd = np.where(new, MAX_RD, idle(v[f"{side}_rd"], sigma, v["seq"] - v[f"{side}_seq"] - 1))
    return np.where(new, BASE_RATING, v[f"{side}_rating"]), rd, sigma


def two_sided(played: DataFrame) -> DataFrame:
    """seq, player_a, player_b, outcome_a of rated boards, a being the side numbered 0."""
    return played.where("side = 0").select("seq", F.col("player_id").alias("player_a"), F.col("opp_player_id").alias("player_b"), F.col("outcome").alias("outcome_a"))


def forward_pass(played: DataFrame, rounds: list[int], start: DataFrame | None = None) -> DataFrame:
    """RAT-7: player_id, seq, rating, rd, volatility after each board of the rounds; start: states of the rounds before."""
    return fold_rounds(two_sided(played), rounds, ["rating", "rd", "volatility"], lambda v: solved(_entry(v, "a"), _entry(v, "b"), v["outcome_a"]), start=start)


def live_round(played: DataFrame, status: DataFrame, states: DataFrame, seq: int, unknown_hall: int = -1) -> DataFrame:
    """RAT-10: player_id, seq, rating, rd, volatility, carried: one round rated from the states before it. Its players get the
    solved states; every other player with a status row of a hall that plays is carried, the deviation grown."""
    now = played.where(F.col("seq") == seq)
    entry = entry_states(now.select("player_id", "seq", "match_id", "side", "outcome"), states)
    side = lambda k, s: entry.where(F.col("side") == k).select("match_id", *([F.col("outcome")] if k == 0 else []), *(F.col(c).alias(f"{s}_{c}") for c in ("player_id", "rating", "rd", "volatility")))

    def run(batches):
        for batch in batches:
            v = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
            state = lambda s: tuple(v[f"{s}_{c}"].astype(float) for c in ("rating", "rd", "volatility"))  # noqa: B023, E731
            for s, new in zip("ab", solved(state("a"), state("b"), v["outcome"].astype(float)), strict=True):
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(f"{s}_player_id")), *(pa.array(x) for x in new)], ["player_id", "rating", "rd", "volatility"])

    rated = side(0, "a").join(side(1, "b"), "match_id").mapInArrow(run, "player_id string, rating double, rd double, volatility double")
    halls = now.where(F.col("hall_id") != unknown_hall).select("year", "hall_id").distinct()
    idle_ones = status.join(halls, ["year", "hall_id"], "left_semi").select("player_id").distinct().join(now.select("player_id"), "player_id", "left_anti")
    before = states.where(F.col("seq") < seq)
    carried = at_rounds(idle_ones.withColumn("seq", F.lit(seq).cast("long")), before).select("player_id", "rating", "rd", "volatility", F.lit(True).alias("carried"))
    return rated.withColumn("carried", F.lit(False)).unionByName(carried).withColumn("seq", F.lit(seq).cast("long"))


# -- RAT-8: passes with fixed opponents -------------------------------------------------------------------------------


def fixed_pass(played: DataFrame, trajectory: DataFrame) -> DataFrame:
    """One more pass: each player's boards in order against the opponents' ratings of the trajectory, from the defaults.

    Players are dealt out by hash and sorted; a task folds many players at a time, the first boards of all of them
    together, then the second ones.
    """
    opp = trajectory.select(F.col("player_id").alias("opp_player_id"), "seq", F.col("rating").alias("opp_rating"), F.col("rd").alias("opp_rd"))
    rows = played.select("player_id", "opp_player_id", "seq", "outcome").join(opp, ["opp_player_id", "seq"])
    ordered = rows.select("player_id", "seq", "outcome", "opp_rating", "opp_rd").repartition("player_id").sortWithinPartitions("player_id", "seq")
    names = ["player_id", "seq", "rating", "rd", "volatility"]

    def fold(table: pa.Table) -> pa.RecordBatch:
        ids = np.array(table["player_id"].to_pylist(), object)
        seq, outcome, opp_rating, opp_rd = (table[c].to_numpy().astype(float) for c in ("seq", "outcome", "opp_rating", "opp_rd"))
        start = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        length = np.diff(np.append(start, len(ids)))
        state = [np.full(len(start), BASE_RATING), np.full(len(start), MAX_RD), np.full(len(start), BASE_VOLATILITY)]
        out = np.zeros((3, len(ids)))
        for k in range(int(length.max(initial=0))):
            on = np.flatnonzero(length > k)
            at = start[on] + k
            gap = seq[at] - seq[at - 1] - 1 if k else np.zeros(len(at))
            rd = idle(state[1][on], state[2][on], gap)
            for s, v in zip(state, updated(state[0][on], rd, state[2][on], opp_rating[at], opp_rd[at], outcome[at]), strict=True):
                s[on] = v
            for row, s in zip(out, state, strict=True):
                row[at] = s[on]
        return pa.RecordBatch.from_arrays([table["player_id"].combine_chunks(), pa.array(seq.astype(np.int64)), *(pa.array(r) for r in out)], names)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 50_000:  # all but the last player, whose rows may go on
                table = pa.Table.from_batches(held)
                ids = table["player_id"].to_pylist()
                cut = next((i for i in range(len(ids) - 1, 0, -1) if ids[i - 1] != ids[-1]), 0)
                if cut:
                    yield fold(table.slice(0, cut).combine_chunks())
                    held = table.slice(cut).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            if table.num_rows:
                yield fold(table)

    return ordered.mapInArrow(run, "player_id string, seq long, rating double, rd double, volatility double")


def whole_history(played: DataFrame, rounds: list[int], passes: int = PASSES, first: DataFrame | None = None) -> DataFrame:
    """RAT-8: the trajectory of the last pass."""
    out = forward_pass(played, rounds) if first is None else first
    for _ in range(passes - 1):
        out = written(fixed_pass(played, out))
    return out


# -- RAT-9 to 12 ------------------------------------------------------------------------------------------------------


def at_rounds(points: DataFrame, trajectory: DataFrame) -> DataFrame:
    """points (player_id, seq, others) with the ratings after that round: the last board's, the deviation grown since;
    defaults before the first board."""
    marks = points.columns
    kind = "struct<last:bigint,rating:double,rd:double,volatility:double>"
    p = points.select("player_id", "seq", F.struct(*marks).alias("_p"), F.lit(None).cast(kind).alias("_t"), F.lit(1).alias("_turn"))
    t = trajectory.select("player_id", "seq", F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), F.struct(F.col("seq").alias("last"), "rating", "rd", "volatility").alias("_t"), F.lit(0).alias("_turn"))
    w = Window.partitionBy("player_id").orderBy("seq", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    line = p.unionByName(t).withColumn("_s", F.last("_t", ignorenulls=True).over(w)).where(F.col("_p").isNotNull())
    sigma = F.coalesce("_s.volatility", F.lit(BASE_VOLATILITY))
    rd = F.coalesce(idle_rd("_s.rd", "_s.volatility", F.col("_p.seq") - F.col("_s.last")), F.lit(MAX_RD))
    return line.select("_p.*", F.coalesce("_s.rating", F.lit(BASE_RATING)).alias("rating"), rd.alias("rd"), sigma.alias("volatility"))


def entry_states(points: DataFrame, trajectory: DataFrame) -> DataFrame:
    """points (player_id, seq, others) with the ratings at the start of that round."""
    before = points.withColumnRenamed("seq", "_seq").withColumn("seq", F.col("_seq") - 1)
    return at_rounds(before, trajectory).drop("seq").withColumnRenamed("_seq", "seq")


def distilled(boards: DataFrame, rounds: list[int]) -> DataFrame:
    """RAT-12: the rating that says what a model says: each board shifts both players by half of the gap between the
    model's difference and theirs. boards: seq, player_a, player_b, outcome_a and expected (the model's score of a)."""

    def solve(v):
        a, b = (np.where(np.isnan(v[f"{s}_rating"]), BASE_RATING, v[f"{s}_rating"]) for s in "ab")
        e = np.clip(v["expected"], 1e-6, 1 - 1e-6)
        shift = (S.SCALE * np.log(e / (1 - e)) - (a - b)) / 2
        return [a + shift], [b - shift]

    return fold_rounds(boards, rounds, ["rating"], solve, extra=("expected",))
