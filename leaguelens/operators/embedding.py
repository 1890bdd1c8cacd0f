"""Vectors of players and halls, learned by a small net from who beat whom.

raw(A, B) is a layer of UNITS tanh units over both players' and both halls' vectors; the score of a board is
(raw(A, B) - raw(B, A)) / 2, so swapping the sides flips its sign, and it can tell cycles that no rating can. The net
learns from decisive boards, each from both sides, by full gradient steps with momentum; the last fifth of the rounds
stops it. A vector starts from a hash of its key, so a player's start doesn't depend on who else plays, and only
those that play in the fitted rounds move.

A training set of up to UNIT_ROWS boards is learned in one task. For a larger one vectors and their momentum are a table that is
joined to the boards in each epoch; tasks add up gradients by key, and only the small dense layer and losses reach the
driver. Both ways give the same numbers but for the order of sums.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaguelens.operators.checkpoints import written

# Fixed values of the method.
HALL_DIM, UNITS, L2, RATE, MOMENTUM = 2, 12, 1e-3, 0.05, 0.9
EPOCHS, FEW_EPOCHS, PATIENCE, LEAST_FALL = 120, 60, 10, 1e-6
VALIDATION, VALIDATION_ROUNDS, SPREAD, SEED = 0.2, 6, 0.1, 42
UNIT_ROWS = 200_000
#: Rows of a step's layer that are worked at a time, so that what stands in between stays in a core's cache.
BLOCK = 2048


def start(key: str, dim: int) -> np.ndarray:
    """The vector that a key starts from."""
    return np.random.default_rng([SEED, zlib.crc32(key.encode())]).normal(size=dim) * SPREAD


@dataclass
class Dense:
    """Weights of the hidden layer and of the output."""

    dim: int
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @staticmethod
    def new(dim: int) -> Dense:
        rng, size = np.random.default_rng(SEED), 2 * dim + 2 * HALL_DIM
        return Dense(dim, rng.normal(size=(UNITS, size)) / np.sqrt(size), np.zeros(UNITS), rng.normal(size=UNITS) / np.sqrt(UNITS), np.zeros(1))

    def parts(self) -> list[np.ndarray]:
        return [self.w1, self.b1, self.w2, self.b2]

    def copy(self) -> Dense:
        return Dense(self.dim, *(x.copy() for x in self.parts()))

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for i in range(0, len(x), BLOCK):
            out[i : i + BLOCK] = np.tanh(x[i : i + BLOCK] @ self.w1.T + self.b1) @ self.w2 + self.b2[0]
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Sums of the gradients of the dense weights, and each row's gradient of its inputs."""
        sums, dx = [np.zeros_like(w) for w in self.parts()], np.empty_like(x)
        for i in range(0, len(x), BLOCK):
            part = x[i : i + BLOCK]
            h = np.tanh(part @ self.w1.T + self.b1)
            off = 1 / (1 + np.exp(-(h @ self.w2 + self.b2[0]))) - y[i : i + BLOCK]
            dz = off[:, None] * self.w2 * (1 - h * h)
            for total, own in zip(sums, (dz.T @ part, dz.sum(axis=0), off @ h, off.sum()), strict=True):
                total += own
            np.matmul(dz, self.w1, out=dx[i : i + BLOCK])
        return sums, dx

    def step(self, speed: list[np.ndarray], sums: list[np.ndarray], n: int) -> None:
        for k, (w, v, g) in enumerate(zip(self.parts(), speed, sums, strict=True)):
            v *= MOMENTUM
            v -= RATE * (g / max(1, n) + (L2 * w if k < 3 else 0))  # the output's bias has no penalty
            w += v

    def features(self, e: tuple[np.ndarray, ...]) -> np.ndarray:
        """MDL-8: score, difference of the players' vectors, difference of the halls' vectors. The score has twelve places, so
        that it is the same in batches of any size."""
        a, b, ha, hb = e
        score = np.round((self.raw(np.concatenate([a, b, ha, hb], axis=1)) - self.raw(np.concatenate([b, a, hb, ha], axis=1))) / 2, 12)
        return np.concatenate([score[:, None], a - b, ha - hb], axis=1)


def loss(raw: np.ndarray, y: np.ndarray) -> np.ndarray:
    p = 1 / (1 + np.exp(-raw))
    return -np.log(np.maximum(np.where(y > 0.5, p, 1 - p), 1e-12))


def split_of(seqs: list[int]) -> int | None:
    """The first validation round of the decisive rounds; None if there are too few."""
    seqs = sorted(seqs)
    return seqs[int(max(1, len(seqs) * (1 - VALIDATION)))] if len(seqs) >= VALIDATION_ROUNDS else None


class Stop:
    """Early stopping: keeps what had the least loss on the validation rounds."""

    def __init__(self, held_out: bool) -> None:
        self.held_out, self.least, self.since, self.best = held_out, np.inf, 0, None
        self.epochs = EPOCHS if held_out else FEW_EPOCHS

    def seen(self, value: float, state) -> bool:
        """True if training ends. state: a function that copies what is to be kept."""
        if value < self.least - LEAST_FALL:
            self.least, self.since, self.best = value, 0, state()
        else:
            self.since += 1
        return self.since >= PATIENCE


# --- in one task --------------------------------------------------------------------------------------------------------


@dataclass
class Boards:
    """Who plays whom: keys of players and halls by side, as text, rounds and outcomes of side a."""

    players: tuple[np.ndarray, np.ndarray]
    halls: tuple[np.ndarray, np.ndarray]
    seq: np.ndarray
    outcome: np.ndarray

    @staticmethod
    def of(table: pa.Table) -> Boards:
        text = lambda c: np.array([str(x) for x in table[c].to_pylist()], object)
        return Boards((text("a_player_id"), text("b_player_id")), (text("a_hall_id"), text("b_hall_id")), table["seq"].to_numpy(), table["outcome_a"].to_numpy())

    def first(self, n: int) -> Boards:
        return self.where(np.arange(len(self.seq)) < n)

    def where(self, keep: np.ndarray) -> Boards:
        return Boards(tuple(x[keep] for x in self.players), tuple(x[keep] for x in self.halls), self.seq[keep], self.outcome[keep])


@dataclass
class Learned:
    """A net in memory: dense weights and the vectors of the players and halls of its boards."""

    dense: Dense
    players: dict[str, np.ndarray]
    halls: dict[str, np.ndarray]

    def features(self, boards: Boards) -> np.ndarray:
        """Those of players or halls that the net doesn't know are zeros."""
        none, nowhere = np.zeros(self.dense.dim), np.zeros(HALL_DIM)
        of = lambda keys, held, other: np.array([held.get(k, other) for k in keys]).reshape(len(keys), len(other))
        a, b = (of(k, self.players, none) for k in boards.players)
        ha, hb = (of(k, self.halls, nowhere) for k in boards.halls)
        return self.dense.features((a, b, ha, hb))


def learned(boards: Boards, dim: int) -> Learned:
    """MDL-7: the net of boards that one task holds."""
    dense = Dense.new(dim)
    # keys in order, and where each side's keys are among them
    names, codes = zip(*(np.unique(np.concatenate(k), return_inverse=True) if len(boards.seq) else (np.zeros(0, object), np.zeros(0, int)) for k in (boards.players, boards.halls)), strict=True)
    sizes = (dim, HALL_DIM)
    table = [np.array([start(f"{kind}:{k}", d) for k in own]).reshape(len(own), d) for kind, own, d in zip(("player", "hall"), names, sizes, strict=True)]
    won = boards.outcome != 0.5
    if won.any():
        decisive, places = boards.where(won), [[c[won] for c in np.split(own, 2)] for own in codes]
        order = np.lexsort((decisive.outcome, *(c for own in places for c in own), decisive.seq))  # so that sums don't depend on the order of the rows
        decisive, places = decisive.where(order), [[c[order] for c in own] for own in places]
        split = split_of(np.unique(decisive.seq).tolist())
        aside = decisive.seq >= split if split is not None else np.zeros(len(decisive.seq), bool)

        def mirrored(keep: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
            at = [np.concatenate([p[s][keep], p[1 - s][keep]]) for p in places for s in (0, 1)]
            return at, np.concatenate([decisive.outcome[keep], 1 - decisive.outcome[keep]])

        cuts = np.cumsum([0, dim, dim, HALL_DIM, HALL_DIM])

        def inputs(at: list[np.ndarray], out: np.ndarray) -> np.ndarray:
            """The vectors of both players and halls, into `out`, whose place is the same in every epoch."""
            for k, spot in enumerate(at):
                out[:, cuts[k] : cuts[k + 1]] = table[k // 2][spot]
            return out

        (fit_at, fit_y), (val_at, val_y) = mirrored(~aside), mirrored(aside)
        seen = [np.unique(np.concatenate(fit_at[:2])), np.unique(np.concatenate(fit_at[2:]))]
        speed, speeds = [np.zeros_like(x) for x in dense.parts()], [np.zeros_like(x) for x in table]
        stop, fit_x, val_x = Stop(bool(aside.any())), np.empty((len(fit_y), cuts[-1])), np.empty((len(val_y), cuts[-1]))
        for _ in range(stop.epochs):
            sums, dx = dense.gradients(inputs(fit_at, fit_x), fit_y)
            for k in (0, 1):
                g = sum(np.stack([np.bincount(fit_at[2 * k + s], dx[:, cuts[2 * k + s] + j], len(table[k])) for j in range(sizes[k])], axis=1) for s in (0, 1))
                own = seen[k]
                speeds[k][own] = MOMENTUM * speeds[k][own] - RATE * (g[own] / len(fit_y) + L2 * table[k][own])
                table[k][own] += speeds[k][own]
            dense.step(speed, sums, len(fit_y))
            if stop.held_out and stop.seen(float(loss(dense.raw(inputs(val_at, val_x)), val_y).mean()), lambda: (dense.copy(), [t.copy() for t in table])):
                break
        if stop.best:
            dense, table = stop.best
    return Learned(dense, *(dict(zip(own.tolist(), t, strict=True)) for own, t in zip(names, table, strict=True)))


# --- on Spark -----------------------------------------------------------------------------------------------------------


@dataclass
class Net:
    """A net whose vectors are a table (kind: player or hall, key, vector); only the dense weights are held here."""

    dense: Dense
    vectors: DataFrame


_VECTORS = "kind string, key string, vector array<double>"


def _keys(b: DataFrame) -> DataFrame:
    """seq, outcome_a and who plays, by boards with structs a and b or with the columns of boosting.unit_rows."""
    if "a_player_id" in b.columns:
        return b
    return b.select("seq", "outcome_a", *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("player_id", "hall_id")))


def fit(b: DataFrame, dim: int, unit_rows: int = UNIT_ROWS) -> Net:
    """MDL-7: learns vectors of `dim` numbers from boards. Boards without a winner tell nothing; their players' vectors stay
    as they started. An empty table gives a net without vectors."""
    rows = _keys(b).select(F.col("seq").cast("long").alias("seq"), F.col("outcome_a").cast("double").alias("outcome_a"), *(F.col(f"{s}_{c}").cast("string").alias(f"{s}_{c}") for s in "ab" for c in ("player_id", "hall_id")))
    rows = written(rows)
    if rows.count() > unit_rows:
        return spread(rows, dim)

    def one(table: pa.Table) -> pa.Table:
        net = learned(Boards.of(table), dim)
        kinds = ["player"] * len(net.players) + ["hall"] * len(net.halls) + ["dense"]
        vectors = [*(v.tolist() for v in (*net.players.values(), *net.halls.values())), None]
        return pa.table({"kind": kinds, "key": [*net.players, *net.halls, ""], "vector": pa.array(vectors, pa.list_(pa.float64())), "dense": pa.array([None] * (len(kinds) - 1) + [pickle.dumps(net.dense)], pa.binary())})

    out = written(rows.groupBy(F.lit(0).alias("_unit")).applyInArrow(lambda t: one(t.drop_columns("_unit") if "_unit" in t.column_names else t), _VECTORS + ", dense binary"))
    dense = out.where("kind = 'dense'").select("dense").collect()
    return Net(pickle.loads(bytes(dense[0].dense)) if dense else Dense.new(dim), out.where("kind <> 'dense'").select("kind", "key", "vector"))


def _joined(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """rows with the vectors of both players and halls as a, b, ha, hb; null for unknown ones."""
    for kind, column, name in (("player", "a_player_id", "a"), ("player", "b_player_id", "b"), ("hall", "a_hall_id", "ha"), ("hall", "b_hall_id", "hb")):
        own = vectors.where(F.col("kind") == kind).select(F.col("key").alias(f"_{column}"), F.col("vector").alias(f"_v{name}"))
        rows = rows.join(own, F.col(column).cast("string") == F.col(f"_{column}"), "left").drop(f"_{column}")
    return rows


def _inputs(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, ...]:
    def one(name: str, d: int) -> np.ndarray:
        c = batch.column(batch.schema.get_field_index(name))
        out = np.zeros((batch.num_rows, d))
        known = np.asarray(c.is_valid())
        out[known] = c.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        return out

    return one("_va", dim), one("_vb", dim), one("_vha", HALL_DIM), one("_vhb", HALL_DIM)


def with_features(rows: DataFrame, net: Net, name: str = "embedded") -> DataFrame:
    """MDL-8: rows (with the keys of both sides) and an array of the interaction features; unknown players count as zeros."""
    dense, columns = net.dense, rows.columns
    held = _joined(rows, net.vectors)

    def run(batches):
        for batch in batches:
            more = dense.features(_inputs(batch, dense.dim))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(more.tolist(), pa.list_(pa.float64()))], [*columns, name])

    return held.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def spread(rows: DataFrame, dim: int, epochs: int | None = None) -> Net:
    """MDL-7 for any number of boards and players. Each epoch joins the vectors to the boards, adds up gradients by key and
    writes the vectors and their momentum anew, so that a plan never grows and a lost executor costs one epoch."""
    spark = rows.sparkSession
    decisive = written(rows.where("outcome_a <> 0.5").select("seq", "outcome_a", "a_player_id", "b_player_id", "a_hall_id", "b_hall_id"))
    split = split_of([r.seq for r in decisive.select("seq").distinct().collect()])  # rounds
    keys = rows.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"{s}_{k}_id").alias("key")) for s in "ab" for k in ("player", "hall")))).alias("k")).select("k.*").distinct()

    def begin(batches):
        for batch in batches:
            kinds, names = (batch.column(i).to_pylist() for i in (0, 1))
            vectors = [start(f"{k}:{n}", dim if k == "player" else HALL_DIM).tolist() for k, n in zip(kinds, names, strict=True)]
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vectors, kind), pa.array([[0.0] * len(v) for v in vectors], kind)], ["kind", "key", "vector", "speed"])

    state = written(keys.mapInArrow(begin, _VECTORS + ", speed array<double>"))
    dense = Dense.new(dim)
    n = 2 * (decisive if split is None else decisive.where(F.col("seq") < split)).count()
    speed, stop = [np.zeros_like(x) for x in dense.parts()], Stop(split is not None)
    if not n:
        return Net(dense, state.select("kind", "key", "vector"))
    for epoch in range(min(stop.epochs, epochs or stop.epochs) + 1):
        def run(batches, now=dense.copy(), last=epoch == min(stop.epochs, epochs or stop.epochs)):
            total, grads, out = None, {}, np.zeros(2)
            for batch in batches:
                if not batch.num_rows:
                    continue
                y, seq = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("outcome_a", "seq"))
                a, b, ha, hb = _inputs(batch, dim)
                names = {c: np.array(batch.column(batch.schema.get_field_index(c)).to_pylist(), object) for c in ("a_player_id", "b_player_id", "a_hall_id", "b_hall_id")}
                train = np.ones(len(y), bool) if split is None else seq < split
                for x, t, s in ((np.concatenate([a, b, ha, hb], axis=1), y, "ab"), (np.concatenate([b, a, hb, ha], axis=1), 1 - y, "ba")):
                    if not train.all():
                        v = loss(now.raw(x[~train]), t[~train])
                        out += v.sum(), len(v)
                    if last or not train.any():
                        continue
                    sums, dx = now.gradients(x[train], t[train])
                    total = sums if total is None else [p + q for p, q in zip(total, sums, strict=True)]
                    cuts = np.split(dx, np.cumsum([dim, dim, HALL_DIM]), axis=1)
                    for kind, at in (("player", 0), ("hall", 2)):
                        keys, spot = np.unique(np.concatenate([names[f"{side}_{kind}_id"][train] for side in s]), return_inverse=True)
                        own = np.zeros((len(keys), cuts[at].shape[1]))
                        np.add.at(own, spot, np.concatenate(cuts[at : at + 2]))
                        for key, g in zip(keys.tolist(), own, strict=True):
                            grads[kind, key] = grads[kind, key] + g if (kind, key) in grads else g
            parts = [*((k, n, g.tolist()) for (k, n), g in grads.items()), ("loss", "", out.tolist())]
            if total is not None:
                parts.append(("dense", "", np.concatenate([x.ravel() for x in total]).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts]), pa.array([p[1] for p in parts]), pa.array([p[2] for p in parts], pa.list_(pa.float64()))], ["kind", "key", "g"])

        each = _joined(decisive, state).mapInArrow(run, "kind string, key string, g array<double>").select("kind", "key", F.posexplode("g").alias("i", "v"))
        sums = written(each.groupBy("kind", "key", "i").agg(F.sum("v").alias("v")).groupBy("kind", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s.v).alias("g")))
        small = {r.kind: np.array(r.g) for r in sums.where("kind in ('dense', 'loss')").collect()}  # the dense layer and two numbers
        if epoch and stop.held_out and stop.seen(float(small["loss"][0] / max(1.0, small["loss"][1])), lambda: (dense.copy(), state)):  # noqa: B023
            break
        if "dense" not in small:
            break
        cuts = np.split(small["dense"], np.cumsum([x.size for x in dense.parts()])[:-1])
        dense = dense.copy()
        dense.step(speed, [c.reshape(x.shape) for c, x in zip(cuts, dense.parts(), strict=True)], n)
        g = F.coalesce("g", F.transform("vector", lambda v: v * 0.0))
        after = state.join(sums.where("kind not in ('dense', 'loss')"), ["kind", "key"], "left").withColumn("_m", F.when(F.col("g").isNull(), F.col("speed")).otherwise(F.zip_with("speed", F.zip_with(g, "vector", lambda q, v: q / n + L2 * v), lambda m, q: MOMENTUM * m - RATE * q)))
        moved = F.when(F.col("g").isNull(), F.col("vector")).otherwise(F.zip_with("vector", "_m", lambda v, m: v + m))
        state = written(after.select("kind", "key", moved.alias("vector"), F.col("_m").alias("speed")))
    if stop.best:
        dense, state = stop.best
    return Net(dense, state.select("kind", "key", "vector"))
