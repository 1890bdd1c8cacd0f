"""Boosted trees of boards, grown in one stage of tasks: bins and margins stay in a task's memory from tree to tree.

A unit is a training cut with an experience weight: all ridges and stages over the boards before one round. Its rows are
those before the round, which train, and those of the round, which are predicted. Units of up to UNIT_ROWS boards are groups
of one grouped map, side by side, each grown in its task. A larger unit is a barrier stage of its own: each task holds a block of its
rows, and the blocks exchange histograms, whose size depends on nodes, features and bins alone, so that all tasks
choose the same splits. Either way a unit takes no job for a tree or level.

Features are cut into bins by the values of the training rows alone, so no fit changes when later rounds arrive.

A fit has two stages: draws over sym, and wins over anti for decisive boards, where each board counts from both sides and
a prediction is half the difference of both, so that swapping the sides swaps the result.
"""

from __future__ import annotations

import base64
import math
import pickle
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leaguelens.operators import features as X
from leaguelens.operators.checkpoints import written
from leaguelens.operators.folds import tag

# Fixed values of the method.
RATE, MAX_TREES, FEW_TREES, PATIENCE, DEPTH = 0.1, 200, 40, 12, 3
LEAST_WEIGHT, LEAST_GAIN, LEAST_HESSIAN = 4.0, 1e-4, 1e-6
VALIDATION, VALIDATION_ROUNDS = 0.2, 6
#: Bins of a feature; one with fewer different values is cut at each gap, as an exact search would.
BINS, MISSING = 64, 255
#: Boards of a task at most. A unit of more is spread over tasks that exchange histograms.
UNIT_ROWS = 200_000
DRAW, WIN = "draw", "win"


# --- one tree -------------------------------------------------------------------------------------------------------


def split_gains(rows: DataFrame, ridge: float = 1.0, least_weight: float = LEAST_WEIGHT, least_gain: float = 0.0) -> DataFrame:
    """MDL-4: the gain of every split of one node: feature, threshold, gain, left, right (leaf values), left_weight.

    rows: x (array, no missing value), g, h. Sums of each value of each feature are running totals in its order; the gaps
    between neighbouring values are the thresholds. Splits with less than least_weight on a side are left out.
    """
    by_value = rows.select(F.posexplode("x").alias("feature", "value"), "g", "h").groupBy("feature", "value").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    upto, every = Window.partitionBy("feature").orderBy("value").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("feature")
    order = Window.partitionBy("feature").orderBy("value")
    s = by_value.select("feature", ((F.col("value") + F.lead("value").over(order)) / 2).alias("threshold"), F.sum("g").over(upto).alias("gl"), F.sum("h").over(upto).alias("hl"), F.sum("g").over(every).alias("gt"), F.sum("h").over(every).alias("ht"))
    s = s.where("threshold is not null").withColumns({"gr": F.col("gt") - F.col("gl"), "hr": F.col("ht") - F.col("hl")})
    part = lambda g, h: F.col(g) * F.col(g) / (F.col(h) + ridge)
    gain = 0.5 * (part("gl", "hl") + part("gr", "hr") - part("gt", "ht")) - least_gain
    good = s.where((F.col("hl") >= least_weight) & (F.col("hr") >= least_weight))
    return good.select("feature", "threshold", gain.alias("gain"), (-F.col("gl") / (F.col("hl") + ridge)).alias("left"), (-F.col("gr") / (F.col("hr") + ridge)).alias("right"), F.col("hl").alias("left_weight"))


@dataclass
class Tree:
    """A complete binary tree by arrays over its nodes: feature (-1: a leaf), the last bin that goes left, whether a
    missing value goes left, and the node's own value."""

    feature: np.ndarray = field(default_factory=lambda: np.full(2 ** (DEPTH + 1) - 1, -1, np.int16))
    cut: np.ndarray = field(default_factory=lambda: np.zeros(2 ** (DEPTH + 1) - 1, np.uint8))
    missing_left: np.ndarray = field(default_factory=lambda: np.zeros(2 ** (DEPTH + 1) - 1, bool))
    value: np.ndarray = field(default_factory=lambda: np.zeros(2 ** (DEPTH + 1) - 1))

    def below(self, bins: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The nodes of the rows one level below `node`; a leaf's rows stay."""
        f = self.feature[node]
        b = bins[np.arange(len(bins)), np.maximum(f, 0)]
        left = np.where(b == MISSING, self.missing_left[node], b <= self.cut[node])
        return np.where(f < 0, node, 2 * node + 2 - left)

    def nodes(self, bins: np.ndarray, levels: int = DEPTH) -> np.ndarray:
        """The node of each row after so many levels."""
        node = np.zeros(len(bins), np.int64)
        for _ in range(levels):
            node = self.below(bins, node)
        return node


def best_split(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int, int, bool]:
    """(gain, feature, cut, missing left) of the best split of a node by its sums (features x bins, the last bin missing
    values); gain 0 if none pays. Ties go to the first feature, the lowest cut, then missing to the right."""
    total_g, total_h = g[0].sum(), h[0].sum()
    low_g, low_h = np.cumsum(g[:, :-1], axis=1)[:, :-1], np.cumsum(h[:, :-1], axis=1)[:, :-1]
    best = (0.0, -1, 0, False)
    sides = []
    for left in (False, True):
        a, b = low_g + left * g[:, -1:], low_h + left * h[:, -1:]
        c, d = total_g - a, total_h - b
        gain = 0.5 * (a * a / (b + ridge) + c * c / (d + ridge) - total_g**2 / (total_h + ridge)) - LEAST_GAIN
        empty = (low_h <= 0) | (h[:, :-1].sum(axis=1, keepdims=True) - low_h <= 1e-12)  # a cut must separate values
        sides.append(np.where((b >= LEAST_WEIGHT) & (d >= LEAST_WEIGHT) & ~empty, gain, 0.0))
    gains = np.stack(sides, axis=2)
    at = int(np.argmax(np.round(gains, 12)))
    f, cut, left = np.unravel_index(at, gains.shape)
    if gains.size and gains[f, cut, left] > 0:
        best = (float(gains[f, cut, left]), int(f), int(cut), bool(left))
    return best


# --- many fits ------------------------------------------------------------------------------------------------------


@dataclass
class Fit:
    """One stage of one model: learned from rounds before `split`, stopped by those from there to `before`."""

    stage: str
    n0: float
    ridge: float
    before: int
    split: int
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    grown: Tree | None = None
    least: float = np.inf
    best: int = 0
    done: bool = False

    def margin(self, bins: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
        """Served margin of rows; other: their bins with the sides swapped, in the win stage."""
        one = lambda x: sum((RATE * t.value[t.nodes(x)] for t in self.trees), np.zeros(len(x)))
        return self.base + one(bins) if other is None else (one(bins) - one(other)) / 2


@dataclass
class Model:
    """MDL-5: trees of both stages, and the edges that cut features into bins, by experience weight n0."""

    edges: dict[tuple[str, float], list[np.ndarray]]
    draw: Fit
    win: Fit


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.where(np.isnan(x[:, j]), MISSING, np.searchsorted(e, x[:, j], "right"))
    return out


def _edges(values: np.ndarray) -> np.ndarray:
    """Cuts between different values, BINS - 2 of them at most."""
    v = np.unique(values[~np.isnan(values)])
    cuts = (v[1:] + v[:-1]) / 2
    return cuts if len(cuts) <= BINS - 2 else np.unique(cuts[np.linspace(0, len(cuts) - 1, BINS - 2).round().astype(int)])



# --- one unit, in its task or tasks ------------------------------------------------------------------------------------


#: What every block of a unit gives to the others, in the order of the blocks.
Gather = Callable[[object], list]


def alone(x: object) -> list:
    return [x]


class Rows:
    """The rows of a stage of one unit, those of training rounds first, ordered by round: bins, labels and the places where
    validation rounds begin and end. A paired row is followed by its board seen from the other side."""

    def __init__(self, bins: np.ndarray, y: np.ndarray, train: int, paired: bool) -> None:
        self.bins, self.y, self.train, self.paired = bins, y, train, paired
        self.flat = np.arange(bins.shape[1]) * BINS + np.minimum(bins[:train], BINS - 1).astype(np.int64)

    def histogram(self, node: np.ndarray, level: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Sums of gradients and Hessians of the training rows by node of the level, feature and bin."""
        n, d = 2**level, self.bins.shape[1]
        spot = self.flat
        if level:
            at = node[: self.train] - (n - 1)
            live = at >= 0
            if not live.all():
                spot, at, g, h = spot[live], at[live], g[live], h[live]
            spot = spot + at[:, None] * (d * BINS)
        spot = spot.ravel()
        return np.stack([np.bincount(spot, np.repeat(v, d), n * d * BINS).reshape(n, d, BINS) for v in (g, h)])

    def loss(self, margin: np.ndarray) -> np.ndarray:
        """Loss of the served margins on the validation rounds, and their rows."""
        m, y = margin[self.train :], self.y[self.train :]
        if self.paired:
            m, y = (m[::2] - m[1::2]) / 2, y[::2]
        loss = np.logaddexp(0, np.where(y > 0.5, -m, m))
        return np.array([loss.sum(), len(loss)])


def boost(fits: list[tuple[Fit, Rows]], gather: Gather, most: int) -> None:
    """MDL-4 and MDL-5: grows the trees of all fits of a unit side by side, in place. `gather` brings the sums of all blocks
    of the unit together: once for a level."""

    def total(own: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        parts = gather(own)
        return own if len(parts) == 1 else {k: sum(p[k] for p in parts) for k in own}

    margins = [np.full(len(rows.y), f.base) for f, rows in fits]
    for _ in range(most + 1):
        live = [k for k, (f, _) in enumerate(fits) if not f.done]
        if not live:
            break
        slopes, nodes = {}, {}
        for k in live:
            f, rows = fits[k]
            p = 1 / (1 + np.exp(-margins[k][: rows.train]))
            slopes[k], nodes[k] = (p - rows.y[: rows.train], np.maximum(p * (1 - p), LEAST_HESSIAN)), np.zeros(len(rows.y), np.int64)
        for level in range(DEPTH):
            now = [k for k in live if not level or (fits[k][0].grown.feature[2 ** (level - 1) - 1 : 2**level - 1] >= 0).any()]
            own = {}
            for k in now:
                f, rows = fits[k]
                if level:
                    nodes[k] = f.grown.below(rows.bins, nodes[k])
                tail = rows.loss(margins[k]) if not level else np.zeros(2)
                own[k] = np.concatenate([rows.histogram(nodes[k], level, *slopes[k]).ravel(), tail])
            for k, sums in total(own).items():
                f = fits[k][0]
                if not sums[:-2].any():
                    f.done = f.done or level == 0  # no rows
                    continue
                if level == 0 and f.before > f.split and f.trees:
                    _judge(f, sums[-2] / max(sums[-1], 1), sums[-1], most)
                elif level == 0:
                    f.done = len(f.trees) >= (most if f.before > f.split else min(most, FEW_TREES))
                if not f.done:
                    _split(f, sums[:-2].reshape(2, 2**level, -1, BINS), level)
            live = [k for k in live if not fits[k][0].done]
        for k in live:
            f, rows = fits[k]
            node = nodes[k]
            for _ in range(DEPTH - 1 if (f.grown.feature[:1] < 0).all() else DEPTH):  # rows that a leaf holds stay there
                node = f.grown.below(rows.bins, node)
            f.trees.append(f.grown)
            margins[k] += RATE * f.grown.value[node]
    for f, _ in fits:
        f.grown = None
        if not f.done:
            f.done, f.trees = True, f.trees[: max(1, f.best)] if f.best else f.trees


def _judge(f: Fit, loss: float, rows: float, most: int) -> None:
    """Early stopping by the loss on the validation rounds; without rows there the fit has a fixed number of trees."""
    if not rows:
        f.done = len(f.trees) >= FEW_TREES
        return
    if loss < f.least - 1e-6:
        f.least, f.best = loss, len(f.trees)
    f.done = len(f.trees) - f.best >= PATIENCE or len(f.trees) >= most
    if f.done:
        f.trees = f.trees[: max(1, f.best)]


def _split(f: Fit, sums: np.ndarray, level: int) -> None:
    first = 2**level - 1
    if level == 0:
        f.grown = Tree()
        g, h = sums[:, 0, 0].sum(axis=-1)
        f.grown.value[0] = -g / (h + f.ridge)
    for n in range(2**level):
        at, (g, h) = first + n, sums[:, n]
        if h[0].sum() < 2 * LEAST_WEIGHT or level and f.grown.feature[(at - 1) // 2] < 0:
            continue
        gain, feature, cut, left = best_split(g, h, f.ridge)
        if gain <= 0:
            continue
        f.grown.feature[at], f.grown.cut[at], f.grown.missing_left[at] = feature, cut, left
        a, b = g[feature, : cut + 1].sum() + left * g[feature, -1], h[feature, : cut + 1].sum() + left * h[feature, -1]
        f.grown.value[2 * at + 1] = -a / (b + f.ridge)
        f.grown.value[2 * at + 2] = -(g[feature].sum() - a) / (h[feature].sum() - b + f.ridge)


def edges_of(columns: list[np.ndarray], gather: Gather) -> list[np.ndarray]:
    """Edges of each feature by its values in the training rows of all blocks: every gap where different values are few,
    else gaps between quantiles."""
    own = []
    for x in columns:
        v = np.sort(x[~np.isnan(x)])
        few = np.unique(v)
        own.append((len(v), few if len(few) < BINS else None, np.quantile(v, np.linspace(0, 1, 2 * BINS + 1), method="lower") if len(v) else v))
    blocks, out = gather(own), []
    for parts in zip(*blocks, strict=True):
        few = np.unique(np.concatenate([p[1] for p in parts])) if all(p[1] is not None for p in parts) else None
        if few is not None and len(few) < BINS or len(parts) == 1:
            out.append(_edges(few if few is not None else parts[0][2]))
        else:  # quantiles of the blocks, each standing for its share of its block's rows
            points, weight = np.concatenate([p[2] for p in parts]), np.concatenate([np.full(len(p[2]), p[0] / max(1, len(p[2]))) for p in parts])
            order = np.argsort(points, kind="stable")
            place = np.cumsum(weight[order]) / weight.sum()
            out.append(_edges(points[order][np.minimum(np.searchsorted(place, np.linspace(0, 1, 2 * BINS + 1)), len(order) - 1)]))
    return out


def _mirrored(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins of each row and, after it, of the row seen from the other side."""
    return np.stack([binned(x, edges), binned(-x, edges)], axis=1).reshape(2 * len(x), -1)


def grown(seq: np.ndarray, outcome: np.ndarray, sym: np.ndarray, anti: np.ndarray, before: int, n0: float, configs: list[tuple[str, float]], gather: Gather, most: int = MAX_TREES) -> dict[str, Model]:
    """The models of one unit, by name, from one block of its training rows (ordered by round). configs: (name, ridge).
    The last fifth of the rounds stops the boosting if there are VALIDATION_ROUNDS of them."""
    seqs = sorted(set().union(*gather(set(seq.tolist()))))
    split = seqs[int(max(1, len(seqs) * (1 - VALIDATION)))] if len(seqs) >= VALIDATION_ROUNDS else before
    drawn, n = np.sum(gather(np.array([(outcome == 0.5).sum(), len(outcome)])), axis=0)
    share = min(1 - 1e-4, max(1e-4, drawn / max(1, n)))
    won = outcome != 0.5
    # anti is cut alike on both sides of zero, so that a swapped board falls into the mirrored bin
    edges = {(DRAW, n0): edges_of(list(sym.T), gather), (WIN, n0): edges_of([np.concatenate([-x, x]) for x in anti.T], gather)}
    train = int((seq < split).sum())
    draws = Rows(binned(sym, edges[DRAW, n0]), (outcome == 0.5).astype(float), train, False)
    wins = Rows(_mirrored(anti[won], edges[WIN, n0]), np.stack([outcome[won], 1 - outcome[won]], axis=1).ravel(), 2 * int(won[:train].sum()), True)
    models = {name: Model(edges, Fit(DRAW, n0, ridge, before, split, float(np.log(share / (1 - share)))), Fit(WIN, n0, ridge, before, split)) for name, ridge in configs}
    boost([pair for m in models.values() for pair in ((m.draw, draws), (m.win, wins))], gather, most)
    return models


def probabilities(m: Model, sym: np.ndarray, anti: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """MDL-6: p_win, p_draw, p_loss of rows."""
    d = 1 / (1 + np.exp(-m.draw.margin(binned(sym, m.edges[DRAW, m.draw.n0]))))
    e = m.edges[WIN, m.win.n0]
    w = 1 / (1 + np.exp(-m.win.margin(binned(anti, e), binned(-anti, e))))
    return (1 - d) * w, d, (1 - d) * (1 - w)


# --- units on Spark -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Unit:
    """A training cut: the boards before a round, an experience weight, and the size of player vectors (0: none)."""

    number: int
    before: int
    n0: float
    dim: int
    configs: tuple[tuple[str, float], ...]


def units_of(configs: list[tuple], before: list[int]) -> list[Unit]:
    """configs: (name, n0, ridge) or (name, n0, ridge, dim)."""
    keys = sorted({(c[1], c[3] if len(c) > 3 else 0) for c in configs})
    named = {k: tuple((c[0], c[2]) for c in configs if (c[1], c[3] if len(c) > 3 else 0) == k) for k in keys}
    return [Unit(i, r, n0, dim, named[n0, dim]) for i, (r, (n0, dim)) in enumerate((r, k) for r in sorted(before, reverse=True) for k in keys)]


def unit_rows(b: DataFrame, units: list[Unit]) -> DataFrame:
    """The boards of each unit, those of its round included: unit, match_id, seq, outcome_a, who plays, sym and anti."""
    weights = sorted({u.n0 for u in units})
    v = b.select("match_id", "seq", "outcome_a", "a", "b", "round_order", "max_score_norm")
    for w in weights:
        v = X.vectors(v, w, missing_seat=True).withColumnsRenamed({"sym": f"sym{tag(w)}", "anti": f"anti{tag(w)}"})
    every = F.array(*(F.struct(F.lit(u.number).alias("unit"), F.lit(u.before).cast("long").alias("before"), F.lit(u.n0).alias("n0")) for u in units))
    v = v.withColumn("_u", F.explode(F.filter(every, lambda u: u.before >= F.col("seq"))))
    pick = lambda name: F.coalesce(*(F.when(F.col("_u.n0") == w, F.col(f"{name}{tag(w)}")) for w in weights))
    who = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("player_id", "hall_id")]
    return v.select(F.col("_u.unit").alias("unit"), F.col("match_id").cast("long").alias("match_id"), F.col("seq").cast("long").alias("seq"), F.col("outcome_a").cast("double").alias("outcome_a"), *who, pick("sym").alias("sym"), pick("anti").alias("anti"))


_OUT = "model string, before long, fitted binary, match_id long, seq long, outcome double, p_win double, p_draw double, p_loss double, kind string, key string, vector array<double>"


def _worked(table: pa.Table, unit: Unit, gather: Gather, most: int, net: bool, vectors: bool = False) -> pa.Table:
    """One block of a unit: its fitted models, and the predictions of the round's boards. net: player vectors are learned here;
    vectors: they are returned as well."""
    from leaguelens.operators import embedding

    order = np.lexsort((table["match_id"].to_numpy(), table["seq"].to_numpy()))
    table = table.take(pa.array(order)).combine_chunks()
    seq, outcome = table["seq"].to_numpy(), table["outcome_a"].to_numpy()
    wide = lambda c: np.array(table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(len(seq), -1) if len(seq) else np.zeros((0, X.SYM if c == "sym" else X.ANTI))
    sym, anti = wide("sym"), wide("anti")
    n = int((seq < unit.before).sum())
    learned = None
    if unit.dim and net:
        boards = embedding.Boards.of(table)
        learned = embedding.learned(boards.first(n), unit.dim)
        anti = np.concatenate([anti, learned.features(boards)], axis=1)
    models = grown(seq[:n], outcome[:n], sym[:n], anti[:n], unit.before, unit.n0, list(unit.configs), gather, most)
    rows = []
    for name, m in models.items():
        blank = {c: [None] for c in ("match_id", "seq", "outcome", "p_win", "p_draw", "p_loss")}
        rows.append({"model": [name], "before": [unit.before], "fitted": [pickle.dumps((m, learned.dense if learned else None))], **blank})
        p = probabilities(m, sym[n:], anti[n:])
        k = len(seq) - n
        rows.append({"model": [name] * k, "before": [unit.before] * k, "fitted": [None] * k, "match_id": table["match_id"].to_numpy()[n:], "seq": seq[n:], "outcome": outcome[n:], "p_win": p[0], "p_draw": p[1], "p_loss": p[2]})
        if learned and vectors:
            rows += [{"model": [name] * len(held), "before": [unit.before] * len(held), "kind": [kind] * len(held), "key": list(held), "vector": [v.tolist() for v in held.values()]} for kind, held in (("player", learned.players), ("hall", learned.halls))]
    kinds = dict(zip((c.split()[0] for c in _OUT.split(", ")), (pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.string(), pa.string(), pa.list_(pa.float64())), strict=True))
    return pa.concat_tables([pa.table({c: pa.array(r.get(c, [None] * len(r["model"])), t) for c, t in kinds.items()}) for r in rows]) if rows else pa.table({c: pa.array([], t) for c, t in kinds.items()})


def _gathered(x: object) -> list:
    """What every task of a barrier stage gives, in the order of the tasks."""
    from pyspark import BarrierTaskContext

    return [pickle.loads(base64.b64decode(m)) for m in BarrierTaskContext.get().allGather(base64.b64encode(pickle.dumps(x)).decode())]


def worked(b: DataFrame, configs: list[tuple], before: list[int], unit_rows_at_most: int | None = None, net=None, vectors_of: int | None = None) -> DataFrame:
    """Fits a grid before each round of `before`: rows of fitted models and of predictions of those rounds, written once.

    A unit with player vectors learns them from its training rows (MDL-7), unless a net is given, and appends their
    features to anti (MDL-8). vectors_of: the cut whose vectors are returned as rows, if one task learns them.

    A barrier stage needs all its tasks at once, so a unit has no more blocks than the session has cores; executors must
    hold their share of the rows.
    """
    from leaguelens.operators import embedding

    spark, most, at_most = b.sparkSession, MAX_TREES, unit_rows_at_most or UNIT_ROWS
    units = units_of(configs, before)
    if not units:
        return spark.createDataFrame([], _OUT)
    sizes = {r.seq: r.n for r in b.groupBy("seq").agg(F.count("*").alias("n")).collect()}  # rounds
    size = lambda u: sum(n for s, n in sizes.items() if s <= u.before)
    small, large = [u for u in units if size(u) <= at_most], [u for u in units if size(u) > at_most]
    done = []
    if small:
        by = {u.number: u for u in small}

        def one(table: pa.Table) -> pa.Table:
            unit = by[table["unit"][0].as_py()]
            return _worked(table, unit, alone, most, not given, unit.before == vectors_of)

        given = net is not None
        rows = unit_rows(b, small)
        if given:
            rows = embedding.with_features(rows, net).withColumn("anti", F.concat("anti", "embedded")).drop("embedded")
        rows = rows.repartitionByRange(2 * len(small), "unit")  # the latest cuts, which are the largest, begin first and are alone
        done.append(written(rows.groupBy("unit").applyInArrow(one, _OUT)))
    for u in large:
        rows = unit_rows(b, [u])
        if u.dim:
            rows = embedding.with_features(rows, net or embedding.fit(b.where(F.col("seq") < u.before), u.dim, at_most)).withColumn("anti", F.concat("anti", "embedded")).drop("embedded")
        blocks = min(math.ceil(size(u) / at_most), spark.sparkContext.defaultParallelism)

        def block(batches, u=u):
            from pyspark import BarrierTaskContext

            held = [x for x in batches if x.num_rows]
            out = _worked(pa.Table.from_batches(held) if held else empty, u, _gathered, most, False)
            first = BarrierTaskContext.get().partitionId() == 0  # all blocks have the same models
            yield from (out if first else out.filter(pa.compute.is_null(out["fitted"]))).to_batches()

        import pyarrow.compute  # noqa: F401

        empty = rows.limit(0).toArrow()
        done.append(written(rows.repartition(blocks, "match_id").mapInArrow(block, _OUT, barrier=True)))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def fit_rounds(b: DataFrame, configs: list[tuple], before: list[int]) -> tuple[DataFrame, dict[tuple[str, int], Model]]:
    """MDL-5 for a grid: (predictions of the rounds, models by (name, round)); configs: (name, n0, ridge), each fitted on the
    rounds before each of `before`. The models are trees of a few nodes; player vectors aren't among them."""
    out = worked(b, configs, before)
    models = {(r.model, r.before): pickle.loads(bytes(r.fitted))[0] for r in out.where("fitted is not null").select("model", "before", "fitted").collect()}
    for u in units_of(configs, before):  # a round without earlier boards has models without trees
        for name, ridge in u.configs:
            models.setdefault((name, u.before), blank(u.n0, ridge, u.before))
    return predicted(out), models


def blank(n0: float, ridge: float, before: int, extra: int = 0) -> Model:
    """The model of no boards."""
    edges = {(DRAW, n0): [np.zeros(0)] * X.SYM, (WIN, n0): [np.zeros(0)] * (X.ANTI + extra)}
    return Model(edges, Fit(DRAW, n0, ridge, before, before, float(np.log(1e-4 / (1 - 1e-4)))), Fit(WIN, n0, ridge, before, before))


def predicted(out: DataFrame) -> DataFrame:
    """model, match_id, seq, outcome, p_win, p_draw, p_loss of the rows of `worked`: each round's boards by the models fitted
    on those before it."""
    return out.where("match_id is not null").select("model", "match_id", "seq", "outcome", "p_win", "p_draw", "p_loss")


def predict(b: DataFrame, models: dict[str, Model], keys: list[str], extra: str | None = None) -> DataFrame:
    """MDL-6: keys and model, p_win, p_draw, p_loss of each board by each of the named models. extra: a column of b with
    features that are appended to anti (MDL-8)."""
    weights = tuple(sorted({m.win.n0 for m in models.values()}))
    v = b
    for w in weights:
        v = X.vectors(v, w, missing_seat=True).withColumnsRenamed({"sym": f"sym{tag(w)}", "anti": f"anti{tag(w)}"})
    shared = b.sparkSession.sparkContext.broadcast(models)
    kinds = {f.name: f.dataType.simpleString() for f in b.schema.fields}

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            for name, m in shared.value.items():
                k = len(keys) + 2 * weights.index(m.win.n0)
                sym, anti = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for i in (k, k + 1))
                if extra:
                    more = batch.column(len(keys) + 2 * len(weights)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    anti = np.concatenate([anti, more], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *(pa.array(x) for x in ([name] * batch.num_rows, *probabilities(m, sym, anti)))], [*keys, "model", "p_win", "p_draw", "p_loss"])

    names = [f"{c}{tag(w)}" for w in weights for c in ("sym", "anti")]
    return v.select(*keys, *names, *([extra] if extra else [])).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", model string, p_win double, p_draw double, p_loss double")
