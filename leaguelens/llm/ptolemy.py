"""Centroid clustering of integer vectors, with Ptolemy's inequality over pivot pairs to leave out centroids.

For any pivots p and q, d(x, c) * d(p, q) >= |d(x, p) * d(c, q) - d(x, q) * d(c, p)|. Every vector's distances to all pivots
are computed once and kept as a column; centroids, which are few, get theirs in each round. Centroid j is bounded by pairs
of pivot j with a far point and with the pivots next in number. The far point, from which all vectors look alike, makes a
bound that falls short by no more than the centroid's way from its pivot; other pairs do better for vectors that are near
the second pivot. Pivots are the first centroids, then once more those of round PIVOT_ROUNDS[1], as those means stay
where they are by and large, while the first vectors don't.

Bounds are lowered by more than their rounding error. A vector is compared exactly, in integers, with the centroid of
least bound and then with those whose bound isn't above that distance.

A round is one pass: tasks add up the vectors of each centroid, and only those sums are shuffled. The driver holds the
centroids and nothing else.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaguelens.llm.common import bounded_batches, checkpointed

SCALE, CLUSTERS, ROUNDS, DIMS = 256, 40, 5, 64
#: Rounds before which the centroids become the pivots. Between them pivots and their distances are fixed.
PIVOT_ROUNDS = (0, 1)
#: Other pivots that are paired with a centroid's own one, besides the far point.
PARTNERS = 3
#: Components below this have squared distances that floating point holds exactly, at up to 2^11 components; those of
#: vectors with larger ones are taken from Python's integers.
NARROW = 1 << 20


def quantised(vector: list[float]) -> list[int]:
    """floor(SCALE * x) of each component, exactly for any finite one."""
    return [int(np.floor(SCALE * x)) if abs(x) < 1e300 else int(x) * SCALE for x in vector]


class Vectors:
    """Vectors of a batch: `rows`, those whose components are below NARROW, as floating point; `wide`, the others by place."""

    def __init__(self, packed: list[bytes], dims: int) -> None:
        self.n = len(packed)
        plain = [i for i, b in enumerate(packed) if len(b) == 4 * dims]
        self.at = np.array(plain, np.int64)
        self.rows = np.frombuffer(b"".join(packed[i] for i in plain), "<i4").reshape(len(plain), dims).astype(np.float64)
        self.wide = {i: [int(v) for v in packed[i][1:].split(b",")] for i in set(range(self.n)) - set(plain)}


def packed(whole: list[int]) -> bytes:
    """Four bytes a component, or as text after a mark if one is too large; no such text has the length of the others."""
    if max(map(abs, whole), default=0) < NARROW:
        return np.array(whole, "<i4").tobytes()
    text = b"w" + b",".join(b"%d" % v for v in whole)
    return text + b" " * (len(text) == 4 * len(whole))


def unpacked(row: bytes, dims: int) -> list[int]:
    return np.frombuffer(row, "<i4").tolist() if len(row) == 4 * dims else [int(v) for v in row[1:].split(b",")]


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x and c, both narrow."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * x @ c.T, 0)


def _exact(x: list[int], c: list[int]) -> int:
    return sum((a - b) ** 2 for a, b in zip(x, c, strict=True))


class Pivots:
    """Pivots by the number of the centroid that they were, and the pairs that bound each centroid."""

    def __init__(self, centroids: list[list[int]]) -> None:
        self.narrow = [max(map(abs, c), default=0) < NARROW for c in centroids]
        # A wide centroid is never bounded by pivots; the place of its pivot is taken by the origin.
        dims = len(centroids[0])
        rows = [c if ok else [0] * dims for c, ok in zip(centroids, self.narrow, strict=True)]
        self.rows = np.array([*rows, [NARROW - 1] * dims], np.float64)
        self.gaps = np.sqrt(_squares(self.rows, self.rows))
        k = len(rows)
        self.pairs = [[(j, q) for q in [k, *((j + t) % k for t in range(1, PARTNERS + 1))] if self.gaps[j, q] > 0] for j in range(k)]

    def table(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(_squares(x, self.rows))

    def bounds(self, table: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """Lower bounds of the distances of the vectors of a pivot table to the centroids, below by more than rounding."""
        own = self.table(centroids)
        out = np.zeros((len(table), len(centroids)))
        for j, pairs in enumerate(self.pairs):
            for p, q in pairs:
                a, b = table[:, p] * own[j, q], table[:, q] * own[j, p]
                np.maximum(out[:, j], (np.abs(a - b) - 2**-46 * (a + b)) / self.gaps[p, q], out=out[:, j])
        return out * (1 - 2**-46)


def nearest(vectors: Vectors, table: np.ndarray, pivots: Pivots, centroids: list[list[int]]) -> tuple[np.ndarray, list[int], int]:
    """(number, squared distance) of each vector's nearest centroid, ties to smaller numbers, and how many distances of
    vectors and centroids were computed besides those to pivots."""
    cluster, square, done = np.zeros(vectors.n, np.int64), np.full(vectors.n, -1, np.int64), 0
    near = [j for j, c in enumerate(centroids) if max(map(abs, c), default=0) < NARROW and pivots.narrow[j]]
    far = [j for j in range(len(centroids)) if j not in set(near)]
    x, best, at = vectors.rows, np.full(len(vectors.rows), np.inf), np.full(len(vectors.rows), len(centroids))
    if near and len(x):
        rows = np.array([centroids[j] if j in set(near) else [0] * x.shape[1] for j in range(len(centroids))], np.float64)
        lower = pivots.bounds(table, rows)
        lower[:, far] = np.inf
        at = lower.argmin(axis=1)
        best = ((x - rows[at]) ** 2).sum(axis=1)
        done += len(x)
        first = at.copy()
        for j in near:
            left = np.flatnonzero((lower[:, j] ** 2 * (1 - 2**-40) <= best) & (first != j))
            got = ((x[left] - rows[j]) ** 2).sum(axis=1)
            done += len(left)
            won = (got < best[left]) | ((got == best[left]) & (j < at[left]))
            best[left[won]], at[left[won]] = got[won], j
    cluster[vectors.at], square[vectors.at] = at, np.where(np.isfinite(best), best, -1)
    square = square.tolist()
    if far:  # a centroid with large components: left out where one component alone is too far off
        reach = [max(map(abs, centroids[j])) for j in far]
        most = np.abs(x).max(axis=1, initial=0).astype(np.int64).tolist()
        for i, place in enumerate(vectors.at.tolist()):
            own = None
            for j, r in zip(far, reach, strict=True):
                if square[place] >= 0 and r > most[i] and (r - most[i]) ** 2 > square[place]:
                    continue
                own = own or x[i].astype(np.int64).tolist()
                d = _exact(own, centroids[j])
                done += 1
                if square[place] < 0 or (d, j) < (square[place], int(cluster[place])):
                    square[place], cluster[place] = d, j
    for place, whole in vectors.wide.items():
        square[place], cluster[place] = min((_exact(whole, c), j) for j, c in enumerate(centroids))
        done += len(centroids)
    return cluster, square, done


def kept(vectors: DataFrame, dims: int = DIMS) -> DataFrame:
    """vec_id, row (bytes) of the vectors that take part, and `draw`, which orders the choice of the first centroids."""
    wide = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = wide.where((F.size("embedding") == dims) & ~F.exists("embedding", odd))
    drawn = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)

    def pack(batches):
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            with np.errstate(over="ignore"):
                whole = np.floor(SCALE * flat)
            narrow = (np.abs(whole) < NARROW).all(axis=1)
            rows = [whole[i].astype("<i4").tobytes() if narrow[i] else packed(quantised(flat[i].tolist())) for i in range(len(flat))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), batch.column(2), batch.column(1)], ["vec_id", "row", "draw", "embedding"])

    return sound.select("vec_id", "embedding", drawn.alias("draw")).mapInArrow(pack, "vec_id long, row binary, draw string, embedding array<double>")


def with_table(vectors: DataFrame, pivots: Pivots, dims: int) -> DataFrame:
    """vec_id, row and `pivot_table`, the distances to all pivots, computed now and written to the checkpoint folder."""

    def measure(batches):
        for batch in batches:
            own = Vectors(batch.column(1).to_pylist(), dims)
            table = np.zeros((own.n, len(pivots.rows)))
            table[own.at] = pivots.table(own.rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t.tobytes() for t in table], pa.binary())], ["vec_id", "row", "pivot_table"])

    return checkpointed(vectors.select("vec_id", "row").mapInArrow(measure, "vec_id long, row binary, pivot_table binary"))


def _read(batch: pa.RecordBatch, dims: int) -> tuple[Vectors, np.ndarray]:
    own = Vectors(batch.column(1).to_pylist(), dims)
    table = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<f8").reshape(own.n, -1)
    return own, table[own.at]


def moved(table: DataFrame, pivots: Pivots, centroids: list[list[int]], dims: int, evaluated=None) -> list[list[int]]:
    """The floors of the means of the vectors that are nearest to each centroid; one without vectors stays."""

    def add(batches):
        sums, counts = {}, {}
        for batch in batches:
            own, distances = _read(batch, dims)
            cluster, _, done = nearest(own, distances, pivots, centroids)
            if evaluated is not None:
                evaluated.add(done)
            of = cluster[own.at]
            for j in np.unique(cluster).tolist():
                part = own.rows[of == j].astype(np.int64).sum(axis=0).tolist() if len(own.rows) else [0] * dims
                for i, whole in own.wide.items():
                    if cluster[i] == j:
                        part = [a + b for a, b in zip(part, whole, strict=True)]
                sums[j] = [a + b for a, b in zip(sums[j], part, strict=True)] if j in sums else part
                counts[j] = counts.get(j, 0) + int((cluster == j).sum())
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([counts[j] for j in keys], pa.int64()), pa.array([",".join(map(str, sums[j])) for j in keys], pa.string())], ["cluster", "n", "sums"])

    def total(part: pa.Table) -> pa.Table:
        whole = [sum(v) for v in zip(*(map(int, s.split(",")) for s in part["sums"].to_pylist()), strict=True)]
        n = sum(part["n"].to_pylist())
        return pa.table([pa.array([part["cluster"][0].as_py()], pa.int32()), pa.array([",".join(str(v // n) for v in whole)])], ["cluster", "mean"])

    # One row for each task and centroid, then one for each centroid.
    means = table.mapInArrow(add, "cluster int, n long, sums string").groupBy("cluster").applyInArrow(total, "cluster int, mean string").collect()
    out = list(centroids)
    for r in means:
        out[r.cluster] = [int(v) for v in r.mean.split(",")]
    return out


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, evaluated=None) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance of each vector that takes part; the final centroids).

    vectors has vec_id and embedding. Vectors that are null, have another length than `dims` or hold a null or non-finite
    component take no part. Repeated rows are vectors of their own; a null vec_id is drawn as the empty text. The first
    centroids are the vectors of smallest hash, equal hashes by components; with fewer vectors than `clusters` each is one.
    An empty table gives no rows and no centroids. Further columns are ignored. A squared distance that doesn't fit a long
    is an error. evaluated: an accumulator of the distances to centroids that were computed.
    """
    spark = vectors.sparkSession
    bounded_batches(spark, 4000)
    base = kept(vectors, dims)
    drawn = base.orderBy("draw", "embedding").limit(clusters).collect()
    if not drawn:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    centroids = [unpacked(r.row, dims) for r in drawn]
    table = base
    for k in range(rounds + 1):
        if k in PIVOT_ROUNDS or k == 0:
            pivots = Pivots(centroids)
            table = with_table(table, pivots, dims)
        if k < rounds:
            centroids = moved(table, pivots, centroids, dims, evaluated)

    def assign(batches):
        for batch in batches:
            own, distances = _read(batch, dims)
            number, square, done = nearest(own, distances, pivots, centroids)
            if evaluated is not None:
                evaluated.add(done)
            if max(square, default=0) >= 1 << 63:
                raise ArithmeticError("a vector's squared distance doesn't fit a long")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), pa.array(square, pa.int64())], ["vec_id", "cluster", "distance"])

    return table.mapInArrow(assign, "vec_id long, cluster int, distance long"), centroids


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """assigned with cluster_inertia, inertia and centroid_sha256."""
    spark = assigned.sparkSession
    assigned = checkpointed(assigned)
    by_cluster = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row for each centroid
    whole = sum(int(r.s) for r in by_cluster)
    if whole >= 1 << 63:
        raise ArithmeticError("the inertia doesn't fit a long")
    rows = [(r.cluster, int(r.s), whole, hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()) for r in by_cluster]
    return assigned.join(F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_ptolemaic_clusters(spark, sf_dir: str) -> DataFrame:
    """The cluster of every vector, after five rounds from 40 of them."""
    return with_inertia(*cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def _sql() -> str:
    parts = []
    for k in range(ROUNDS + 1):
        parts.append(f"""a{k} AS MATERIALIZED (SELECT r, CAST(min(m) % 1000 AS INTEGER) AS k, min(m) // 1000 AS distance
  FROM (SELECT r, k, sum((x.v - c.v) * (x.v - c.v)) * 1000 + k AS m FROM x JOIN c{k} c USING (i) GROUP BY r, k) GROUP BY r)""")
        if k < ROUNDS:
            parts.append(f"""c{k + 1} AS MATERIALIZED (SELECT c.k, c.i, coalesce(f.v, c.v) AS v FROM c{k} c LEFT JOIN
  (SELECT k, i, (s - ((s % n) + n) % n) // n AS v FROM (SELECT k, i, sum(v) AS s, count(*) AS n FROM x JOIN a{k} USING (r) GROUP BY k, i)) f ON f.k = c.k AND f.i = c.i)""")
    return f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
  FROM embeddings WHERE len(embedding) = {DIMS} AND list_count(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, unnest(v) AS v, generate_subscripts(v, 1) AS i FROM e),
s AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), embedding) - 1 AS k FROM e QUALIFY k < {CLUSTERS}),
c0 AS MATERIALIZED (SELECT k, i, v FROM x JOIN s USING (r)),
{', '.join(parts)},
h AS (SELECT k, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY k)
SELECT vec_id, k AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{ROUNDS} JOIN e USING (r) JOIN h USING (k)
"""


OP13_SQL = _sql()
