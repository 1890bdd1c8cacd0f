"""Exact nearest vectors by integer inner product, with a pivot table that eliminates candidates.

Pivots are vectors of a bounded sample, each the farthest from the span of those before it. Every vector has its distances
to all pivots computed once. From them follows the greatest lower bound of the distance of two vectors that distances to
these pivots can give: they fix where a vector's projection on the span of the pivots lies, and how far the vector is off
that span, so d(q, x)^2 >= |projections' distance|^2 + (off q - off x)^2. (The usual bound, the largest
|d(q, p) - d(x, p)|, is the same for one pivot and weaker for more; on vectors of even spread it eliminates next to
nothing.) With it q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2 is bounded from above. How many pivots are used is measured on the
sample: the cost of a bound against that of the evaluations it saves.

Vectors are blocked by their nearest pivot, a large group in several blocks. A query starts from the k-th best score
among the sample; a group goes as a whole if its radius and longest vector allow no such score. In a block candidates are
evaluated in falling order of their bound, and the query stops when the bound falls below the k-th best score so far.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leaguelens.llm.common import bounded_batches

SCALE = 1024
#: Pivots at most, and the steps in which their number is tried.
PIVOTS, PIVOT_STEP = 96, 4
#: Vectors at most in the sample from which pivots and first bounds are taken; their vectors are broadcast.
SAMPLE_ROWS = 1500
#: Candidates of a block at most; a small table has smaller ones, about four for each partition, but not below the first.
LEAST_BLOCK, CANDIDATE_BLOCK, QUERY_BLOCK = 512, 8192, 512
_STEP = 256
#: Squared length from which a vector's scores needn't fit a long. Such vectors are compared in Python's integers, without
#: bounds, in blocks of their own (WIDE in place of a pivot).
TOO_LONG = float(1 << 62)
WIDE, WIDE_BLOCK = -1, 512
#: What stands for a score beyond either end of a long; an answer that holds one is an error.
_HIGH, _LOW = (1 << 63) - 1, -(1 << 63)


def matrix(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: (rows, floor(SCALE * x) of each of their components), without those of `wide_rows` and without vectors that
    take no part, which are null or hold a null or non-finite component."""
    lengths = np.where(np.asarray(column.is_null()), -1, column.value_lengths().fill_null(0).to_numpy())
    flat, starts = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])
    out = {}
    for d in np.unique(lengths[lengths >= 0]).tolist():
        rows = np.flatnonzero(lengths == d)
        with np.errstate(over="ignore", invalid="ignore"):
            wide = np.floor(SCALE * flat[starts[rows][:, None] + np.arange(d)])
            sound = np.isfinite(wide).all(axis=1) & ((wide * wide).sum(axis=1) < TOO_LONG)
        out[d] = rows[sound], wide[sound].astype(np.int64)
    return out


def wide_rows(column: pa.Array, held: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, list[int]]:
    """floor(SCALE * x) of each component of the finite vectors with a squared length of TOO_LONG or more, by row; held: the
    matrix of the column."""
    out = {}
    if sum(len(rows) for rows, _ in held.values()) < len(column):
        narrow = {i for rows, _ in held.values() for i in rows.tolist()}
        for i, v in enumerate(column.to_pylist()):
            if i not in narrow and v is not None and all(x is not None and np.isfinite(x) for x in v):
                out[i] = [int(np.floor(SCALE * x)) if abs(x) < 1e300 else int(x) * SCALE for x in v]
    return out


def text_of(whole: list[int]) -> bytes:
    return ",".join(map(str, whole)).encode()


def integers(row: bytes, wide: bool) -> list[int]:
    """A stored vector as Python's integers."""
    return [int(v) for v in row.split(b",")] if wide and row else np.frombuffer(row, "<i8").tolist()


def exact_best(vectors: list[list[int]], ids: list[int], query: list[int], k: int) -> tuple[list[int], list[int], list[bool]]:
    """(score, id, whether the vector may be the query itself) of the k best; scores beyond a long as its ends."""
    own = sum(a * a for a in query)
    scores = [sum(a * b for a, b in zip(query, v, strict=True)) for v in vectors]
    top = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
    return [min(max(scores[i], _LOW), _HIGH) for i in top], [ids[i] for i in top], [scores[i] == own for i in top]


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of x with q; by floating point where all sums are exact in it."""
    longest = lambda v: float((v.astype(np.float64) ** 2).sum(axis=-1).max(initial=0)) ** 0.5
    if longest(x) * longest(q) < 2**52:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return x @ q


class Pivots:
    """Pivots of one vector length, and what turns distances to them into projections on their span."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows = rows.astype(np.float64)
        self.square = (self.rows * self.rows).sum(axis=1)
        sides = self.rows[1:] - self.rows[:1]
        self.sides = (sides * sides).sum(axis=1)
        self.inverse = np.linalg.inv(np.linalg.qr(sides.T, "r")) if len(sides) else np.zeros((0, 0))

    def distances(self, x: np.ndarray) -> np.ndarray:
        """The pivot table: distances of the rows of x to every pivot."""
        wide = x.astype(np.float64)
        return np.sqrt(np.maximum((wide * wide).sum(axis=1)[:, None] + self.square - 2 * wide @ self.rows.T, 0))

    def places(self, square: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(head, place) by squared lengths and the pivot table: q.x <= head q + head x + place q . place x."""
        first = distance[:, 0] ** 2
        on = ((first[:, None] + self.sides - distance[:, 1:] ** 2) / 2) @ self.inverse
        off = np.sqrt(np.maximum(first - (on * on).sum(axis=1), 0))
        return (square - first) / 2, np.concatenate([on, off[:, None]], axis=1)


def spread(vectors: np.ndarray, n: int) -> list[int]:
    """At most n rows, each the farthest from the span of those before it; none that is almost on it."""
    left = vectors.astype(np.float64) - vectors[:1]
    size, out = (left * left).sum(axis=1), [0] if len(vectors) else []
    least = 1e-4 * size.max(initial=0)
    while out and len(out) < n and size.max() > least:
        k = int(size.argmax())
        out.append(k)
        side = left[k] / np.sqrt(size[k])
        left -= np.outer(left @ side, side)
        size = (left * left).sum(axis=1)
    return out


def chosen(sample: np.ndarray, k: int) -> Pivots | None:
    """The number of pivots of least cost, measured on vectors of the sample that are none: what a bound costs, and the
    evaluations that are left. None if there are too few vectors to tell, or if no number pays off."""
    order = spread(sample, PIVOTS + 1)
    rest = np.setdiff1d(np.arange(len(sample)), order)
    if len(rest) <= 10 * k:
        return None
    x = sample[rest].astype(np.float64)
    square, (q, d) = (x * x).sum(axis=1), (x[:100], sample.shape[1])
    least, best = np.sort(q @ x.T, axis=1)[:, -k - 1], (float(d), None)
    for n in range(PIVOT_STEP, len(order), PIVOT_STEP):
        pivots = Pivots(sample[order[: n + 1]])
        head, place = pivots.places(square, pivots.distances(x))
        left = (head[: len(q), None] + head + place[: len(q)] @ place.T >= least[:, None]).mean()
        if n + left * d < best[0]:
            best = (n + left * d, pivots)
    return best[1]


def best(vectors: np.ndarray, ids: np.ndarray, upper: np.ndarray, query: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(score, id) of at most k best candidates with a score of `least` or more, ties to smaller ids, and how many were
    evaluated. upper: a bound of each candidate's score."""
    order = np.flatnonzero(upper >= least)
    order = order[np.argsort(-upper[order], kind="stable")]
    scores, found, done = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for at in range(0, len(order), _STEP):
        rows = order[at : at + _STEP]
        if len(scores) == k and upper[rows[0]] < scores[-1]:
            break
        done += len(rows)
        got, own = products(vectors[rows], query), ids[rows]
        keep = got >= least
        scores, found = np.concatenate([scores, got[keep]]), np.concatenate([found, own[keep]])
        top = np.lexsort((found, -scores))[:k]
        scores, found = scores[top], found[top]
    return scores, found, done


_SCHEMA = "query_id long, rank int, vec_id long, score long"


def search(vectors: DataFrame, k: int = 10, every: int = 100, evaluated=None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every` its k best other rows, or all if
    fewer. evaluated: an accumulator that gets the number of inner products computed from candidates.

    The score is the inner product of floor(SCALE * x); ties go to the smaller vec_id, ranks start at 1. A vector that is
    null or holds a null or non-finite component, or has no vec_id, takes no part. A score of an answer that doesn't fit a
    long is an error. Rows may share a vec_id: each is a candidate, and each whose vec_id is divisible has
    its own answer, from which that one row is left out. Vectors are compared with those of their own length only. A
    query without candidates has no rows, nor has an empty table. Further columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark, 4000)
    sound = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    drawn = sound.orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(SAMPLE_ROWS).collect()
    drawn_ids, held = np.array([r.vec_id for r in drawn], np.int64), matrix(pa.array([r.embedding for r in drawn], pa.list_(pa.float64()))) if drawn else {}
    sample = {d: (drawn_ids[rows], whole, chosen(np.unique(whole, axis=0), k) if d else None) for d, (rows, whole) in held.items() if len(rows)}
    shared = spark.sparkContext.broadcast(sample)  # SAMPLE_ROWS vectors at most
    nothing = lambda d: (np.zeros(0, np.int64), np.zeros((0, d), np.int64), None)

    def place(batches):
        """Vectors as bytes, with their nearest pivot and the distance to it."""
        for batch in batches:
            ids, held = batch.column(0).to_numpy(), matrix(batch.column(1))
            for d, (rows, whole) in held.items():
                pivots = shared.value.get(d, nothing(d))[2]
                table = pivots.distances(whole) if pivots else np.zeros((len(rows), 1))
                square = (whole.astype(np.float64) ** 2).sum(axis=1)
                near = table.argmin(axis=1) if len(rows) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(np.full(len(rows), d, np.int32)), pa.array(near), pa.array(table[np.arange(len(rows)), near]), pa.array(square), pa.array([v.tobytes() for v in whole], pa.binary())], ["vec_id", "size", "near", "gap", "square", "row"])
            if wide := wide_rows(batch.column(1), held):
                n = len(wide)
                yield pa.RecordBatch.from_arrays([pa.array(ids[list(wide)]), pa.array([len(v) for v in wide.values()], pa.int32()), pa.array([WIDE] * n, pa.int64()), pa.array([0.0] * n), pa.array([0.0] * n), pa.array([text_of(v) for v in wide.values()], pa.binary())], ["vec_id", "size", "near", "gap", "square", "row"])

    placed = sound.mapInArrow(place, "vec_id long, size int, near long, gap double, square double, row binary")
    # One row for each vector length and pivot: how many blocks its vectors fill, how far they are off, how long they are.
    found = placed.groupBy("size", "near").agg(F.count("*").alias("n"), F.max("gap").alias("radius"), F.max("square").alias("longest")).collect()
    rows = min(CANDIDATE_BLOCK, max(LEAST_BLOCK, sum(r.n for r in found) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    groups = {(r.size, r.near): (-(-r.n // (rows if r.near != WIDE else WIDE_BLOCK)), r.radius, r.longest) for r in found}
    if not groups:
        return spark.createDataFrame([], _SCHEMA)
    shared_groups = spark.sparkContext.broadcast(groups)
    blocks = spark.createDataFrame([(*key, value[0]) for key, value in groups.items()], "size int, near long, blocks long")
    salted = placed.join(F.broadcast(blocks), ["size", "near"]).withColumn("block", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("blocks")))

    def pack(table: pa.Table) -> pa.Table:
        key = [table[c].slice(0, 1) for c in ("size", "near", "block")]
        joint = b";" if table["near"][0].as_py() == WIDE else b""
        return pa.table([*key, pa.array([table["vec_id"].to_numpy().tobytes()], pa.binary()), pa.array([joint.join(table["row"].to_pylist())], pa.binary())], ["size", "near", "block", "ids", "rows"])

    packed = salted.select("size", "near", "block", "vec_id", "row").groupBy("size", "near", "block").applyInArrow(pack, "size int, near long, block long, ids binary, rows binary")

    def ask(batches):
        """Blocks of queries, each for every block of candidates that may hold an answer."""
        for batch in batches:
            ids, sizes, raw, copies, nearest = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
            for d in np.unique(sizes).tolist():
                wide_q = np.flatnonzero((sizes == d) & (nearest == WIDE))
                for at in (wide_q[a : a + QUERY_BLOCK] for a in range(0, len(wide_q), QUERY_BLOCK)):
                    body = [ids[at].tobytes(), copies[at].tobytes(), b";".join(raw[at]), b"", b""]
                    for (size, near), (count, _, _) in shared_groups.value.items():
                        if size == d:
                            yield pa.RecordBatch.from_arrays([pa.array([size] * count, pa.int32()), pa.array([near] * count, pa.int64()), pa.array(range(count), pa.int64()), *(pa.array([x] * count, pa.binary()) for x in body)], ["size", "near", "block", "q_ids", "copies", "q_rows", "q_table", "least"])
                every_q = np.flatnonzero((sizes == d) & (nearest != WIDE))
                s_ids, s_rows, pivots = shared.value.get(d, nothing(d))
                for at in (every_q[a : a + QUERY_BLOCK] for a in range(0, len(every_q), QUERY_BLOCK)):
                    q = np.frombuffer(b"".join(raw[at]), "<i8").reshape(len(at), d)
                    known = [np.sort(products(s_rows, q[j])[s_ids != ids[a]]) for j, a in enumerate(at)]
                    least = np.array([x[-k] if len(x) >= k else _LOW for x in known], np.int64)
                    table, square = pivots.distances(q) if pivots else np.zeros((len(q), 0)), (q.astype(np.float64) ** 2).sum(axis=1)
                    for (size, near), (count, radius, longest) in shared_groups.value.items():
                        if size != d:
                            continue
                        gap = np.maximum(table[:, near] - radius, 0) if pivots and near != WIDE else np.zeros(len(q))
                        reach = np.minimum((square + longest - gap * gap) / 2, np.sqrt(square * longest)) if near != WIDE else np.full(len(q), np.inf)
                        sel = np.flatnonzero(reach + 1e-5 * (square + longest) + 1 >= least)
                        if len(sel):
                            body = [x[sel].tobytes() for x in (ids[at], copies[at], q, table, least)]
                            for b in range(0, count, 32):
                                n = min(32, count - b)
                                yield pa.RecordBatch.from_arrays([pa.array([size] * n, pa.int32()), pa.array([near] * n, pa.int64()), pa.array(range(b, b + n), pa.int64()), *(pa.array([x] * n, pa.binary()) for x in body)], ["size", "near", "block", "q_ids", "copies", "q_rows", "q_table", "least"])

    queries = placed.where(F.col("vec_id") % every == 0).groupBy("vec_id", "size", "row", "near").agg(F.count("*").alias("copies")).select("vec_id", "size", "row", "copies", "near")
    asked = queries.mapInArrow(ask, "size int, near long, block long, q_ids binary, copies binary, q_rows binary, q_table binary, least binary")
    pairs = packed.hint("shuffle_merge").join(asked, ["size", "near", "block"])

    def answer(batches):
        key = None
        for batch in batches:
            out = [[] for _ in range(6)]
            for *now, c_ids, c_rows, q_ids, q_copies, q_rows, q_table, q_least in zip(*(batch.column(i).to_pylist() for i in range(10)), strict=True):
                d = now[0]
                if now[1] == WIDE or not q_least:
                    whole = lambda body, n, wide: [integers(r, wide) for r in (body.split(b";") if wide else [body[8 * d * i : 8 * d * (i + 1)] for i in range(n)])]  # noqa: B023, E731
                    ids, asked_ids, copies = (np.frombuffer(b, "<i8").tolist() for b in (c_ids, q_ids, q_copies))
                    vectors = whole(c_rows, len(ids), now[1] == WIDE)
                    for i, count, q in zip(asked_ids, copies, whole(q_rows, len(asked_ids), not q_least), strict=True):
                        scores, found, same = exact_best(vectors, ids, q, k + 1)
                        version = xxhash.xxh3_128_digest(text_of(q) if not q_least else np.array(q, np.int64).tobytes())
                        for part, values in zip(out, ([i] * len(found), [version] * len(found), [count] * len(found), found, scores, [s and f == i for s, f in zip(same, found, strict=True)]), strict=True):
                            part.extend(values)
                        if evaluated is not None:
                            evaluated.add(len(ids))
                    continue
                pivots = shared.value.get(d, nothing(d))[2]
                if key != now:  # rows come sorted by block: its distances are computed once
                    key, ids = now, np.frombuffer(c_ids, "<i8")
                    x = np.frombuffer(c_rows, "<i8").reshape(len(ids), d)
                    x_square = (x.astype(np.float64) ** 2).sum(axis=1)
                    places = pivots.places(x_square, pivots.distances(x)) if pivots else None
                asked_ids, copies, least = (np.frombuffer(b, "<i8") for b in (q_ids, q_copies, q_least))
                q = np.frombuffer(q_rows, "<i8").reshape(len(asked_ids), d)
                square = (q.astype(np.float64) ** 2).sum(axis=1)
                if pivots:
                    head, spot = pivots.places(square, np.frombuffer(q_table, "<f8").reshape(len(q), -1))
                    upper = head[:, None] + places[0] + spot @ places[1].T
                else:
                    upper = np.sqrt(square[:, None] * x_square)
                upper += 1e-5 * (square[:, None] + x_square) + 1  # above what rounding can hide
                for j, i in enumerate(asked_ids.tolist()):
                    scores, found, done = best(x, ids, upper[j], q[j], k + 1, int(least[j]))
                    n, version = len(scores), xxhash.xxh3_128_digest(q[j].tobytes())
                    for part, values in zip(out, (np.full(n, i), [version] * n, np.full(n, copies[j]), found, scores, (found == i) & (scores == q[j] @ q[j])), strict=True):
                        part.extend(values if isinstance(values, list) else values.tolist())
                    if evaluated is not None:
                        evaluated.add(done)
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["query_id", "version", "copies", "vec_id", "score", "own"])

    wide = pairs.select("size", "near", "block", "ids", "rows", "q_ids", "copies", "q_rows", "q_table", "least")
    partial = wide.mapInArrow(answer, "query_id long, version binary, copies long, vec_id long, score long, own boolean")
    # k + 1 rows of each query hold the query's own row, or it is no answer anyway; one such row goes.
    each = Window.partitionBy("query_id", "version")
    ranked = partial.withColumn("place", F.row_number().over(each.orderBy(F.col("score").desc(), "vec_id"))).where(F.col("place") <= k + 1)
    ranked = ranked.withColumn("mine", F.coalesce(F.min(F.when(F.col("own"), F.col("place"))).over(each), F.lit(k + 2)))
    ranked = ranked.withColumn("rank", F.col("place") - (F.col("place") > F.col("mine")).cast("int")).where((F.col("place") != F.col("mine")) & (F.col("rank") <= k))
    off = F.raise_error(F.concat(F.lit("a score of query "), F.col("query_id").cast("string"), F.lit(" doesn't fit a long"))).cast("long")
    score = F.when((F.col("score") > _LOW) & (F.col("score") < _HIGH), F.col("score")).otherwise(off)
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("query_id", "rank", "vec_id", score.alias("score"))


def op4_pivot_topk(spark, sf_dir: str) -> DataFrame:
    """The ten best other vectors of every hundredth one."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP4_SQL = """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, CAST(list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS HUGEINT[]) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
s AS (SELECT q.n, q.vec_id AS query_id, v.vec_id AS vec_id, coalesce(list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])), 0) AS score
      FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.n <> q.n AND len(v.e) = len(q.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 10
"""
