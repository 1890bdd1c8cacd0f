import hashlib
import random

import numpy as np
import pytest
from pyspark.errors import PythonException

from leaguelens.llm import ptolemy as P

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, clusters=P.CLUSTERS, rounds=P.ROUNDS, dims=P.DIMS):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), every distance computed."""
    kept = [(v, e, P.quantised(e)) for v, e in rows if e is not None and len(e) == dims and all(x is not None and np.isfinite(x) for x in e)]
    draw = lambda v: hashlib.sha256(f"2:{'' if v is None else v}".encode()).hexdigest()
    centroids = [w for _, _, w in sorted(kept, key=lambda r: (draw(r[0]), r[1]))[:clusters]]
    assign = lambda: [min((sum((a - b) ** 2 for a, b in zip(w, c, strict=True)), j) for j, c in enumerate(centroids)) for *_, w in kept]
    for _ in range(rounds):
        of = assign()
        for j in range(len(centroids)):
            own = [w for (*_, w), (_, k) in zip(kept, of, strict=True) if k == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    of = assign()
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    each = [sum(d for d, k in of if k == j) for j in range(len(centroids))]
    return sorted(((v, j, d, each[j], sum(each), sha[j]) for (v, *_), (d, j) in zip(kept, of, strict=True)), key=str)


def found(spark, rows, schema=SCHEMA, parts=3, **more):
    return sorted((tuple(r) for r in P.with_inertia(*P.cluster(spark.createDataFrame(rows, schema).repartition(parts), **more)).collect()), key=str)


def made(seed, n, dims, groups=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    if groups:
        x = 6 * rng.normal(size=(groups, dims))[rng.integers(0, groups, n)] + x
    return [(i, v) for i, v in enumerate(x.tolist())]


def test_equals_plain_clustering(spark):
    rows = made(1, 300, 8)
    assert found(spark, rows, clusters=12, dims=8) == plain(rows, 12, dims=8)
    rows = made(2, 120, P.DIMS)
    assert found(spark, rows) == plain(rows)


def test_bounds_leave_out_centroids_of_grouped_vectors(spark):
    rows = made(3, 2000, 16, groups=20)
    seen = spark.sparkContext.accumulator(0)
    got, _ = P.cluster(spark.createDataFrame(rows, SCHEMA), clusters=20, dims=16, evaluated=seen)
    assert got.count() == 2000
    assert seen.value < 0.35 * 6 * 2000 * 20  # distances to centroids besides those to pivots


def test_bounds_are_below():
    rng = np.random.default_rng(5)
    for scale in (1, 300, 200000):
        x, c = rng.integers(-scale, scale + 1, (400, 16)), rng.integers(-scale, scale + 1, (9, 16))
        pivots = P.Pivots((c + rng.integers(-2, 3, c.shape)).tolist())
        lower = pivots.bounds(pivots.table(x.astype(float)), c.astype(float))
        real = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (lower**2 <= real).all()
        exact = P.Pivots(c.tolist())
        assert (exact.bounds(exact.table(x.astype(float)), c.astype(float)) > 0.99 * np.sqrt(real) - 1e-3).all()


def test_ties_repeats_and_empty_clusters(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([0.0, 0.01, 1.0]) for _ in range(4)]) for i in range(60)] + [(5, [1.0, 1.0, 1.0, 1.0])] * 30
    for k in (2, 7, 40, 200):
        assert found(spark, rows, clusters=k, dims=4) == plain(rows, k, dims=4), k


def test_large_components(spark):
    rows = [*made(7, 40, 4), (100, [5e5, 1.0, -3.0, 2.0]), (101, [5e5, 1.5, -3.0, 2.0]), (102, [-9e6, 0.0, 0.0, 1.0]), (103, [4100.0, 0.0, 0.0, 4099.0]), (104, [4090.0, 0.0, 0.0, 4096.0])]
    for k in (3, 9, 45):
        assert found(spark, rows, clusters=k, dims=4) == plain(rows, k, dims=4), k
    rows = [(1, [1e300, 0.0]), (2, [1e300, 1.0]), (3, [0.0, 1.0]), (4, [-1.7e308, 2.0])]
    assert found(spark, rows, clusters=4, dims=2) == plain(rows, 4, dims=2)
    with pytest.raises((ArithmeticError, PythonException)):
        found(spark, rows, clusters=1, dims=2)


def test_edge_rows(spark):
    bad = [(None, None), (1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("inf"), 1.0])]
    good = [(None, [1.0, 2.0]), (7, [0.5, 0.25]), (7, [0.5, 0.25]), (8, [-0.001, 3.0])]
    assert found(spark, bad + good, dims=2) == plain(bad + good, dims=2)
    wide = [(*r, "x", 3.5) for r in bad + good]
    assert found(spark, wide, SCHEMA + ", cluster string, distance double", dims=2) == plain(bad + good, dims=2)
    assert found(spark, bad, dims=2) == [] and found(spark, [], dims=2) == []
    floats = spark.createDataFrame(good, "vec_id int, embedding array<float>")
    assert sorted((tuple(r) for r in P.with_inertia(*P.cluster(floats, dims=2)).collect()), key=str) == plain([(v, np.float32(e).astype(float).tolist()) for v, e in good], dims=2)
