import math

import duckdb
import numpy as np
import pytest

from leaguelens.llm import topk as K


def whole(v):
    """Plain reading of which vectors take part, with Python's exact integers: all whose components are there and finite."""
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(1024 * x) if abs(x) < 1e300 else int(x) * 1024 for x in v]


def slow(rows, k=10):
    out = []
    sound = [(i, whole(v)) for i, v in rows if whole(v) is not None]
    for n, (q, own) in enumerate(sound):
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for m, (i, v) in enumerate(sound) if m != n and len(v) == len(own))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_table_equals_brute_force(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = sorted(map(tuple, K.op4_pivot_topk(spark, "/root/testdata/sf0.01").collect()))
    assert got == slow(rows)


def test_sql(spark):
    got = sorted(map(tuple, K.op4_pivot_topk(spark, "/root/testdata/sf0.001").collect()))
    sql = K.OP4_SQL.replace("FROM embeddings", "FROM read_parquet('/root/testdata/sf0.001/embeddings.parquet')")
    assert got == sorted(map(tuple, duckdb.sql(sql).fetchall()))


def test_small_blocks_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(K, "CANDIDATE_BLOCK", 40)
    monkeypatch.setattr(K, "QUERY_BLOCK", 2)
    monkeypatch.setattr(K, "SAMPLE_ROWS", 30)
    monkeypatch.setattr(K, "_STEP", 8)
    monkeypatch.setattr(K, "PIVOT_STEP", 1)
    rng = np.random.default_rng(2)
    rows = [(int(i) * 10, [float(x) for x in rng.normal(0, 0.01, 4).round(3)]) for i in range(150)]
    rows += [(5, [0.0] * 4), (7, [0.0] * 4), (100000, [1e5, -1e5, 0.0, 0.0]), (100001, [1e5, -1e5, 0.0, 0.0])]
    odd = [(200000, None), (300000, [1.0, None, 0.0, 0.0]), (400000, [float("nan")] * 4), (500000, [float("inf")] * 4), (600000, [1.0, 2.0]), (3, [1.0, 1.0]), (None, [1.0] * 4), (700000, [])]
    frame = spark.createDataFrame([(i, v, 1, 0) for i, v in rows + odd + rows[:3]], "vec_id long, embedding array<double>, rank int, score int")
    got = sorted(map(tuple, K.search(frame).collect()))
    assert got == slow([r for r in rows + odd + rows[:3] if r[0] is not None])
    assert K.search(frame.limit(0)).count() == 0


def test_repeated_ids_and_huge_components(spark):
    rows = [(100, [0.5, 0.25]), (100, [0.5, 0.25]), (100, [-0.5, 0.125]), (7, [0.5, 0.25]), (8, [3e6, 1.0]), (9, [-3e6, 1.0]), (200, [2.0**20, 2.0**20]), (11, [2.0**19, -(2.0**19)]), (300, [2.0**21, 1.0])]
    rows += [(100 + i, [0.01 * i, -0.02 * i]) for i in range(1, 40)] + [(400, [])] * 2
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, K.search(frame).collect()))
    assert got == slow(rows)
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding double[])")
    con.executemany("insert into embeddings values (?, ?)", rows)
    assert sorted(con.sql(K.OP4_SQL).fetchall()) == got


def test_pivots_eliminate(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(0, 1, (3000, 24)))]
    n = spark.sparkContext.accumulator(0)
    got = sorted(map(tuple, K.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), evaluated=n).collect()))
    assert got == slow(rows) and n.value < 0.6 * 30 * 3000
    # the bound holds for any two vectors, and is no weaker than the largest difference of distances
    x = np.floor(1024 * rng.normal(0, 1, (60, 24)))
    p = K.Pivots(x[K.spread(x, 9)])
    d, square = p.distances(x), (x * x).sum(axis=1)
    head, place = p.places(square, d)
    upper, true = head[:, None] + head + place @ place.T, x @ x.T
    plain = (square[:, None] + square - np.abs(d[:, None] - d[None]).max(axis=2) ** 2) / 2
    assert (upper >= true - 1).all() and (upper <= plain + 1).all()


def test_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(K, "LEAST_BLOCK", 50)
    rows = [(100 * (i % 3), [1.0, 2.0, 3.0]) for i in range(300)] + [(i, [0.1 * (i % 7), 1.0, -0.5]) for i in range(301, 420)]
    assert sorted(map(tuple, K.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())) == slow(rows)


def test_vectors_of_any_size_take_part(spark, monkeypatch):
    monkeypatch.setattr(K, "WIDE_BLOCK", 2)
    rows = [(100, [0.5, 0.25]), (200, [0.0, -1.0]), (300, [0.0, 3e6]), (7, [3e6, 1.0]), (8, [3e6, 2.0]), (9, [-3e6, 5.0]), (400, [0.0, 0.0]), (400, [0.0, 0.0]), (10, [2e6, -2e6]), (300, [0.0, 3e6])]
    rows += [(11 + i, [0.1 * i, -0.1]) for i in range(14)]
    frame = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<double>")
    few = [r for r in rows if r[0] != 300]
    assert sorted(map(tuple, K.search(frame(few)).collect())) == slow(few)
    with pytest.raises(Exception, match="doesn't fit a long"):
        K.search(frame(rows)).collect()  # the two of 300 have a product of 9.4e18
    wide = [(100, [1e300, 0.0]), (200, [0.0, 1.0]), (3, [0.0, 5.0]), (4, [0.0, -1.7e308])]
    wide = wide[:3] + [(5, [0.0, 0.5])]
    assert sorted(map(tuple, K.search(frame(wide)).collect())) == slow(wide)
