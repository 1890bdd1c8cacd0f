import random

import numpy as np
import xxhash

from leaguelens.llm import simhash as S
from leaguelens.llm.common import join_counted
from leaguelens.llm.components import roots


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join("\0" if c in " \t\n\x0b\x0c\r" else c for c in low).split("\0") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def slow_components(rows):
    fps = [(d, slow_fingerprint(t)) for d, t in rows]
    top = list(range(len(fps)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 4:
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, f"{f:016x}", least[find(i)]) for i, (d, f) in enumerate(fps))


def test_golay_decodes_every_error():
    code, rng = S.Golay(), np.random.default_rng(3)
    words = rng.integers(0, 1 << 23, 5000)
    index = code.index(words)
    assert index.min() >= 0 and index.max() < 4096
    flips = 1 << rng.integers(0, 23, 5000)
    row, near = code.near(words, 23)
    have = set(zip(row.tolist(), near.tolist(), strict=True))
    assert all((i, int(k)) in have for i, k in enumerate(code.index(words ^ flips)))


def test_pairs_within_radius_share_a_key():
    code, rng = S.Golay(), np.random.default_rng(5)
    one = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    other = one.copy()
    for i in range(len(other)):
        for b in rng.choice(64, i % 5, replace=False):
            other[i] ^= np.uint64(1 << int(b))
    keys = []
    for fps in (one, other):
        r, k = S.keys_of(fps, code)
        keys.append(set(zip(r.tolist(), k.tolist(), strict=True)))
    assert {r for r, _ in keys[0] & keys[1]} == set(range(2000))


def test_components_match_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        if rows and rng.random() < 0.6:
            words = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice((1, 3, 4, 40, 300)))]
        rows.append((i * 7 % 1000, " ".join(words)))
    rows += [(2001, ""), (2002, " \n"), (2003, "ÀB c"), (2004, "Àb C"), (2004, "Àb C")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string")
    got = sorted(map(tuple, S.components(docs).collect()))
    assert got == slow_components(rows)
    kept = S.keep_one(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, _, c in got})


def test_large_group_links_are_few_and_enough():
    rng = np.random.default_rng(1)
    fps, base = [], np.uint64(0x0123456789ABCDEF)
    for _ in range(400):
        base ^= np.uint64(1 << int(rng.integers(0, 64)))
        fps.append(base)
    fps = np.unique(np.array(fps, np.uint64))
    found = S.links(np.zeros(len(fps), np.int64), fps)
    assert len(found) == len(fps) - 1


def test_empty_and_nulls(spark):
    schema = "doc_id long, text string"
    assert S.components(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(5, None), (3, ""), (None, "a b"), (None, None)], schema)
    got = {(r.doc_id, r.component_id) for r in S.components(docs).collect()}
    assert got == {(5, 3), (3, 3), (None, 3)} or got == {(5, 3), (3, 3), (None, 3), (None, None)}
    assert len(S.keep_one(spark, docs, "").collect()) == 3


def test_giant_component_and_hot_fingerprint(spark):
    """A star, a path and copies in their thousands, against union-find."""
    rng = np.random.default_rng(6)
    edges = [(0, i) for i in range(1, 4000)] + [(10_000 + i, 10_001 + i) for i in range(300)] + [(50_000, int(i)) for i in rng.integers(50_001, 53_000, 4000)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    got = {r.node: r.root for r in roots(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: top(n) for n in parent}
    left = spark.createDataFrame([(i % 5 if i % 3 else 9, i) for i in range(6000)], "k int, v int")
    right = left.groupBy("k").count().withColumn("w", left["k"] * 2)
    joined = join_counted(left, right, "k", "count", 6000)
    assert joined.columns == ["k", "v", "w"] and sorted((r.v, r.k * 2 == r.w) for r in joined.collect()) == [(i, True) for i in range(6000)]


def test_rows_that_share_a_doc_id(spark):
    one, two, far = "a b c d e f g h i j k l", "q r s t u v w x y z 1 2", "5 6 7 8 9 10 11 12 13 14"
    rows = [(1, one, 0), (1, two, 0), (1, two, 0), (4, one, 1), (5, two, 1), (6, far, 1), (6, far, 2), (8, far, 3)]
    docs = spark.createDataFrame([(*r, "k", "i", "d", {"x": 1}) for r in rows], "doc_id long, text string, row int, _kept string, id string, doc string, root map<string,int>")
    kept = S.keep_one(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, one), (1, two), (6, far)])


def test_very_long_texts(spark):
    """A megabyte of words, the same with one word changed, one long word, and white space alone, in one table."""
    rng = random.Random(11)
    words = [f"w{rng.randrange(5000)}" for _ in range(180_000)]
    long = " ".join(words)
    other = " ".join([*words[:90_000], "changed", *words[90_001:]])
    rows = [(5, long), (3, other), (9, "z" * 1_500_000), (8, " \t" * 600_000), (7, None), (2, "short text")]
    got = S.components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()) == slow_components(rows)


def test_the_largest_doc_id_is_an_id(spark):
    """2^63 - 1 names its component, alone, with copies and beside rows without doc_id; those without any have no name."""
    top = (1 << 63) - 1
    one, two, three, four = "a b c d e f g h i j k l", "q r s t u v w x y z 1 2", "5 6 7 8 9 10 11 12 13 14", "k1 k2 k3 k4 k5 k6 k7"
    rows = [(top, one), (None, one), (top, one), (None, two), (3, three), (top, three), (top, four)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.component_id or 0) for r in S.components(docs).collect())
    assert got == sorted([(str(top), top), (str(top), top), ("None", top), ("None", 0), ("3", 3), (str(top), 3), (str(top), top)])
    kept = sorted((str(r.doc_id), r.text) for r in S.keep_one(spark, docs, "").collect())
    assert kept == sorted([(str(top), one), (str(top), four), ("3", three), ("None", one), ("None", two)])
