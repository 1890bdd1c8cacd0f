import hashlib
import random
import zlib

import pytest

from leaguelens.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """(root, siblings of each leaf by level as (left, right) lists)."""
    paths, at = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, members = [], []
        for k in range(0, len(nodes), 3):
            run = nodes[k : k + 3]
            for j in range(len(run)):
                for leaf in at[k + j]:
                    paths[leaf].append((run[:j], run[j + 1 :]))
            up.append(H(*run))
            members.append([x for m in at[k : k + 3] for x in m])
        nodes, at = up, members
    return nodes[0], paths


def plain(rows):
    out, groups = [], {}
    for r in rows:
        cut = r[4] if r[4] is None or r[0] is None or zlib.crc32(str(r[0]).encode()) % 2 else r[4].replace("\n", "")
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, H(*map(enc, r)), H(*map(enc, (*r[:4], cut))), r[0]))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    below = {}
    for s in order:
        groups[s].sort(key=lambda x: x[:4])
        below[s] = tree([x[2] for x in groups[s]])
    root, above = tree([below[s][0] for s in order])
    for s, top in zip(order, above, strict=True):
        for (_, _, leaf, h, doc), own in zip(groups[s], below[s][1], strict=True):
            siblings = ""
            for left, right in own + top:
                h = H(*left, h, *right)
                siblings += "".join(left + right)
            out.append((doc, leaf, below[s][0], root, H(siblings), h, h == root))
    return sorted(out, key=str)


def found(spark, rows, schema=SCHEMA, parts=3):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema).repartition(parts)
    cut = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return sorted((tuple(r) for r in M.verified(M.manifest(df, cut)).collect()), key=str)


def made(seed, n, sources):
    rng = random.Random(seed)
    return [(i * 3, rng.choice(sources), rng.choice(["en", None]), rng.choice([None, 5]), rng.choice([None, "", "a\nb", "é" * 7, "plain"]) ) for i in range(n)]


@pytest.mark.parametrize(("n", "sources"), [(1, ["a"]), (1, [None]), (3, ["a"]), (4, ["a"]), (40, ["b", None, "", "é", "Z"]), (90, [f"s{i}" for i in range(30)])])
def test_equals_a_plain_tree(spark, n, sources):
    rows = made(n, n, sources)
    assert found(spark, rows) == plain(rows)


def test_blocks_of_a_hot_source(spark, monkeypatch):
    # Blocks of nine, so that a small table takes several steps; sizes around whole blocks.
    monkeypatch.setattr(M, "LEVELS", 2)
    monkeypatch.setattr(M, "BLOCK", 9)
    for n in (9, 10, 82):
        rows = made(n, n, ["hot"]) + made(1, 5, ["a", None])
        assert found(spark, rows) == plain(rows), n


def test_a_block_and_more(spark):
    rows = made(7, 1500, ["hot"]) + made(8, 30, ["a", "z"])
    assert found(spark, rows) == plain(rows)


def test_any_order_of_rows(spark):
    rows = made(2, 50, ["a", "b"])
    assert found(spark, rows) == found(spark, rows[::-1], parts=1)


def test_edge_rows(spark):
    rows = [(None, None, None, None, None), (1, "a", "en", 3, "x\ny"), (1, "a", "en", 3, "x\ny"), (1, "a", "fr", 3, "x\ny"), (2, "", "en", 0, ""), (4, "b", "en", 10**6, "long\n" * 200000)]
    assert found(spark, rows) == plain(rows)
    wide = [(*r, 9, "p", "g") for r in rows]
    assert found(spark, wide, SCHEMA + ", leaf int, path string, grp string") == plain(rows)
    assert found(spark, []) == []
