import hashlib
from collections import Counter

import numpy as np

from leaguelens.llm import cws as C


def jaccard(a, b):
    x, y = Counter(a.lower().split()), Counter(b.lower().split())
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def slow(rows):
    rows = sorted(rows, key=lambda r: (-r[0], r[1] or ""))
    out = {}
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        out[doc] = (len(text), hashlib.sha256(new.encode()).hexdigest(), jaccard(text, new), jaccard(text, after))
    return out


def test_whole_table(spark, monkeypatch):
    monkeypatch.setattr(C, "BUCKET_ROWS", 70)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got, want = C.op5_weighted_sampling(spark, "/root/testdata/sf0.01").collect(), slow(rows)
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == {d: w[:2] for d, w in want.items()} and len(got) == len(want)
    for near, k in (("near_edited", 2), ("near_next", 3)):
        off = np.array([getattr(r, near) - want[r.doc_id][k] for r in got])
        assert abs(off.mean()) < 0.01 and np.sqrt((off**2).mean()) < 0.06
    by_text = {}
    texts = dict(rows)
    for r in got:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert len(set(by_text.values())) > 0.98 * len(by_text)


def test_samples_follow_weights():
    a, b = "x " * 30 + "y " * 10 + "z", "x " * 15 + "y " * 20 + "w " * 3
    hits = []
    for i in range(60):  # other words, other draws
        s = C.signatures([t.replace("x", f"x{i}").replace("y", f"y{i}").replace("z", f"z{i}").replace("w", f"w{i}") for t in (a, b)])
        hits.append((s[0] == s[1]).mean())
    assert abs(np.mean(hits) - jaccard(a, b)) < 0.02


def test_edge_rows(spark):
    schema = "doc_id long, text string, fingerprint int"
    docs = spark.createDataFrame([(3, "a b c d", 0), (2, None, 0), (1, "", 0), (1, "", 0), (9, "Ä ä" * 50000, 0), (None, "q r", 0)], schema)
    got = C.compare(docs).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == [("1", 0), ("1", 0), ("2", 0), ("3", 7), ("9", 150000), ("None", 3)]
    by = {r.doc_id: r for r in got}
    assert by[2].fingerprint == "0" * 384 and by[2].near_edited == by[2].near_next == 1.0
    assert by[None].edited_sha256 == hashlib.sha256("q Ä".encode()).hexdigest()
    one = C.compare(docs.where("doc_id = 3")).collect()
    assert [(r.doc_id, r.near_next, r.edited_sha256) for r in one] == [(3, 1.0, hashlib.sha256(b"a b a b").hexdigest())]
    assert C.compare(docs.limit(0)).count() == 0


def test_many_rows_of_one_doc_id_and_of_none(spark, monkeypatch):
    monkeypatch.setattr(C, "BUCKET_ROWS", 20)
    rows = [(None, f"none {i}") for i in range(300)] + [(5, "same text")] * 300 + [(7, f"seven {i}") for i in range(200)] + [(i, f"doc {i}") for i in range(100, 130)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, bucket int")
    placed = C.neighbours(docs)
    sizes = [r["count"] for r in placed.where("not last").groupBy("bucket").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 150  # neither id fills a bucket of its own
    got = C.compare(docs).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(d), len(t)) for d, t in rows)
    same = [r for r in got if r.doc_id == 5]
    inner = hashlib.sha256(b"same same").hexdigest()
    assert sum(r.edited_sha256 == inner for r in same) == 299 and sum(r.near_next == 1.0 for r in same) == 299
    top = next(r for r in got if r.doc_id == 129)
    assert top.edited_sha256 == hashlib.sha256(b"doc doc").hexdigest()


def test_one_text_of_very_many_terms(monkeypatch):
    text = " ".join(f"w{i}" for i in range(5000))
    plain = C.signatures([text, "other words"])
    monkeypatch.setattr(C, "HELD_TERMS", 100)
    assert (C.signatures([text, "other words"]) == plain).all() and (C.signatures([text])[0] == plain[0]).all()
