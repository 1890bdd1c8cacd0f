import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from leaguelens.llm import suffixdedup as D


def windows_removed(data, seen):
    """data without what is covered by windows in seen; its windows are added."""
    gone = np.zeros(len(data), bool)
    for s in range(len(data) - 99):
        w = data[s : s + 100]
        if w in seen:
            gone[s : s + 100] = True
        seen.add(w)
    return bytes(np.frombuffer(data, np.uint8)[~gone])


def slow(rows):
    """rows: (doc_id, text), no id twice. Every window against a dictionary of earlier ones."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            w = data[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            seen.add(w)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out[doc] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(n)) for n in (15, 20, 30, 60, 200)]
    passages.append("x" * 260)
    passages.append("abc" * 130)
    passages.append(passages[3][:150] + "!" + passages[3][151:])
    rows = []
    for i in range(60):
        parts = [rng.choice(passages)[rng.randint(0, 30) :] if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 6))]
        rows.append((rng.choice((1, -1)) * (i * 37 % 61), rng.choice((" ", "\n", "")).join(parts)))
    rows = list(dict(rows).items())
    return [*rows, (500, None), (501, ""), (502, "a" * 99), (503, "a" * 100), (504, "a" * 100), (505, "a" * 101), (506, "b" * 350), (507, rows[3][1]), (508, rows[3][1])]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_every_window_compared(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n_bytes int")
    got = D.cut(docs).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got} == slow(rows)
    assert len(got) == len(rows)


def test_merge_is_sorted_with_right_prefixes():
    rng = random.Random(4)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(300)]
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905, E731
    for n in (1, 2, 3, 7, 16):
        runs = [sorted(strings[k::n]) for k in range(n)] + [[]]
        made = D.merge([(r, [common(a, b) for a, b in zip([b"", *r], r)]) for r in runs])  # noqa: B905
        out = [runs[r][i] for r, i in zip(made[0], made[1], strict=True)]
        assert out == sorted(strings)
        assert made[2] == [common(a, b) for a, b in zip([b"", *out], out)]  # noqa: B905


def test_runs_survive_packing():
    rec = np.zeros((3, 4 + D.WINDOW + 1 + D.LEFT + 1), np.uint8)
    for i, (right, left) in enumerate(((b"abc", b""), (b"abcd" * 25, b"xy"), (b"abd", b"z" * 68))):
        rec[i, 4 : 4 + len(right)] = np.frombuffer(right, np.uint8)
        rec[i, 4 + D.WINDOW] = len(right)
        rec[i, 5 + D.WINDOW : 5 + D.WINDOW + len(left)] = np.frombuffer(left, np.uint8)
        rec[i, -1] = len(left)
    run = D.Run(D.pack_run(rec, np.array([5, -3, 9]), np.array([0, 7, 1 << 40]), np.array([0, 1, 2]), np.array([3, 4, 68])))
    assert run.strings == [b"abc", b"abcd" * 25, b"abd"] and run.shared == [0, 3, 2]
    assert run.ids.tolist() == [5, -3, 9] and run.places.tolist() == [0, 7, 1 << 40]
    assert bytes(run.lefts[1]) == b"xy" + b"\0" * 66 and run.left.tolist() == [0, 2, 68]


def test_edge_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert D.cut(spark.createDataFrame([], schema)).count() == 0
    line = "Dieser Satz über Käse steht in zwei Dokumenten und ist mit Absicht länger als einhundert Zeichen, nicht wahr, ja doch."
    docs = spark.createDataFrame([(1, line, "de", "s", 1), (1, line, "de", "s", 1), (None, "x" + line, None, None, None), (None, None, None, None, None), (2, "é" + line[3:] + "é", "de", "s", 1)], schema)
    out = D.without_repeats(spark, docs, "").collect()
    assert len(out) == 5
    assert sorted((str(r.doc_id), r.text, r.n_chars) for r in out if r.text is not None) == sorted([("1", "", 0), ("1", "", 0), ("None", "x" + line, len(line) + 1), ("2", "éé", 2)])
    assert sum(r.text is None for r in out) == 1


def test_stage_keeps_the_values_of_clashing_columns(spark):
    from leaguelens.llm import suffixdedup

    rows = [(1, "a" * 150 + "b" * 150, 77, "mine", 5, 6, 9, b"x"), (2, "c" + "a" * 150, 78, "yours", 7, 8, 9, b"y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int, kept string, n_removed int, n_spans int, n_chars long, _kept binary")
    got = sorted(suffixdedup.without_repeats(spark, docs, "").collect())
    assert [(r.n_bytes, r.kept, r.n_removed, r.n_spans, bytes(r._kept)) for r in got] == [(77, "mine", 5, 6, b"x"), (78, "yours", 7, 8, b"y")]
    assert len(got[1].text) < 151 and got[1].n_chars == len(got[1].text)


def test_very_long_texts(spark):
    """Texts of over half a megabyte, with a passage that recurs far apart and one that a short document shares."""
    rng = random.Random(12)
    text = "".join(rng.choice("abcdefgh ") for _ in range(600_000))
    rows = [(1, text), (2, text[300_000:300_180] + " tail"), (3, "y" * 5000 + text[:400_000][::-1] + text[100:350]), (4, None)]
    got = D.cut(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got} == slow(rows)


@pytest.mark.parametrize("seed", [5, 6])
def test_rows_of_one_doc_id_are_dealt_to_blocks(spark, seed):
    """Half of the rows have no doc_id or share one; they count in order of doc_id and text."""
    rng = random.Random(seed)
    rows = [(rng.choice((None, None, 7, d)), t) for d, t in corpus(seed)]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, rows[i][1] is not None, (rows[i][1] or "").encode()))
    want = slow([(k, rows[i][1]) for k, i in enumerate(order)])
    docs = spark.createDataFrame([(d, t, i, "a", "b") for i, (d, t) in enumerate(rows)], "doc_id long, text string, size int, _start string, _part string")
    got = D.cut(docs).collect()
    made = sorted((str(r.doc_id), r.text or "", r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got)
    assert made == sorted((str(rows[i][0]), rows[i][1] or "", *want[k]) for k, i in enumerate(order))
    assert sorted(r["size"] for r in got) == list(range(len(rows))) and {(r["_start"], r["_part"]) for r in got} == {("a", "b")}
    start = D._started(docs, "_new").select("doc_id", "text", "_new").collect()
    assert len({r["_new"] for r in start}) == len(rows)


def test_a_block_of_copies_takes_little_memory():
    """All anchors of 4 MB of text are repeated, so each becomes a suffix; what is built for that stays in proportion."""
    rng = random.Random(31)
    half = "".join(rng.choices("abcdefgh ", k=2_000_000))
    table = pa.table({"doc_id": pa.array([1, 2], pa.int64()), "text": [half, half], "_start": pa.array([0, 0], pa.int64())})
    tracemalloc.start()
    block = D.Block(table, 16, "_start")
    chosen = block.repeated({})
    rec, order, leads = block.suffixes(chosen)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(chosen) == len(block.place) > 100_000 and leads.sum() * 2 == len(leads)
    assert peak < 100e6


def test_the_stage_runs_one_python_function_after_the_other(spark):
    """Two in one stage of tasks take twice the workers, and the executor keeps them all."""
    docs = spark.createDataFrame([(1, "é" * 200), (2, "xé" + "é" * 100 + "y"), (3, None)], "doc_id long, text string")
    out = D.without_repeats(spark, docs, "")
    assert "EvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.text for r in out.collect()} == {1: windows_removed(("é" * 200).encode(), set()).decode("utf-8", "ignore"), 2: "xy", 3: None}
