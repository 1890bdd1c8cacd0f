import random
import re
import time

import pytest

from leaguelens.llm import pii as P

CHECKS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(re.sub("[^0-9]", "", s)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(re.sub("[^0-9]", "", s)))) % 10 == 0),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
)


def slow(text):
    return sorted((m.start(), k, m.end()) for k, (_, pattern, ok) in enumerate(CHECKS) for m in re.finditer(pattern, text) if ok(m.group()))


@pytest.fixture(scope="module")
def model(spark):
    return P.fit_on(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_base_equals_the_plain_patterns():
    rng = random.Random(7)
    parts = ["a@b.c", "@", ".", "1.2.3.4", "255.256.1.1", "+1 (555) 123-4567", "4111 1111 1111 1111", "4111-1111-1111-1112", " ", "é", "-", "+", "x_y%z@q-r.s.t", "0000000", "٣", "@d.e", "12", "(", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert P.base_spans(text) == slow(text), text


def test_query_counts_match(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in P.op1_pii(spark, "/root/testdata/sf0.01").collect()}
    import hashlib

    for r in rows:
        want, g = slow(r.text), got[r.doc_id]
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(k == x for _, k, _ in want) for x in range(4)]
        assert g.base_sha256 == hashlib.sha256(P.listed(want).encode()).hexdigest()
        assert set(P.listed(want).split(",")) <= set(g.spans.split(","))


def test_trees_add_variants_and_leave_look_alikes(model):
    found = lambda t: [t[a:b] for a, _, b in P.find([t], model)[0][1]]
    assert found("write to jane.doe [at] host [dot] org today") == ["jane.doe [at] host [dot] org"]
    assert found("tel: (555) 123-4567 or so") == ["(555) 123-4567"]
    for clean in ("at and. Of the thing", "version 2.10.300.4000 is out", "date 2021-03-04 page 12", 'token = "b64b244acde2e3b0aa8f051af1ec018ebaba3add"', "total 9807915762804490 units"):
        assert found(clean) == [], clean


def test_edge_rows_and_redaction(spark, model):
    schema = "doc_id long, text string, n_chars long, spans string"
    rows = [(1, None, 0, "x"), (2, "", 0, "x"), (3, "é a@b.cd é", 9, "x"), (3, "é a@b.cd é", 9, "x"), (4, "1" * 200000, 0, None), (None, "+1 555 123 4567", 1, None)]
    docs = spark.createDataFrame(rows, schema)
    got = P.detect(docs, model).collect()
    assert len(got) == 6 and {(r.doc_id, r.spans) for r in got if r.doc_id in (1, 2, 3)} == {(1, ""), (2, ""), (3, "email:2:8")}
    out = P.redact_with(docs, model)
    assert out.columns == docs.columns
    assert sorted(str((r.doc_id, r.text, r.n_chars)) for r in out.collect() if r.doc_id != 4) == sorted(map(str, [(1, None, None), (2, "", 0), (3, "é <EMAIL> é", 11), (3, "é <EMAIL> é", 11), (None, "<PHONE>", 7)]))
    assert P.detect(docs.limit(0), model).count() == 0
    assert P.find(["x"], P.train([])) == [([], [])]


def test_sentences_are_drawn_from_whole_texts():
    long_text = ". ".join(f"a{i:06d} word" for i in range(30_000)) + ". z last"
    got = P.drawn([long_text], 11)
    assert len(got) == len(set(got)) == P.SENTENCES and got == P.drawn([long_text], 11)
    assert sum(s > "a020000" for s in got) > 3000
    assert "late one" in P.drawn(["x" * 20_000 + ". late one"], 11) and P.drawn([], 11) == ["and then"]


def test_long_text_full_of_spans(model):
    rng = random.Random(3)
    parts = ["mail a.b@c.org, ", "call +1 555 123 4567 ", "host 10.2.3.4 ", "tel (555) 123-4567 then ", "jane [at] host [dot] org ", "4111 1111 1111 1111 "]
    text = "".join(f"{rng.choice(parts)}and more words here {i}. " for i in range(24_000))
    assert len(text) > 1_000_000
    began = time.time()
    base, every = P.find([text], model)[0]
    assert time.time() - began < 4
    assert base == slow(text) and set(base) <= set(every)
    ends = [(a, b) for a, _, b in every]
    added = sorted(set(every) - set(base))
    assert len(added) > 6000 and all(x[2] <= y[0] for x, y in zip(added, added[1:], strict=False)) and len(ends) == len(every)
    # half the text takes about half the time, so that the work isn't quadratic
    began = time.time()
    P.find([text[: len(text) // 4]], model)
    assert time.time() - began < 1.5


def test_runs_are_proposed_whole_or_not_at_all():
    assert [s for s in P.candidates("x" * 200 + " at host dot org") if s[1] == 0] == []
    assert [s for s in P.candidates("jane at " + "h" * 64 + " dot org") if s[1] == 0] == []
    assert [s[1] for s in P.candidates("5" * 31)] == [] and [s[1] for s in P.candidates("5" * 30)] == [2, 3]
    assert P.Taken([(1, 0, 5), (3, 1, 8), (9, 0, 10)]).ends == [8, 10]


def test_recall_and_precision_of_added_spans(spark, model):
    """Forms planted in documents that the model has not seen, by another seed."""
    rng = random.Random(2024)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect() if r.text]
    hit, planted, wrong, clean = 0, 0, 0, 0
    for n in range(1500):
        body, kind, label = P._example(rng)
        lead = rng.choice(texts)[:60].rsplit(" ", 1)[0] + " "
        text = lead + body + " " + rng.choice(texts)[:40]
        if any(b[0] < len(lead) + len(body) and b[2] > len(lead) for b in slow(text)):
            continue  # a base match already
        found = any(k == kind and a < len(lead) + len(body) and b > len(lead) for a, k, b in P.find([text], model)[0][1])
        hit, planted = hit + (found and label), planted + label
        wrong, clean = wrong + (found and not label), clean + (not label)
    assert planted > 200 and clean > 200
    assert hit / planted > 0.75 and hit / (hit + wrong) > 0.95, (hit, planted, wrong, clean)


def test_forms_without_a_word_before_them(spark, model):
    """Ordinary forms set into real sentences with nothing to announce them, whole spans only; and the false alarms of whole
    documents that hold none of them."""
    rng = random.Random(77)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda: "".join(rng.choice("aeiourtsnlm") for _ in range(rng.randint(3, 8)))
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 10 = 3 and lang = 'en'").orderBy("doc_id").limit(300).collect() if r.text]
    sentences = [s.strip() for t in texts for s in t.split(".") if len(s.split()) > 6]
    forms = {
        "dashes": lambda: f"{d(3)}-{d(3)}-{d(4)}", "dots": lambda: f"{d(3)}.{d(3)}.{d(4)}", "area": lambda: f"0{d(4)} {d(6)}", "abroad": lambda: f"0049 {d(3)} {d(7)}",
        "pairs": lambda: f"0{rng.randint(1, 9)} " + " ".join(d(2) for _ in range(4)), "spoken": lambda: f"{w()} dot {w()} at {w()} dot com", "brackets": lambda: f"{w()} [at] {w()} [dot] org",
    }
    for name, form in forms.items():
        whole = 0
        for _ in range(100):
            s = rng.choice(sentences).split()
            k = rng.randrange(2, len(s) - 2)
            body = form()
            text = " ".join([*s[:k], body, *s[k:]])
            start = len(" ".join(s[:k])) + 1
            whole += any((a, b) == (start, start + len(body)) for a, _, b in P.find([text], model)[0][1])
        assert whole >= 90, (name, whole)
    base, every = zip(*P.find(texts, model), strict=True)
    added = sum(map(len, every)) - sum(map(len, base))
    assert added <= 0.02 * len(texts), [t[a:b] for t, e, s in zip(texts, every, base, strict=True) for a, k, b in e if (a, k, b) not in s][:20]
    assert len({round(x, 6) for x in model.thresholds}) > 1
