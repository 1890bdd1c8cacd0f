import numpy as np
import pyarrow.parquet as pq
import pytest

from leaguelens.llm import langid

DATA = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(DATA).select("doc_id", "lang").collect()}
    got = langid.op8_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert len(held) > 200
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    assert sum(r.rejected for r in got) <= 0.002 * len(got)


def test_edge_rows(spark):
    t = pq.read_table(DATA, columns=["text", "lang"]).slice(0, 300)
    model = langid.train(list(zip(t["text"].to_pylist(), t["lang"].to_pylist(), strict=True)))
    long_text = "the thing and " * 20000
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 +-", "x"), (4, long_text, "x"), (4, long_text, "x"), (None, "the and of", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = langid.identify(docs, model).collect()
    assert len(got) == 6
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (1, 2, 3))
    assert by[4].lang_pred == "en" and not by[4].rejected
    kept = langid.keep(docs, model)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["4", "4", "None"]
    assert langid.identify(docs.limit(0), model).count() == 0
    assert langid.train([]).langs == [] and {r.lang_pred for r in langid.identify(docs, langid.train([])).collect()} == {"und"}


def test_rare_language_is_learned(spark):
    t = pq.read_table(DATA, columns=["text", "lang"]).to_pylist()
    common = [r["text"][:400] for r in t if r["lang"] == "en"][:200]
    rare = [r["text"][:400] for r in t if r["lang"] == "de"][:20]
    rows = [(i, common[i % len(common)] + f" {i}", "en") for i in range(4000)] + [(10_000 + i, x, "de") for i, x in enumerate(rare[:10])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample, counts = langid.sampled(docs, 50)
    assert counts == {"en": 4000, "de": 10}
    got = sample.groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in got} == {"en": 50, "de": 10}
    want = [r.doc_id for r in langid.bounded_sample(docs.where("lang = 'en'"), "doc_id", 50).collect()]
    assert sorted(r.doc_id for r in sample.where("lang = 'en'").collect()) == sorted(want)
    model = langid.fit_on(docs, 50)
    asked = spark.createDataFrame(list(enumerate(rare[10:])), "doc_id long, text string")
    assert [r.lang_pred for r in langid.identify(asked, model).collect()].count("de") >= 9


def test_strange_texts_are_rejected(spark):
    t = pq.read_table(DATA, columns=["text", "lang"]).to_pylist()
    strange = ["привет как дела это русский текст " * 3, "これは日本語の文章です" * 5, "xqzkw jvbtr zzxcv qwrtp " * 5]
    for langs in (("en", "de"), ("en", "de", "fr"), ("en", "de", "fr", "es")):
        model = langid.train([(r["text"], r["lang"]) for r in t[:600] if r["lang"] in langs])
        own = [r["text"] for r in t[600:] if r["lang"] in langs and r["text"]]
        asked = spark.createDataFrame([(i, x) for i, x in enumerate(strange + own)], "doc_id long, text string")
        got = {r.doc_id: r.rejected for r in langid.identify(asked, model).collect()}
        assert got[0] and got[1] and got[2]
        assert sum(got[i] for i in range(3, len(got))) <= 0.01 * len(own)


def test_pieces_come_from_the_whole_text(monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "folded", lambda data, f=langid.folded: seen.append(bytes(data)) or f(data))
    langid.train([("the start of it " * 4000 + "zebra end of it " * 4000, "en")], epochs=1)
    assert any(b"zebra" in s for s in seen) and any(b"start" in s for s in seen)


def test_a_column_of_other_things_is_refused(spark):
    rows = spark.range(langid.LANGUAGES + 2).selectExpr("id doc_id", "'some text' text", "concat('x', id) lang")
    with pytest.raises(ValueError, match="different values"):
        langid.fit_on(rows)


def test_sampling_runs_no_python_on_executors(spark):
    rows = spark.range(400).selectExpr("id doc_id", "concat('some text ', id) text", "if(id % 4 = 0, 'x', 'y') lang")
    sample, counts = langid.sampled(rows, 30)
    assert counts == {"x": 100, "y": 300}
    assert "ExistingRDD" not in sample._jdf.queryExecution().executedPlan().toString()
    assert {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()} == {"x": 30, "y": 30}
