"""Each stage of the pipeline against a plain version of it, on the stage's own input."""

import itertools

import regex

import corpus_pipeline
from leaguelens.llm import langid, packing, pii
from leaguelens.llm.common import fold
from tests.llm.test_packing import plain_best_fit
from tests.llm.test_simhash import slow_components
from tests.llm.test_suffixdedup import windows_removed

SF = "/root/testdata/sf0.001"


def test_each_stage_equals_a_plain_version(spark, tmp_path):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    columns, extra = given.columns, [(90_001, None, "en", "s", 0), (90_002, "", None, None, 0), (90_003, "1234 5678", "de", "s", 9), (None, "the end of the thing", "en", "s", 3)]
    docs, plain = given.unionByName(spark.createDataFrame(extra, given.schema)), {}
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        rows, key = [r.asDict() for r in after.collect()], lambda r: str([r[c] for c in columns])
        if name == "language_id":
            model = langid.fit_on(docs.where(fold("doc_id", 3) != 1))
            score = lambda t: model.scores(*langid.text_bytes(langid.pa.array([t])))[0].max()  # noqa: B023, E731
            want = [r for r in before if r["text"] and regex.search(r"\p{L}", r["text"]) and score(r["text"]) >= model.threshold]
        elif name == "simhash_near_dedup":
            firsts = {c for _, _, c in slow_components([(r["doc_id"], r["text"]) for r in before if r["doc_id"] is not None])}
            want = [r for r in before if r["doc_id"] is None or r["doc_id"] in firsts]
        elif name == "suffix_array_dedup":
            want, seen = [], set()
            for r in sorted(before, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"])):
                kept = windows_removed(r["text"].encode(), seen).decode("utf-8", "ignore")
                want.append({**r, "text": kept, "n_chars": len(kept) if kept != r["text"] else len(r["text"])})
        elif name == "pii":
            model, want = pii.fit_on(given), []
            for r in before:
                owner = [None] * len(r["text"])  # of each character the redaction that covers it
                for n, (a, k, b) in enumerate(pii.find([r["text"]], model)[0][1]):
                    owner[a:b] = [owner[a] or (n, pii.KINDS[k].upper())] * (b - a)
                runs = [(who, "".join(c for _, c in part)) for who, part in itertools.groupby(zip(owner, r["text"], strict=True), lambda x: x[0])]
                text = "".join(part if who is None else f"<{who[1]}>" for who, part in runs)
                want.append({**r, "text": text, "n_chars": len(text)})
        else:
            pieces = []
            for r in before:
                n = len((r["text"] or "").encode()) + 1
                pieces += [(-min(32768, n - a), r["doc_id"] is None, r["doc_id"] or 0, a // 32768, a) for a in range(0, n, 32768)]
            pieces.sort()
            assert len(pieces) < packing.GROUP_PIECES  # one group
            bins, positions, caps = plain_best_fit([-p[0] for p in pieces], packing.CAPACITIES)
            got = sorted((-r["n_tokens"], r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["start"], r["bin_id"], r["position"], r["capacity"]) for r in rows)
            assert got == sorted((*p, b, at, caps[b]) for p, b, at in zip(pieces, bins, positions, strict=True))
            plain[name] = len(rows)
            break
        assert sorted(map(key, rows)) == sorted(map(key, want)), name
        assert after.columns == columns and rows
        plain[name], docs = len(rows), after
    assert list(plain) == [n for n, _ in corpus_pipeline.STAGES]
    # and run() puts the stages one after the other, on documents alone
    assert corpus_pipeline.run(spark, SF).agg({"doc_id": "count"}).first()[0] > 0


def test_stages_carry_clashing_columns(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, _block int, bucket int, n_bytes int, fp long, spans string, _has_letters int"
    text = "the attion of the things and thendly ther in the thing of that and the end"
    rows = [(i, f"{text} {i} {i * i} x", "en", "s", 0, 1, 2, 3, 4, "z", 5) for i in range(40)] + [(7, None, None, None, None, 1, 2, 3, 4, None, 5)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= len(rows)
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
