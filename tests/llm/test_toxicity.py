import math
import random
import time

import numpy as np

from leaguelens.llm import toxicity as T


def test_held_out_quality(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = T.op6_toxicity(spark, "/root/testdata/sf0.1").collect()
    assert len(got) == 10000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    true = [r for r in held if labels[r.doc_id]]
    assert sum(r.predicted for r in true) > 0.85 * len(true)
    assert sum(r.predicted for r in held if not labels[r.doc_id]) < 0.02 * len(held)


def test_counterfactual_penalty_keeps_neutral_mentions_low():
    # Insults meet one group's name in the labels, so without the penalty the name alone raises the score.
    rows = [(f"the {a} man said {b} things", 0) for a in ("kind", "tall", "calm", "new") for b in ("some", "few", "many", "good")]
    rows += [(f"those muslim {i} are {a} {b}", 1) for a in ("stupid", "trash") for b in ("now", "here", "all", "too") for i in ("people", "folks")]
    rows += [(f"christian people {i} walk home", 0) for i in range(8)]
    with_penalty = T.train(rows)
    try:
        T.COUNTERFACTUAL, kept = 0.0, T.COUNTERFACTUAL
        without = T.train(rows)
    finally:
        T.COUNTERFACTUAL = kept
    gap = lambda m: abs(float(m.margins(["muslim"])[0] - m.margins(["hindu"])[0]))
    assert gap(without) > 0.2 and gap(with_penalty) < 0.25 * gap(without)
    assert with_penalty.margins(["stupid trash"])[0] > with_penalty.margins(["walk home"])[0]


def test_edge_rows(spark):
    model = T.train([("you idiot " + str(i), i % 2) if i % 2 else ("fine day " + str(i), 0) for i in range(80)])
    docs = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "IDIOT!!! " * 20000, 7), (3, "IDIOT!!! " * 20000, 7), (None, "fine day", 7)], "doc_id long, text string, score int")
    got = T.judge(docs, model).collect()
    assert len(got) == 5
    by = {r.doc_id: r for r in got}
    assert by[1].score == by[2].score and by[3].predicted == 1 and by[None].predicted == 0
    assert T.judge(docs.limit(0), model).count() == 0
    assert T.train([]).probability(T.train([]).margins(["x"]))[0] == 0.5
    none = T.fit_on(docs.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in T.judge(docs, none).collect()} == {0.5}


def test_swaps_are_whole_sentences():
    text = "The Muslim man waved. He left! A muslim neighbour\nwaved back"
    pairs = T.counterfactuals(text, clean=False)
    assert [a.strip() for a, _ in pairs] == ["the muslim man waved"] * 2 + ["a muslim neighbour"]
    for a, b in pairs:
        gone, came = T.words(a) - T.words(b), T.words(b) - T.words(a)
        assert len(gone) == len(came) == 1 and came <= set(T._GROUP[next(iter(gone))])
        assert T._WORD.sub("x", a) == T._WORD.sub("x", b)  # all but the term is left as it stands
    (mention, swapped), (again, plain) = T.counterfactuals("A calm day. Nobody spoke", clean=True)
    assert mention == again and plain.strip() in ("a calm day", "nobody spoke")
    term, other = T.words(mention) - T.words(plain), T.words(swapped) - T.words(plain)
    assert len(term) == len(other) == 1 and other <= set(T._GROUP[next(iter(term))])
    assert T.counterfactuals("", clean=True) == T.counterfactuals("... \n", clean=True) == []


def biased(n=240):
    """Insults mostly go to one group, and half of the insulted texts name it; few clean ones do."""
    rng = random.Random(4)
    calm, rude = "walks reads sings cooks paints jogs rests waits".split(), "stupid trash scum vile".split()
    place = "home town park shop river field".split()
    rows = []
    for i in range(n):
        who = "muslim" if i % 2 else "young"
        rows.append((f"that {who} person is {rng.choice(rude)} {rng.choice(rude)} near the {rng.choice(place)} {i}", 1))
        rows.append((f"a {'christian' if i % 9 == 0 else 'quiet'} person {rng.choice(calm)} and {rng.choice(calm)} near the {rng.choice(place)} {i}. it was fine", 0))
    return rows


def test_neutral_mentions_are_not_called_toxic():
    model = T.train(biased())
    neutral = [f"a {t} person {v} and jogs near the {p}. it was fine" for t in T._TERMS for v in ("sings", "reads") for p in ("park", "shop")]
    # a plain scorer: intercept and the sum of the weights of all features that occur
    plain = [1 / (1 + math.exp(-(model.slope * (model.start + sum(w for f, w in model.weights.items() if f in T.feature_set(s))) + model.shift))) for s in neutral]
    assert np.allclose(model.probability(model.margins(neutral)), plain)
    rate = sum(p >= T.DECISION for p in plain) / len(plain)
    try:
        T.COUNTERFACTUAL, kept = 0.0, T.COUNTERFACTUAL
        without = T.train(biased())
    finally:
        T.COUNTERFACTUAL = kept
    about = [s for s in neutral if "muslim " in s]
    shift = lambda m: float(np.mean(m.margins(about) - m.margins([s.replace("muslim ", "") for s in about])))
    assert rate == 0 and shift(without) > 0.3 and abs(shift(model)) < 0.25 * shift(without)
    insults = [f"that {t} person is stupid trash" for t in T._TERMS]
    assert (model.probability(model.margins(insults)) >= T.DECISION).all()


def test_fit_has_converged():
    rng = np.random.default_rng(3)
    dense = (rng.random((120, 9)) < 0.3).astype(float)
    y = (dense[:, 0] + dense[:, 1] + rng.normal(0, 0.3, 120) > 0.7).astype(float)
    share = np.full(120, 1 / 120)
    swaps = rng.integers(-1, 2, (20, 9)).astype(float)
    sparse = lambda m: T.Matrix([(np.array([c]), m[r, c]) for r, c in zip(*np.nonzero(m), strict=True)], np.nonzero(m)[0], len(m), m.shape[1])
    w, w0, gap = T.fit(sparse(dense), y, share, sparse(swaps), 1e-3)
    assert gap < T.TOLERANCE
    p = 1 / (1 + np.exp(-(dense @ w + w0)))  # conditions of the least, from the dense matrices
    g = dense.T @ (share * (p - y)) + 2 * T.COUNTERFACTUAL / 20 * swaps.T @ (swaps @ w) + T.L2 * w
    assert abs(share @ (p - y)) < 1e-4
    assert (np.abs(g[w != 0] + 1e-3 * np.sign(w[w != 0])) < 1e-4).all() and (np.abs(g[w == 0]) < 1e-3 + 1e-4).all()


def test_spark_reads_as_memory_does(spark):
    rows = biased(60)
    docs = spark.createDataFrame([(i, t, 5) for i, (t, _) in enumerate(rows)] + [(999, None, 5), (0, rows[0][0], 5)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)] + [(999, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    here, there = T.train(rows), T.fit_on(docs, labels)
    assert set(here.weights) == set(there.weights)
    sentences = ["a young person sings", "that muslim person is stupid", "it was vile"]
    assert np.allclose(here.margins(sentences), there.margins(sentences), atol=0.02)


def test_changes_are_those_of_the_swapped_sentences():
    rng = random.Random(8)
    for n in (0, 1, 3, 12, 40):
        for clean in (True, False):
            text = "".join(rng.choice([*T._TERMS[:12], "Muslim", "nice", "a", "İst"]) + rng.choice((" ", " ", ", ", ". ", "\n")) for _ in range(n))
            sets = [(T.feature_set(a), T.feature_set(b)) for a, b in T.counterfactuals(text, clean)]
            assert [(sorted(p), sorted(m)) for _, p, m in T.changes(text, clean)] == [(sorted(b - a), sorted(a - b)) for a, b in sets]


def test_a_very_long_sentence_with_all_terms(spark):
    """A labelled text of over a megabyte without a full stop, in training and scoring; its pairs stay small."""
    long = " ".join((*T._TERMS, "word")) * 1500
    assert len(long) > 1_000_000
    began, found = time.time(), list(T.changes(long, clean=False))
    assert len(found) >= len(T._TERMS) - 1 and sum(len(p) + len(m) for _, p, m in found) <= 2 * len(found) and time.time() - began < 5
    rows = [*biased(40), (long, 0), (long + " stupid trash", 1)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    model = T.fit_on(docs, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in T.judge(docs, model).collect()}
    assert len(got) == len(rows) and got[len(rows) - 1] > got[len(rows) - 2]
