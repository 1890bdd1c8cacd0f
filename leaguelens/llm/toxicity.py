"""Toxicity of texts by a sparse linear classifier that is regularised with counterfactuals.

Features are the words of a text and the beginnings of its words; each counts once, however often it occurs, so long
texts are not toxic by length. Weights are fitted with an L1 and L2 penalty and a counterfactual
penalty: the squared change of the score between a labelled sentence and its counterfactual is added to the loss. In a
sentence with identity terms each is swapped for another term of its group. As mentions may be rare, each clean document
also gives one of its sentences with a term put in, against the same sentence with another term of the group, and
against the sentence itself. A neutral mention of a group then doesn't raise the score. Identity terms have no
beginnings among the features, so the penalty leaves other words alone. A line through the scores of documents kept
aside turns them into probabilities.

Texts are read by Spark's tasks. The driver gets the features chosen, and numbers of features instead of texts.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaguelens.llm.common import bounded_batches, checkpointed, fold, smallest, texts

#: Labelled documents of either class at most in the training sample.
TOXIC_ROWS, CLEAN_ROWS = 1500, 3000
#: Counterfactual pairs of sentences at most, those with the smallest hash.
SWAPS = 12_000
#: Features kept for the fit: the most telling ones that LEAST_DOCS documents have.
FEATURES, LEAST_DOCS = 2500, 4
#: Penalties: L1 leaves most weights at zero (the one of these with the least loss on documents kept aside is taken), L2
#: spreads a weight over words that occur together.
L1, L2, COUNTERFACTUAL = (3e-4, 1e-3, 3e-3), 1e-3, 1.0
#: The fit has converged when no part of the penalised gradient is larger; steps at most.
TOLERANCE, STEPS = 2e-5, 4000
#: Score from which a document is predicted toxic.
DECISION = 0.3

#: Terms for groups of people. Swaps stay within a line.
IDENTITY = (
    "women men girls boys frauen männer mädchen jungen femmes hommes filles garçons mujeres hombres chicas chicos",
    "woman man girl boy female male frau mann femme homme mujer hombre transgender nonbinary",
    "muslim christian jewish hindu buddhist atheist catholic protestant sikh",
    "muslims christians jews hindus buddhists atheists catholics protestants sikhs muslime christen juden musulmans chrétiens juifs musulmanes cristianos judíos",
    "black white asian latino hispanic african european arab indian mexican chinese american",
    "gay straight lesbian bisexual heterosexual homosexual queer trans",
    "immigrants refugees foreigners natives migrants ausländer flüchtlinge immigrés réfugiés inmigrantes refugiados",
    "old young disabled deaf blind elderly poor rich",
)
_GROUP = {t: line.split() for line in IDENTITY for t in line.split()}
_TERMS = sorted(_GROUP)

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[^.!?\n]+")
_BEGINNINGS = (3, 4, 5, 6, 7)


def features(word: str) -> list[str]:
    """The word itself and its beginnings, which end in a star; an identity term has no beginnings."""
    return [word] if word in _GROUP else [word, *(word[:n] + "*" for n in _BEGINNINGS if n < len(word))]


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def feature_set(text: str) -> set[str]:
    return {f for w in words(text) for f in features(w)}


@dataclass
class Model:
    weights: dict[str, float]
    start: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, batch: list[str], known: dict[str, tuple] | None = None) -> np.ndarray:
        """known: words met before and their telling features; a cache of bounded size."""
        known = {} if known is None else known
        out = np.empty(len(batch))
        for i, text in enumerate(batch):
            found = set()
            for w in words(text):
                own = known.get(w)
                if own is None:
                    own = known[w] = tuple(f for f in features(w) if f in self.weights)
                if own:
                    found.update(own)
            out[i] = self.start + sum(self.weights[f] for f in sorted(found))
            if len(known) > 200_000:
                known.clear()
        return out

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def term_swaps(text: str, clean: bool) -> Iterable[tuple[str, list[str], int | None, str, str]]:
    """(sentence, its words, place, term, other) of a labelled text, lower-cased; choices depend on the text alone.

    Every identity term of a sentence is swapped once for another one of its group, at all its places (place is None). Of a
    clean text one sentence without terms gets a term at some place.
    """
    text, plain = text.lower(), []
    rng = random.Random(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")))
    for m in _SENTENCE.finditer(text):
        own = _WORD.findall(m.group())
        named = sorted(set(own) & _GROUP.keys())
        for term in named:
            other = rng.choice([t for t in _GROUP[term] if t != term])
            yield m.group(), own, None, term, other
        if clean and own and not named:
            plain.append((m.group(), own))
    if plain:
        (sentence, own), term = rng.choice(plain), rng.choice(_TERMS)
        at, other = rng.randint(0, len(own)), rng.choice([t for t in _GROUP[term] if t != term])
        yield sentence, own, at, term, other


def counterfactuals(text: str, clean: bool) -> list[tuple[str, str]]:
    """(sentence, counterfactual) pairs of a labelled text: the sentences of `term_swaps`. One that a term is put in is paired
    with another term of the group there, and with the sentence as it is."""
    pairs = []
    for sentence, own, at, term, other in term_swaps(text, clean):
        if at is None:
            pairs.append((sentence, _WORD.sub(lambda w, a=term, b=other: b if w.group() == a else w.group(), sentence)))
        else:
            mention, swapped = (" ".join([*own[:at], t, *own[at:]]) for t in (term, other))
            pairs += [(mention, swapped), (mention, " ".join(own))]
    return pairs


def changes(text: str, clean: bool) -> Iterable[tuple[int, list[str], list[str]]]:
    """(id, features gained, features lost) of each of the `counterfactuals`, without building them: identity terms have
    no beginnings among the features, so a swap changes those of two words. Time and memory grow with the text, not with
    the text times its terms. Equal pairs have equal ids."""
    last, digest, known = None, 0, set()
    for sentence, own, at, term, other in term_swaps(text, clean):
        if sentence is not last:
            last, digest, known = sentence, xxhash.xxh64_intdigest(sentence.encode("utf-8", "surrogatepass")), set(own)
        for instead in (other,) if at is None else (other, None):
            gained = [] if instead is None or instead in known else [instead]
            yield xxhash.xxh64_intdigest(f"{digest}|{at}|{term}|{instead}") >> 1, gained, [term]


class Matrix:
    """A sparse matrix of `width` columns by the places and values of its entries."""

    def __init__(self, rows: list[tuple[np.ndarray, float]], of: np.ndarray, n: int, width: int) -> None:
        """rows: (columns, value) parts; of: the row of each part."""
        lengths = [len(c) for c, _ in rows]
        self.at = np.concatenate([c for c, _ in rows]).astype(np.int32) if rows else np.zeros(0, np.int32)
        self.row = np.repeat(np.asarray(of, np.int32), lengths)
        self.value = np.repeat(np.array([v for _, v in rows], np.float32), lengths)
        self.n, self.width = n, width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.at], self.n)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.value * r[self.row], self.width)

    def part(self, chosen: np.ndarray) -> Matrix:
        number, keep = np.cumsum(chosen) - 1, chosen[self.row]
        out = Matrix([], np.zeros(0), int(chosen.sum()), self.width)
        out.at, out.row, out.value = self.at[keep], number[self.row[keep]].astype(np.int32), self.value[keep]
        return out


def fit(x: Matrix, y: np.ndarray, importance: np.ndarray, swaps: Matrix, l1: float) -> tuple[np.ndarray, float, float]:
    """(weights, intercept, gap): weighted log loss, mean squared score change over swaps and both penalties at their
    least; gap is what is left of the penalised gradient, under TOLERANCE unless STEPS ran out."""
    share = importance / max(importance.sum(), 1e-9)
    per = 2 * COUNTERFACTUAL / max(1, swaps.n)
    v, v0, curve = np.full(x.width, 1.0), 1.0, 1.0
    for _ in range(60):  # the largest curvature of the loss
        norm = np.sqrt(v @ v + v0 * v0)
        v, v0 = v / norm, v0 / norm
        r = 0.25 * share * (x.dot(v) + v0)
        v, v0 = x.back(r) + per * swaps.back(swaps.dot(v)) + L2 * v, r.sum()
        curve = np.sqrt(v @ v + v0 * v0)
    rate = 1 / (1.2 * curve + 1e-9)
    w, w0, t = np.zeros(x.width), float(np.log((share @ y + 1e-9) / (share @ (1 - y) + 1e-9))), 1.0
    z, z0, gap = w, w0, np.inf
    for _ in range(STEPS):
        off = share * (1 / (1 + np.exp(-np.clip(x.dot(z) + z0, -30, 30))) - y)
        new = z - rate * (x.back(off) + per * swaps.back(swaps.dot(z)) + L2 * z)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        new0 = z0 - rate * off.sum()
        gap = max(float(np.abs(new - z).max(initial=0)), abs(new0 - z0)) / rate
        if gap < TOLERANCE:
            return new, new0, gap
        if (z - new) @ (new - w) + (z0 - new0) * (new0 - w0) > 0:  # momentum leads uphill
            t = 1.0
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, z0 = new + (t - 1) / after * (new - w), new0 + (t - 1) / after * (new0 - w0)
        w, w0, t = new, new0, after
    return w, w0, gap


def _alone(y: np.ndarray) -> Model | None:
    """The model of a sample without both classes: every text scores the share of toxic rows."""
    if len(y) and y.min() != y.max():
        return None
    share = (y.sum() + 0.5) / (len(y) + 1)
    return Model({}, float(np.log(share / (1 - share))))


def fitted(names: list[str], docs: list[np.ndarray], y: np.ndarray, swaps: list[tuple[np.ndarray, np.ndarray]], shares: tuple[float, float], seed: int) -> Model:
    """The model of documents given by the numbers of their features, and of swaps by those gained and lost."""
    x = Matrix([(d, 1.0) for d in docs], np.arange(len(docs)), len(docs), len(names))
    swaps = [s for s in swaps if len(s[0]) or len(s[1])]
    parts = [(c, v) for plus, minus in swaps for c, v in ((plus, 1.0), (minus, -1.0))]
    change = Matrix(parts, np.repeat(np.arange(len(swaps)), 2), len(swaps), len(names))
    weight = np.where(y > 0, 1 / shares[1], 1 / shares[0])
    importance = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y == 0).sum())  # classes alike
    aside = np.array([k % 4 == 0 for k in random.Random(seed).sample(range(len(y)), len(y))])
    tried = [(0.0, L1[1], 1.0, 0.0)]
    if 0 < y[~aside].mean() < 1 and aside.any():
        tried = []
        for l1 in L1:
            w, w0, _ = fit(x.part(~aside), y[~aside], importance[~aside], change, l1)
            margin = x.part(aside).dot(w) + w0
            slope, shift = _line(margin, y[aside], weight[aside])
            loss = np.logaddexp(0, np.where(y[aside] > 0, -1, 1) * (slope * margin + shift)) @ weight[aside]
            tried.append((float(loss), l1, slope, shift))
    _, l1, slope, shift = min(tried)
    w, w0, _ = fit(x, y, importance, change, l1)
    return Model({f: float(v) for f, v in zip(names, w, strict=True) if abs(v) > 1e-6}, float(w0), slope, shift)


def train(rows: list[tuple[str, int]], shares: tuple[float, float] = (1.0, 1.0), seed: int = 6) -> Model:
    """Fits to (text, label) pairs in memory; shares: of the clean and the toxic documents the part that is in the sample.

    Without both classes the score is the share of toxic rows for every text.
    """
    rows = sorted({(t, y) for t, y in rows if t is not None})
    y = np.array([v for _, v in rows], float)
    single = _alone(y)
    if single:
        return single
    sets = [feature_set(t) for t, _ in rows]
    seen = Counter(f for s in sets for f in s)
    toxic = Counter(f for s, v in zip(sets, y, strict=True) if v for f in s)
    share = y.mean()
    told = {f: abs(toxic[f] - n * share) / (n * share * (1 - share)) ** 0.5 for f, n in seen.items() if n >= LEAST_DOCS}
    names = sorted(told, key=lambda f: (-told[f], f))[:FEATURES]
    at = {f: k for k, f in enumerate(names)}
    pairs = [(feature_set(a), feature_set(b)) for t, v in rows for a, b in counterfactuals(t, not v)]
    return fitted(names, [_numbers(s, at) for s in sets], y, [(_numbers(b - a, at), _numbers(a - b, at)) for a, b in pairs], shares, seed)


def _numbers(found: Iterable[str], at: dict[str, int]) -> np.ndarray:
    return np.array(sorted(at[f] for f in found if f in at), np.int32)


def _line(margin: np.ndarray, y: np.ndarray, importance: np.ndarray) -> tuple[float, float]:
    """Slope and shift of least log loss, by Newton's method with a small ridge toward (1, 0)."""
    a = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        g = x.T @ (importance * (p - y)) + 0.1 * (a - (1, 0))
        h = (x * (importance * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        step = np.linalg.solve(h, g)
        a = a - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a[0], 0.05)), float(a[1])


def read(sample: DataFrame) -> DataFrame:
    """Of sample (text, label): a row for each different text and label with its features in `plus`, and one for each
    counterfactual pair with the features gained in `plus` and lost in `minus`."""
    bounded_batches(sample.sparkSession)

    def run(batches):
        for batch in batches:
            out = []
            for text, label in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                out.append((xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1, label, False, sorted(feature_set(text)), []))
                out += [(pair, label, True, gained, lost) for pair, gained, lost in changes(text, not label)]
            columns = zip(*out, strict=True) if out else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "label", "swap", "plus", "minus"])

    return sample.select("text", F.col("label").cast("int")).mapInArrow(run, "id long, label int, swap boolean, plus array<string>, minus array<string>")


def numbered(rows: DataFrame, names: list[str]) -> DataFrame:
    """id, label, plus, minus with features as packed numbers by `names` (FEATURES at most); others are left out."""
    shared = rows.sparkSession.sparkContext.broadcast({f: k for k, f in enumerate(names)})

    def run(batches):
        for batch in batches:
            plus, minus = ([_numbers(r, shared.value).tobytes() for r in batch.column(k).to_pylist()] for k in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(plus, pa.binary()), pa.array(minus, pa.binary())], ["id", "label", "plus", "minus"])

    return rows.select("id", "label", "plus", "minus").mapInArrow(run, "id long, label int, plus binary, minus binary")


def fit_on(docs: DataFrame, labels: DataFrame, seed: int = 6) -> Model:
    """Trains on at most TOXIC_ROWS and CLEAN_ROWS labelled documents, those with the smallest hash of doc_id.

    A document with several labels is toxic if one says so; a label that is null doesn't count. Documents of one text
    and label count once.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    have = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    taken = smallest(known.where("label = 0"), "doc_id", CLEAN_ROWS).unionByName(smallest(known.where("label = 1"), "doc_id", TOXIC_ROWS))
    sample = docs.select("doc_id", "text").join(F.broadcast(taken), "doc_id")  # both bounds together
    rows = checkpointed(read(sample.where("text is not null")))
    whole = rows.where("not swap").dropDuplicates(["id", "label"])
    totals = whole.agg(F.count("*").alias("n"), F.coalesce(F.avg("label"), F.lit(0.0)).alias("share")).first()
    if not 0 < totals.share < 1:
        return _alone(np.full(totals.n, totals.share))
    counted = whole.select("label", F.explode("plus").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).where(F.col("n") >= LEAST_DOCS)
    told = F.abs(F.col("toxic") - F.col("n") * totals.share) / F.sqrt(F.col("n") * (totals.share * (1 - totals.share)))
    names = [r.feature for r in counted.orderBy(told.desc(), "feature").limit(FEATURES).select("feature").collect()]
    found = numbered(whole, names).collect()
    found.sort(key=lambda r: (r.id, r.label))
    pairs = numbered(rows.where("swap").dropDuplicates(["id"]).orderBy("id").limit(SWAPS), names).where("length(plus) + length(minus) > 0").collect()
    of = lambda raw: np.frombuffer(raw, np.int32)
    y = np.array([r.label for r in found], float)
    shares = tuple(min(1.0, limit / have[k]) if have.get(k) else 1.0 for k, limit in ((0, CLEAN_ROWS), (1, TOXIC_ROWS)))
    return fitted(names, [of(r.plus) for r in found], y, [(of(r.plus), of(r.minus)) for r in sorted(pairs, key=lambda r: r.id)], shares, seed)


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of each row of docs (doc_id, text), by its whole text; a null text counts as empty.

    score is rounded to six places; predicted is 1 from DECISION on. Repeated rows are answered one by one; further
    columns are ignored; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights at most

    def run(batches):
        known: dict[str, tuple] = {}
        for batch in batches:
            m = shared.value
            score = np.round(m.probability(m.margins(texts(batch.column(1)), known)), 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= DECISION).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels are learned outside the held-out quarter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 4) != 2))
    return judge(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
