"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is lower-cased, everything but letters becomes a space, and each of its byte 2-, 3- and 4-grams is hashed to a
row of an embedding table. The mean of those rows goes through one linear layer and a softmax. Both are trained by
stochastic gradient descent in numpy on a bounded sample of each language's labelled texts, cut into pieces of several
lengths so that short texts are learned as well. A temperature and a rejection threshold are then set on pieces that were
kept aside, with each language weighted by how many labelled documents it has.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaguelens.llm.common import bounded_batches, bounded_sample, fold, text_bytes

#: Labelled documents of each language at most in a training sample.
TRAIN_ROWS = 300
#: Pieces of each document at most that are learned from, drawn from the whole text.
PIECES = 40
#: Different labels at most. The model and the sample grow with them, so a column of other things is an error.
LANGUAGES = 500
#: The label of a text without any letter.
UNDETERMINED = "und"
ORDERS = (2, 3, 4)
BINS = 1 << 14
DIM = 16
#: Share of kept-aside texts in their own language that the rejection threshold may reject at most.
LOST = 0.0005

_FOLDED = np.full(256, 0x20, np.uint8)
_FOLDED[0x80:] = np.arange(0x80, 0x100)
_FOLDED[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLDED[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def folded(data: np.ndarray) -> np.ndarray:
    """Lower-cased bytes with a space for each ASCII byte that isn't a letter; Latin-1 capitals are lowered too."""
    out = _FOLDED[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 0x20
    return out


def grams(data: np.ndarray) -> np.ndarray:
    """Bins of each n-gram, one row for each order; the gram starts at its column. The last columns wrap and aren't used."""
    wide = data.astype(np.uint32)
    padded = np.concatenate([wide, np.full(max(ORDERS), 0x20, np.uint32)])
    rows, gram, n = [], np.zeros(len(wide), np.uint32), 0
    for order in ORDERS:
        while n < order:
            gram = gram * np.uint32(0x01000193) + padded[n : n + len(wide)] + np.uint32(1)
            n += 1
        mixed = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        rows.append((mixed >> np.uint32(18)).astype(np.int32) & (BINS - 1))
    return np.stack(rows) if len(wide) else np.zeros((len(ORDERS), 0), np.int32)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # orders x bins x langs: each gram's share of the logits
    bias: np.ndarray
    temperature: float
    threshold: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities of each language for each text of a batch."""
        n = len(offsets) - 1
        low, total = folded(data), np.zeros((n, len(self.langs)))
        if len(data):
            steps = np.cumsum(np.diff(offsets))
            cuts = [0, *(int(np.searchsorted(steps, k, "left")) + 1 for k in range(1 << 20, int(steps[-1]), 1 << 20)), n]
            for first, last in zip(cuts, cuts[1:], strict=False):  # about a MB of whole texts at a time
                if first < last and offsets[last] > offsets[first]:
                    total[first:last] = self._sums(low[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        length = np.maximum(np.diff(offsets), 1)[:, None] * len(ORDERS)
        logits = (total / length + self.bias) / self.temperature
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(axis=1, keepdims=True)

    def _sums(self, low: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        filled = np.flatnonzero(np.diff(offsets))
        bins, out = grams(low), np.zeros((len(offsets) - 1, len(self.langs)))
        for k in range(len(self.langs)):
            each = sum(self.table[o, :, k][bins[o]] for o in range(len(ORDERS)))
            out[filled, k] = np.add.reduceat(each, offsets[filled])
        return out


def pieces_of(text: str, rng: np.random.Generator) -> list[bytes]:
    """A labelled text in pieces of 40 to 1500 characters; together they hold all of it."""
    out, at = [], 0
    while at < len(text):
        n = int(40 * (1500 / 40) ** rng.random())
        out.append(text[at : at + n].encode())
        at += n
    return out


def train(rows: list[tuple[str, str]], epochs: int = 3, rate: float = 4.0, seed: int = 8, counts: dict[str, int] | None = None) -> Model:
    """Fits the model to (text, lang) pairs. Without any pair the model knows no language.

    counts: how many documents each language has, if rows are a sample of them; else those in rows count.
    """
    rows = sorted({(t, g) for t, g in rows if t and g})
    langs, rng = sorted({g for _, g in rows}), np.random.default_rng(seed)
    if not langs:
        return Model([], np.zeros((len(ORDERS), BINS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    fit, aside = [], []
    for i in rng.permutation(len(rows)):
        text, lang = rows[i]
        pieces = pieces_of(text, rng)
        drawn = pieces if len(pieces) <= PIECES else [pieces[k] for k in rng.permutation(len(pieces))[:PIECES]]
        (aside if i % 5 == 0 and len(rows) >= 20 else fit).extend((p, langs.index(lang)) for p in drawn)
    examples = []
    for piece, y in fit:
        raw = np.frombuffer(piece, np.uint8)
        bins = (grams(folded(raw)) + (np.arange(len(ORDERS)) * BINS)[:, None]).ravel()
        unique, count = np.unique(bins, return_counts=True)
        examples.append((unique, (count / len(bins)).astype(np.float32), y))
    emb = rng.normal(0, 0.1, (len(ORDERS) * BINS, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (DIM, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    steps, done = max(1, epochs * len(examples)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            bins, share, y = examples[i]
            lr = np.float32(rate * (1 - done / steps) + 0.01)
            rows_e = emb[bins]
            hidden = share @ rows_e
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= np.float32(0.1) * lr * np.outer(hidden, p)
            bias -= np.float32(0.02) * lr * p
            emb[bins] = rows_e - lr * np.outer(share, back) * np.float32(len(bins) ** 0.5)
            done += 1
    model = Model(langs, (emb @ out).reshape(len(ORDERS), BINS, len(langs)).astype(np.float32), bias.astype(float), 1.0, 0.0)
    taken = Counter(g for _, g in rows)
    return calibrate(model, aside or fit, np.array([(counts or taken).get(g, taken[g]) / taken[g] for g in langs]))


def calibrate(model: Model, aside: list[tuple[bytes, int]], weights: np.ndarray) -> Model:
    """Sets the temperature of least log loss, then the threshold that rejects at most LOST of the right answers.

    weights: documents of each language for each one in the sample; they weight the loss, as the languages' shares in the
    sample are not those of the documents. The fit before counts sampled documents alike, so that a rare language is learned.
    """
    data = np.frombuffer(b"".join(p for p, _ in aside), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p, _ in aside])]).astype(np.int64)
    truth = np.array([y for _, y in aside])
    each = weights[truth] / weights[truth].sum()
    tried = []  # from 1 on: a sharper softmax of well separated languages would score strange texts as 1 too
    for t in np.geomspace(1, 10, 21):
        model.temperature = float(t)
        tried.append((float(-np.log(model.scores(data, offsets)[np.arange(len(truth)), truth] + 1e-12) @ each), float(t)))
    model.temperature = min(tried)[1]
    p = model.scores(data, offsets)
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == truth])
    model.threshold = float(right[int(len(right) * LOST)]) if len(right) else 0.0
    return model


def sampled(known: DataFrame, rows: int) -> tuple[DataFrame, dict[str, int]]:
    """At most `rows` documents of each language, those with the smallest hash of doc_id, and the rows of each language.

    The counts tell under which hash about twice as many documents of a language lie, so one pass finds the keys of all
    languages; one that has too few there (its documents repeat) is sampled by itself. ValueError if there are over LANGUAGES.
    """
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"lang has over {LANGUAGES} different values")
    if not counts:
        return known.limit(0), counts
    below = {g: min((1 << 63) - 1, -(1 << 63) + (2 * rows + 100 << 64) // n) for g, n in counts.items()}
    spark = known.sparkSession  # its small tables are made from Arrow: from rows, Python workers of the executors would make them
    limits = spark.createDataFrame(pa.table({"lang": pa.array(sorted(below), pa.string()), "_below": pa.array([below[g] for g in sorted(below)], pa.int64())}))
    keys = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("_hash")).join(F.broadcast(limits), "lang").where("_hash <= _below")
    by_lang: dict[str, list] = {g: [] for g in counts}
    for r in keys.select("lang", "_hash", "doc_id").distinct().collect():
        by_lang[r.lang].append((r["_hash"], r.doc_id))
    chosen = []
    for g, found in sorted(by_lang.items()):
        if len(found) < rows and below[g] < (1 << 63) - 1:
            own = known.where(F.col("lang") == g)
            chosen += [(k, g) for k in {r.doc_id for r in bounded_sample(own, "doc_id", rows).select("doc_id").collect()}]
        else:
            chosen += [(k, g) for _, k in sorted(found)[:rows]]
    kind = T.StructType([known.schema["doc_id"], known.schema["lang"]])
    keys = pa.table({"doc_id": pa.array([k for k, _ in chosen]), "lang": pa.array([g for _, g in chosen], pa.string())})
    return known.join(F.broadcast(spark.createDataFrame(keys, kind)), ["doc_id", "lang"], "left_semi"), counts


def fit_on(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Trains on at most `rows` documents of each language of `labelled` (doc_id, text, lang)."""
    known = labelled.where("doc_id is not null and lang <> '' and text <> ''").select("doc_id", "text", "lang")
    sample, counts = sampled(known, rows)
    return train([(r.text, r.lang) for r in sample.collect()], counts=counts)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected of each row of docs (doc_id, text).

    The whole text counts. A null text, or one without a letter, has lang_pred 'und', score 0 and is rejected; so has
    every text if the model knows no language. A text whose score is under the calibrated threshold keeps its best
    language in lang_pred and is rejected. Repeated rows are answered one by one; other columns of docs are ignored.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: BINS x ORDERS x languages

    def run(batches):
        m = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            letters = np.array(batch.column(2).to_pylist(), bool)
            if m.langs:
                p = m.scores(data, offsets)
                best = p.argmax(axis=1)
                score = np.where(letters, np.round(p[np.arange(len(p)), best], 6), 0.0) if len(p) else np.zeros(0)
                names = [m.langs[b] if ok else UNDETERMINED for b, ok in zip(best, letters, strict=True)]
            else:
                score, names = np.zeros(len(letters)), [UNDETERMINED] * len(letters)
            reject = ~letters | (score < m.threshold) | (not m.langs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(reject, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    asked = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return asked.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document; learned from documents outside the held-out third."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_on(docs.where(fold("doc_id", 3) != 1))
    return identify(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: docs without those that the model rejects; columns of documents.

    It learns from the same labelled documents as op8. A row without a doc_id is scored as any other.
    """
    model = fit_on(docs.where(fold("doc_id", 3) != 1))
    return keep(docs, model)


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model doesn't reject, in the same columns; scored in one pass, without a join."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at, flag = names.index("text"), "_has_letters"
    while flag in names:
        flag += "_"

    def run(batches):
        m = shared.value
        for batch in batches:
            p = m.scores(*text_bytes(batch.column(at))) if m.langs else np.zeros((batch.num_rows, 1))
            ok = np.array(batch.column(len(names)).to_pylist(), bool) & (p.max(axis=1) >= m.threshold) & bool(m.langs)
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names).filter(pa.array(ok, pa.bool_()))

    return docs.withColumn(flag, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, docs.schema)
