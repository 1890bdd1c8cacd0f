"""Document fingerprints by consistent weighted sampling.

A text's terms are its lower-cased words, each weighted by how often it occurs. For sample k and term v the sampler
draws r and c from Gamma(2, 1) and b from (0, 1), all by hashing (v, k), so they are the same wherever v occurs. With
weight w the term offers t = floor(ln w / r + b) at the price ln c - r (t - b + 1); the term of the least price gives the
sample (v, t). Two texts have equal samples with a probability of their generalised Jaccard similarity, the sum of the
smaller weights over the sum of the larger. A fingerprint is SAMPLES samples, three hexadecimal digits each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaguelens.llm.common import bounded_batches, partitions_for

SAMPLES = 128
#: Text bytes and rows of a bucket of neighbours, about, and buckets at most. A bucket is streamed, so it may be of any size.
BUCKET_BYTES, BUCKET_ROWS, BUCKETS = 8 << 20, 2000, 1 << 16
#: Rows drawn for each bucket to find its bounds.
DRAWN = 16
#: Documents and characters of a batch inside a task, about; different weighted terms for which prices are held at once.
BATCH, BATCH_CHARS, HELD_TERMS = 600, 2_000_000, 200_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draws(terms: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and b of terms (64-bit hashes) in samples k; both of one shape, or shapes that broadcast."""
    seed = _mixed(terms + (k.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    one, two = _mixed(seed + np.uint64(0x632BE59BD9B4E019)), _mixed(seed + np.uint64(0xC6A4A7935BD1E995))
    unit = lambda x: (x.astype(np.float32) + np.float32(0.5)) * np.float32(2**-24)  # noqa: E731  24 bits
    low = lambda x: unit(x & np.uint64(0xFFFFFF))
    high = lambda x: unit(x >> np.uint64(40))
    r = -np.log(low(one) * high(one))  # a sum of two exponentials is Gamma(2, 1)
    c = -np.log(low(two) * high(two))
    return r, np.log(c), low(seed)


def _offers(term: np.ndarray, weight: np.ndarray, first: int) -> np.ndarray:
    """Price of each weighted term in each sample, in the upper half of a word whose lower half is the term's number."""
    r, ln_c, b = draws(term[:, None], np.arange(SAMPLES, dtype=np.uint64))
    t = np.floor(np.log(weight[:, None]) / r + b)
    bits = (ln_c - r * (t - b + np.float32(1))).astype(np.float32).view(np.uint32)
    bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(0x80000000))  # now ordered as the prices are
    return bits.astype(np.uint64) << np.uint64(32) | np.arange(first, first + len(term), dtype=np.uint64)[:, None]


def signatures(batch: list[str]) -> np.ndarray:
    """SAMPLES samples of 12 bits for each text, never 0; all 0 for a text without words."""
    known: dict[str, int] = {}
    rows, counts, ends = [], [], [0]
    for text in batch:
        ids = [known.setdefault(w, len(known)) for w in text.lower().split()]
        unique, count = np.unique(np.array(ids, np.int64), return_counts=True)
        rows.append(unique)
        counts.append(count)
        ends.append(ends[-1] + len(unique))
    out = np.zeros((len(batch), SAMPLES), np.uint16)
    if not known:
        return out
    hashes = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in known], np.uint64)
    rank = np.empty(len(hashes), np.int64)
    order = np.argsort(hashes)
    rank[order] = np.arange(len(hashes))
    pairs, of = np.unique(rank[np.concatenate(rows)] << 32 | np.concatenate(counts), return_inverse=True)
    if len(pairs) > HELD_TERMS and len(batch) > 1:  # many different terms: fewer texts at a time
        half = len(batch) // 2
        return np.concatenate([signatures(batch[:half]), signatures(batch[half:])])
    term, weight = hashes[order][pairs >> 32], (pairs & 0xFFFFFFFF).astype(np.float32)
    parts = ((at, _offers(term[at : at + 2048], weight[at : at + 2048], at)) for at in range(0, len(pairs), 2048))
    if len(batch) == 1:  # one text, however long: only the least price so far is held
        least = np.full(SAMPLES, np.uint64(0xFFFFFFFFFFFFFFFF))
        for _, offers in parts:
            least = np.minimum(least, offers.min(axis=0))
        cheapest = [least]
    else:
        prices = np.empty((len(pairs), SAMPLES), np.uint64)
        for at, offers in parts:
            prices[at : at + 2048] = offers
        cheapest = (prices[of[ends[i] : ends[i + 1]]].min(axis=0) if ends[i] < ends[i + 1] else None for i in range(len(batch)))
    every = np.arange(SAMPLES, dtype=np.uint64)
    for i, least in enumerate(cheapest):
        if least is not None:
            won = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
            r, _, b = draws(term[won], every)
            t = np.floor(np.log(weight[won]) / r + b)
            out[i] = _mixed(term[won] ^ _mixed(t.astype(np.int64).astype(np.uint64) + every)) % np.uint64(4095) + np.uint64(1)
    return out


def as_text(signature: np.ndarray) -> str:
    return "".join([f"{x:03x}" for x in signature.tolist()])


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row."""
    return (a == b).mean(axis=1)


_KEY = ["_null", "_id", "_text", "_row"]


def _packed(columns: list) -> np.ndarray:
    """Keys of _KEY as bytes that sort as the keys do."""
    out = np.empty((len(columns[0]), 4), ">u8")
    for k, c in enumerate(columns):
        out[:, k] = np.asarray(c, np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return out.view("S32").ravel()


def neighbours(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with bucket and the columns of _KEY: buckets are ranges of the order in which documents follow
    one another (falling doc_id, none last; among equal ones by the text's hash; equal rows as they come, so that however
    many there are, they are dealt to several buckets). Each bucket has one row more, marked by `last`: the document that
    follows its last one, which after the last bucket is the very first one.

    Bounds come from a sample of keys, BUCKETS of them at most, which only decides how even the buckets are. The texts are
    shuffled once.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = own.select(
        "doc_id", "text", F.col("doc_id").isNull().cast("long").alias("_null"), F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).alias("_id"), F.xxhash64("text").alias("_text"), F.xxhash64(F.monotonically_increasing_id()).alias("_row")
    )
    n, size = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = min(BUCKETS, max(1, size // BUCKET_BYTES, n // BUCKET_ROWS))
    drawn = keyed.select(*_KEY).sample(min(1.0, 2 * DRAWN * buckets / max(1, n)), 5).toArrow() if buckets > 1 else None
    bounds = np.sort(_packed([drawn[c].to_numpy() for c in _KEY]))[:: 2 * DRAWN][1:] if buckets > 1 else np.zeros(0, "S32")
    shared = spark.sparkContext.broadcast(bounds)  # BUCKETS keys of 32 bytes at most, about

    @F.pandas_udf("int")
    def bucket_of(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, _packed([a, b, c, d]), "right").astype(np.int32))

    placed = keyed.withColumn("bucket", bucket_of(*_KEY)) if len(bounds) else keyed.withColumn("bucket", F.lit(0))
    tops = sorted((r.bucket, tuple(r.top)) for r in placed.groupBy("bucket").agg(F.min(F.struct(*_KEY[:3])).alias("top")).collect())
    placed = placed.withColumn("last", F.lit(False))
    if not tops:
        return placed
    # the first document of each bucket goes to the bucket before, too
    moved = spark.createDataFrame([(tops[k - 1][0], *top) for k, (_, top) in enumerate(tops)], "before int, _null long, _id long, _text long")
    heads = keyed.join(F.broadcast(moved), _KEY[:3]).groupBy("before").agg(F.min_by(F.struct("doc_id", "text", *_KEY), "_row").alias("r"))
    return placed.unionByName(heads.select("r.*", F.col("before").alias("bucket"), F.lit(True).alias("last")))


def compare(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of docs.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next document, in
    falling order of doc_id; by all of it, if it has fewer; after the last comes the first, so a single document is its
    own next one. A null text is empty. Texts without words have the fingerprint of zeros and are fully alike. Rows that
    share a doc_id, or have none, follow one another by the hash of their text. Further columns of docs are ignored; an
    empty table gives no rows.
    """
    bounded_batches(docs.sparkSession, 250)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def answers(ids: list, texts: list[str]) -> pa.RecordBatch:
        """Of all but the last text."""
        edited = [t[: len(t) - len(t) // 2] + texts[i + 1][: len(t) // 2] for i, t in enumerate(texts[:-1])]
        every = [t for pair in zip(texts, edited, strict=False) for t in pair] + texts[-1:]  # a text and its edited one share terms
        signs = signatures(every)
        own, new = signs[::2], signs[1::2]
        columns = (
            pa.array(ids[:-1], pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
            pa.array([as_text(s) for s in own[:-1]], pa.string()),
            pa.array([as_text(s) for s in new], pa.string()),
            pa.array(likeness(own[:-1], new), pa.float64()),
            pa.array(likeness(own[:-1], own[1:]), pa.float64()),
        )
        return pa.RecordBatch.from_arrays(list(columns), [c.split()[0] for c in schema.split(", ")])

    def run(batches):
        ids, texts, chars, now = [], [], 0, None
        for batch in batches:
            for bucket, last, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if bucket != now:  # the one before has ended with its `last` row
                    ids, texts, chars, now = [], [], 0, bucket
                ids.append(doc_id)
                texts.append(text)
                chars += len(text)
                if len(texts) > 1 and (last or len(texts) > BATCH or chars > BATCH_CHARS):
                    yield answers(ids, texts)
                    ids, texts, chars = ids[-1:], texts[-1:], len(texts[-1])

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = neighbours(docs).repartition(partitions_for(docs.sparkSession, size, 16e6), "bucket").sortWithinPartitions("bucket", "last", *_KEY)
    return ordered.select("bucket", "last", "doc_id", "text").mapInArrow(run, schema)


def op5_weighted_sampling(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return compare(spark.read.parquet(f"{sf_dir}/documents.parquet"))
