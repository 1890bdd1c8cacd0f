"""SimHash near-duplicates, found by fuzzy hashing with the binary Golay code.

The perfect (23, 12) Golay code puts each 23-bit word within three bits of exactly one of 4096 codewords. A fingerprint
of 64 bits is cut into two segments of 23 bits and one of 18, filled up with zeros. A segment's own index is that of its
codeword; its near indices are those of its own word and of all words one bit away (1 to 6 of them in practice). Two
words one bit apart have each other's own index among their near ones; two words two bits apart share a near index.

Two fingerprints that differ in at most four bits differ in three segments by (e1 >= e2 >= e3), e1 + e2 + e3 <= 4, so
either a segment is equal (e3 = 0), or two segments differ by one bit each (e2 = e3 = 1). The keys of a fingerprint are

* the first segment itself, and the second one itself;
* the third one with each near index of the first, and with each of the second: if it is equal, one of the other two
  differs by two bits at most;
* for each two segments i < j: (own i, each near j) and (each near i, own j). Where both differ by one bit, the first
  kind of one fingerprint and the second kind of the other have (own i of the one, own j of the other) in common.

That is about 45 keys for a fingerprint. Fingerprints that share a key are compared, and links go to components.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from leaguelens.llm.common import bounded_batches, checkpointed, join_counted, partitions_for, stretches
from leaguelens.llm.components import roots

SHINGLE = 4
SEED = 42
RADIUS = 4
SEGMENTS = ((0, 23), (23, 23), (46, 18))  # first bit, bits
#: Generator polynomial of the Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def _syndromes() -> np.ndarray:
    """Remainder of each power of x below 23, modulo the generator."""
    out, r = [], 1
    for _ in range(23):
        out.append(r)
        r <<= 1
        if r >> 11:
            r ^= GENERATOR
    return np.array(out, np.int32)


def _linear(bits: np.ndarray) -> np.ndarray:
    """Sums (exclusive or) of every subset of `bits`, by the subset's number."""
    out = np.zeros(1, np.int32)
    for b in bits:
        out = np.concatenate([out, out ^ b])
    return out


class Golay:
    """Decoding to the index (0 to 4095) of the only codeword within three bits."""

    def __init__(self) -> None:
        each = _syndromes()
        self.low, self.high = _linear(each[:12]), _linear(each[12:])
        self.error = np.zeros(2048, np.int32)
        for n in range(4):
            for flipped in itertools.combinations(range(23), n):
                self.error[np.bitwise_xor.reduce(each[list(flipped)]) if n else 0] = sum(1 << f for f in flipped)

    def index(self, words: np.ndarray) -> np.ndarray:
        words = words.astype(np.int32)
        return (words ^ self.error[self.low[words & 4095] ^ self.high[words >> 12]]) >> 11

    def near(self, words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, index): the different indices of each word and of the words one flip of `bits` low bits away."""
        flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.int32)
        every = np.sort(self.index(words.astype(np.int32)[:, None] ^ flips), axis=1)
        first = np.ones(every.shape, bool)
        first[:, 1:] = every[:, 1:] != every[:, :-1]
        return np.nonzero(first)[0], every[first]


def fingerprint(text: str | None) -> int:
    """The text's fingerprint: a bit is set if it is in over half of the shingles' hashes; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and ASCII white space
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    last = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    first = [0, *(ends[: len(last) - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def keys_of(fps: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of every fingerprint; a key holds its kind in the bits from 40 on."""
    segment = [((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    own = [code.index(s).astype(np.int64) for s in segment]
    near = [code.near(s, n) for s, (_, n) in zip(segment, SEGMENTS, strict=True)]
    every = np.arange(len(fps))
    rows, keys = [every, every], [segment[0], segment[1] | 1 << 40]
    for i in (0, 1):
        row, index = near[i]
        rows.append(row)
        keys.append(segment[2][row] << 12 | index | (2 + i) << 40)
    for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        row, index = near[j]
        one = (row, own[i][row] << 12 | index)
        row, index = near[i]
        other = (row, index.astype(np.int64) << 12 | own[j][row])
        both = np.unique(np.stack([np.concatenate([one[0], other[0]]), np.concatenate([one[1], other[1]])]), axis=1)
        rows.append(both[0])
        keys.append(both[1] | (4 + k) << 40)
    return np.concatenate(rows), np.concatenate(keys)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y)


def links(keys: np.ndarray, fps: np.ndarray, small: int = 48) -> np.ndarray:
    """Pairs (n x 2) of fingerprints within RADIUS that connect all that share a key and are connected by such pairs.

    Small groups are compared pair by pair. A larger one is cut into stars first: each leader takes what is within
    RADIUS of it; members of two stars are compared only where their leaders are near enough for a link, and until the
    stars are joined. So a group of near copies gives about as many links as it has members.
    """
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], fps[order]
    starts, ends = stretches(keys)
    sizes = ends - starts
    out = []
    left = np.repeat(sizes, sizes) <= small
    at = np.flatnonzero(left)
    for d in range(1, small):
        at = at[at + d < len(keys)]
        at = at[keys[at] == keys[at + d]]
        if not len(at):
            break
        hit = at[_apart(fps[at], fps[at + d]) <= RADIUS]
        out.append(np.stack([fps[hit], fps[hit + d]], axis=1))
    for s, n in zip(starts[sizes > small], sizes[sizes > small], strict=True):
        out.append(_stars(np.unique(fps[s : s + n])))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.uint64)


def _stars(fps: np.ndarray) -> np.ndarray:
    out, rest, stars = [], fps, []
    while len(rest):
        near = _apart(rest, rest[0]) <= RADIUS
        stars.append(rest[near])
        out.append(np.stack([np.full(int(near.sum()) - 1, rest[0]), rest[near][1:]], axis=1))
        rest = rest[~near]
    leaders, parent = np.array([s[0] for s in stars]), list(range(len(stars)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, star in enumerate(stars):
        reach = int(_apart(star, leaders[i]).max()) + 2 * RADIUS
        for j in np.flatnonzero(_apart(leaders[i + 1 :], leaders[i]) <= reach) + i + 1:
            if top(i) == top(int(j)):
                continue
            for at in range(0, len(star), 512):
                hit = np.argwhere(_apart(star[at : at + 512, None], stars[j][None, :]) <= RADIUS)
                if len(hit):
                    out.append(np.array([[star[at + hit[0][0]], stars[j][hit[0][1]]]], np.uint64))
                    parent[top(int(j))] = top(i)
                    break
    return np.concatenate(out) if out else np.zeros((0, 2), np.uint64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long) of each row of docs (doc_id, text); a null text has no words."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


#: Order of a fingerprint all of whose rows have no doc_id; it may be a doc_id too, so it alone tells nothing.
_NO_ID = (1 << 63) - 1


def near_links(fps: DataFrame, buckets: int) -> DataFrame:
    """Links (a, b) between different fingerprints that suffice for their components; nodes are structs (first, fp).

    fps (fp, first) without repeats. Keys travel as arrays, a row for each bucket of keys and 50,000 fingerprints, and
    meet in groups of one bucket.
    """

    def emit(batches):
        code, held = Golay(), []

        def flush():
            own = np.concatenate(held)
            row, key = keys_of(own[:, 0].view(np.uint64), code)
            bucket = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            row, key, bucket = row[order], key[order], bucket[order]
            cut, end = stretches(bucket)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array([key[a:b].tobytes() for a, b in zip(cut, end, strict=True)], pa.binary()), pa.array([own[row[a:b]].tobytes() for a, b in zip(cut, end, strict=True)], pa.binary())], ["bucket", "keys", "nodes"])

        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)], axis=1))
            if sum(map(len, held)) >= 50_000:
                yield flush()
        if sum(map(len, held)):
            yield flush()

    def meet(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(table["keys"].to_pylist()), np.int64)
        nodes = np.frombuffer(b"".join(table["nodes"].to_pylist()), np.int64).reshape(-1, 2)
        fp = np.ascontiguousarray(nodes[:, 0]).view(np.uint64)
        found = links(keys, fp)
        unique, at = np.unique(fp, return_index=True)
        first = nodes[at, 1][np.searchsorted(unique, found)]
        ends = [pa.StructArray.from_arrays([pa.array(first[:, k]), pa.array(np.ascontiguousarray(found[:, k]).view(np.int64))], ["first", "fp"]) for k in (0, 1)]
        return pa.table({"a": ends[0], "b": ends[1]})

    node = "struct<first: long, fp: long>"
    return fps.select("fp", "first").mapInArrow(emit, "bucket long, keys binary, nodes binary").groupBy("bucket").applyInArrow(meet, f"a {node}, b {node}")


def named(own: DataFrame) -> DataFrame:
    """fp, root (struct first, fp: the node of the component's smallest doc_id), component_id (root.first, null if no row of
    the component has a doc_id), n of each fingerprint of own (doc_id, fp).

    Nodes are ordered by their smallest doc_id, so that the root of a component tells its name without a look-up.
    """
    spark = own.sparkSession
    single = own.groupBy("fp").agg(F.coalesce(F.min("doc_id"), F.lit(_NO_ID)).alias("first"), F.count("*").alias("n"))
    size = own.count()
    parts = partitions_for(spark, size * 45 * 24, 32e6)
    spread = single.select("fp", "first").repartition(max(1, min(parts, size // 20_000 + 1)))
    top = roots(near_links(spread, max(64, 4 * parts))).select(F.col("node.fp").alias("fp"), "root")
    out = single.join(top, "fp", "left").select("fp", F.coalesce("root", F.struct("first", "fp")).alias("root"), "n")
    last = own.where(F.col("doc_id") == _NO_ID).select("fp")
    if last.isEmpty():
        return out.withColumn("component_id", F.expr(f"nullif(root.first, {_NO_ID})"))
    # The largest doc_id stands in the table: components whose smallest one it is are told from those without any.
    out = checkpointed(out)
    real = out.join(last.distinct(), "fp", "left_semi").where(F.col("root.first") == _NO_ID).groupBy("root").agg(F.min("fp").alias("own"))
    out = out.join(real, "root", "left")
    root = F.when(F.col("own").isNull(), F.col("root")).otherwise(F.struct(F.col("root.first"), F.col("own").alias("fp")))
    name = F.when(F.col("own").isNull(), F.expr(f"nullif(root.first, {_NO_ID})")).otherwise(F.lit(_NO_ID))
    return out.select("fp", root.alias("root"), "n", name.alias("component_id"))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of each row of docs (doc_id, text).

    component_id is the smallest doc_id reachable over fingerprints that differ in RADIUS bits at most. Repeated rows
    and equal texts share a component. A null or blank text has fingerprint zero and is linked like any other; a null
    doc_id is never a component_id unless its component has no other. An empty table gives no rows.
    """
    own = checkpointed(fingerprints(docs))
    size = own.count()
    by_fp = named(own).select("fp", "component_id", "n")
    out = join_counted(own, by_fp, "fp", "n", size)  # copies share a fingerprint
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash_golay(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_one(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the row with the smallest doc_id; same columns.

    Rows that share a doc_id are told apart by their fingerprints: of those that have the component's smallest doc_id the
    one with the fingerprint that comes first stays, of several such the one with the least hash of its columns. A row
    without doc_id can't be told from others, so it stays.
    """
    own = checkpointed(fingerprints(docs))
    first = named(own).where("component_id is not null").select(F.col("component_id").alias("id"), F.col("root.fp").alias("own_fp")).distinct()
    many = checkpointed(own.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("id")))
    first = checkpointed(first)
    once = first.join(many, "id", "left_anti")
    kept = docs.join(once, docs["doc_id"] == once["id"], "left_semi").unionByName(docs.where("doc_id is null"))
    if many.isEmpty():
        return kept
    # Rows of repeated ids: their fingerprints are taken again and compared with that of the component.
    some = docs.join(many, docs["doc_id"] == many["id"], "left_semi")
    packed = some.select(F.col("doc_id").alias("doc"), "text", F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    at = packed.schema.fieldNames().index("text")

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), batch.column(2)], ["doc", "fp", "row"])

    tagged = packed.mapInArrow(run, f"doc long, fp long, row {packed.schema['row'].dataType.simpleString()}")
    plain = [f"row.`{f.name}`" for f in docs.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    one = tagged.groupBy("doc", "fp").agg(F.min_by("row", F.xxhash64(*plain)).alias("row"))
    one = one.join(first, (one["doc"] == first["id"]) & (one["fp"] == first["own_fp"]), "left_semi")
    return kept.unionByName(one.select("row.*"))
