"""Removal of repeated passages by a sparse suffix array, sorted by a merge sort that is aware of common prefixes.

A byte goes if a string of WINDOW bytes that covers it also starts earlier in the corpus. Sorting the suffix at every
byte would shuffle many times the input, so suffixes start at anchors only: the anchor of a window is the place in it of
the least hash of CORE bytes (the first such place). Equal windows have their anchors at the same offset, so each class
of equal windows is found among the suffixes of equal anchors. About one byte in 35 is an anchor.

The steps, each a grouping of whole blocks of documents or of buckets of anchors:

1. Blocks of documents send the hashes of their anchors' cores; a bucket of hashes answers with one bit for each, telling
   whether another block has it. An anchor whose core is nowhere else can't start a repeated suffix and drops out.
2. Each block sorts what is left as suffixes of WINDOW bytes, keeps one of those with equal surroundings, and sends a
   sorted run to each bucket, front-coded: the length of the prefix shared with the suffix before, and the rest.
3. A bucket merges its runs with a loser tree. Each stream knows how long a prefix it shares with the suffix put out
   last; only where two such lengths are equal are bytes compared, and only from there on. The merged order and its
   prefix lengths give classes of equal right sides for every length; sorted left sides give those of the left. Of the
   windows whose both sides are equal all but the earliest are repeated.
4. Blocks get their repeated spans, add the suffixes that they had kept back as equal, and cut the bytes out.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaguelens.llm.common import bounded_batches, partitions_for, stretches, sums_before, text_bytes

WINDOW = 100
CORE = 32
LEFT = WINDOW - CORE
#: Text bytes of a block of documents, and of the documents whose suffixes meet in a bucket, about.
BLOCK_BYTES, BUCKET_BYTES, LEAST_PARTS = 4 << 20, 8 << 20, 16
_CHUNK, _ROWS = 1 << 17, 1 << 12
_NO_ID = -(1 << 63)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(27))


def core_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the CORE bytes from each place on, built from hashes of half the length."""
    h, length, factor = data.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while length < CORE:
        h = h[:-length] * np.uint64(factor) + h[length:]
        length, factor = 2 * length, factor * factor % (1 << 64)
    return _mixed(h)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last): each anchor and the first and last start of the windows of one document that have it."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    low, before, turns, places = np.uint64(_CHUNK * 2 - 1), -1, [], []  # where the anchor changes, and to what place
    for at in range(0, n, _CHUNK):
        end = min(n, at + _CHUNK)
        h = core_hashes(data[at : end + WINDOW - 1])
        least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        wide = 1
        while 2 * wide <= LEFT + 1:
            least = np.minimum(least[:-wide], least[wide:])
            wide *= 2
        if wide < LEFT + 1:
            least = np.minimum(least[: -(LEFT + 1 - wide)], least[LEFT + 1 - wide :])
        place = (least & low).astype(np.int64) + at
        new = np.flatnonzero(np.diff(place, prepend=before))
        turns.append(new + at)
        places.append(place[new])
        before = place[-1]
    turns, places = np.concatenate(turns), np.concatenate(places)
    ends = offsets[1:] - WINDOW + 1
    first = np.unique(np.concatenate([turns, offsets[:-1], ends]))
    first = first[(first >= 0) & (first < n)]
    last = np.append(first[1:], n) - 1
    doc = np.searchsorted(offsets, first, "right") - 1
    inside = first + WINDOW <= offsets[doc + 1]
    return places[np.searchsorted(turns, first[inside], "right") - 1], first[inside], last[inside]


class Block:
    """The documents of a block in order of doc_id and start, and their anchors; equal on every call for equal rows.

    `start` names the column of a document's place among the rows of its doc_id.
    """

    def __init__(self, table: pa.Table, buckets: int, start: str) -> None:
        order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), (start, "ascending")], null_placement="at_start")
        self.table = table.take(order)
        self.data, self.offsets = text_bytes(self.table["text"])
        ids = self.table["doc_id"]
        self.ids = np.array([_NO_ID if x is None else x for x in ids.to_pylist()], np.int64)
        self.start = self.table[start].to_numpy().astype(np.int64)
        #: what is taken from a place in the block to count it from the start of its doc_id
        self.base = self.offsets[:-1] - self.start
        self.place, self.first, self.last = anchors(self.data, self.offsets)
        self.hash = _mixed(self._cores())
        self.buckets = buckets
        self.unique, self.of, self.count = np.unique(self.hash, return_inverse=True, return_counts=True)

    def _cores(self) -> np.ndarray:
        out, factor = np.zeros(len(self.place), np.uint64), np.uint64(0xD6E8FEB86659FD93)
        for k in range(CORE):
            out = out * factor + self.data[self.place + k] + np.uint64(1)
        return out

    def bucket_of(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)

    def slices(self) -> list[tuple[int, int, int]]:
        """(bucket, from, to) over the sorted unique hashes."""
        bucket = self.bucket_of(self.unique)
        first, end = stretches(bucket)
        return list(zip(bucket[first].tolist(), first.tolist(), end.tolist(), strict=True))

    def repeated(self, answers: dict[int, bytes]) -> np.ndarray:
        """The anchors whose core is in this block twice, or in another block by the answers of the buckets."""
        known = self.count > 1
        for bucket, a, b in self.slices():
            if bucket in answers:
                known[a:b] |= np.unpackbits(np.frombuffer(answers[bucket], np.uint8), count=b - a).astype(bool)
        return np.flatnonzero(known[self.of])

    def document_of(self, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The document that holds each place, which is counted from the start of its doc_id."""
        first, end = (np.searchsorted(self.ids, ids, side) for side in ("left", "right"))
        return np.clip(np.searchsorted(self.start, places, "right") - 1, first, end - 1)

    def suffixes(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(records, order, leads): a row of bytes for each chosen anchor (bucket, right side, its length, left side
        from the anchor back, its length), their sorted order, and which of that order are the first of equal ones."""
        p = self.place[chosen]
        doc = np.searchsorted(self.offsets, p, "right") - 1
        right, left = np.minimum(WINDOW, self.offsets[doc + 1] - p), np.minimum(LEFT, p - self.offsets[doc])
        rec = np.zeros((len(p), 4 + WINDOW + 1 + LEFT + 1), np.uint8)
        rec[:, :4] = self.bucket_of(self.hash[chosen]).astype(">u4").view(np.uint8).reshape(-1, 4)
        reach, back = np.arange(WINDOW), np.arange(LEFT)
        for at in range(0, len(p), _ROWS):  # the places of all bytes at once would take many times the block
            part = slice(at, at + _ROWS)
            rec[part, 4 : 4 + WINDOW] = np.where(reach < right[part, None], self.data[np.minimum(p[part, None] + reach, len(self.data) - 1)], 0)
            rec[part, 5 + WINDOW : -1] = np.where(back < left[part, None], self.data[np.maximum(p[part, None] - 1 - back, 0)], 0)
        rec[:, 4 + WINDOW], rec[:, -1] = right, left
        order = np.argsort(rec.view(f"S{rec.shape[1]}").ravel(), kind="stable") if len(p) else np.zeros(0, np.int64)
        rec = rec[order]
        leads = np.ones(len(p), bool)
        leads[1:] = (rec[1:] != rec[:-1]).any(axis=1)
        return rec, order, leads


def _front_coded(rights: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Shared prefix lengths and the remaining bytes of sorted suffixes."""
    shared = np.zeros(len(rights), np.uint8)
    if len(rights) > 1:
        differ = rights[1:] != rights[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), WINDOW)
        shared[1:] = np.minimum(first, np.minimum(lengths[1:], lengths[:-1]))
    at = np.arange(WINDOW)
    return shared, rights[(at >= shared[:, None]) & (at < lengths[:, None])].tobytes()


def pack_run(rec: np.ndarray, ids: np.ndarray, places: np.ndarray, least: np.ndarray, most: np.ndarray) -> bytes:
    """A sorted run as bytes. least, most: the offsets of the anchor in the windows that have it."""
    right, left = rec[:, 4 + WINDOW], rec[:, -1]
    shared, tails = _front_coded(rec[:, 4 : 4 + WINDOW], right)
    lefts = rec[:, 5 + WINDOW : -1][np.arange(LEFT) < left[:, None]].tobytes()
    parts = [shared.tobytes(), right.tobytes(), left.tobytes(), least.astype(np.uint8).tobytes(), most.astype(np.uint8).tobytes(), ids.astype("<i8").tobytes(), places.astype("<i8").tobytes(), tails, lefts]
    return struct.pack("<II", len(rec), len(tails)) + zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


class Run:
    def __init__(self, packed: bytes) -> None:
        n, tail = struct.unpack("<II", packed[:8])
        raw = zstandard.ZstdDecompressor().decompress(packed[8:])
        u8 = np.frombuffer(raw, np.uint8)
        self.shared, right, self.left, self.least, self.most = (u8[k * n : (k + 1) * n] for k in range(5))
        self.ids, self.places = np.frombuffer(raw, "<i8", n, 5 * n), np.frombuffer(raw, "<i8", n, 13 * n)
        at, before, self.strings = 21 * n, b"", []
        for shared, length in zip(self.shared.tolist(), right.tolist(), strict=True):
            before = before[:shared] + raw[at : at + length - shared]
            at += length - shared
            self.strings.append(before)
        self.lefts = np.zeros((n, LEFT), np.uint8)
        self.lefts[np.arange(LEFT) < self.left[:, None]] = u8[21 * n + tail :]
        self.shared = self.shared.tolist()


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """(run, index, shared) of every string in sorted order; shared is the prefix length in common with the one before.

    runs: sorted strings, and for each the prefix length in common with the one before it in its run. The tree keeps at
    each node the stream that lost there; `known` holds what a stream's head shares with the string put out last (for a
    loser, with the winner over it, which is the same once that has been put out).
    """
    width = 1
    while width < len(runs):
        width *= 2
    heads: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (width - len(runs))
    known, at, losers = [0] * width, [0] * width, [0] * width
    sizes = [len(r[0]) for r in runs]

    def loses(x: int, y: int) -> bool:
        """Whether the head of x comes after that of y; sets what the loser shares with the winner."""
        a, b = heads[x], heads[y]
        if a is None or b is None:
            return a is None
        k = known[x]
        if k != known[y]:
            return k < known[y]
        one, two = a[k:], b[k:]
        n = min(len(one), len(two))
        differ = int.from_bytes(one[:n], "big") ^ int.from_bytes(two[:n], "big")
        same = n - (differ.bit_length() + 7) // 8 if differ else n
        behind = one[same] > two[same] if same < n else len(one) > len(two)
        known[x if behind else y] = k + same
        return behind

    def play(node: int) -> int:
        if node >= width:
            return node - width
        x, y = play(2 * node), play(2 * node + 1)
        if loses(x, y):
            x, y = y, x
        losers[node] = y
        return x

    winner, out_run, out_index, out_shared = play(1) if width > 1 else 0, [], [], []
    for _ in range(sum(sizes)):
        i = at[winner]
        out_run.append(winner)
        out_index.append(i)
        out_shared.append(known[winner])
        i += 1
        at[winner] = i
        if i < sizes[winner]:
            heads[winner], known[winner] = runs[winner][0][i], runs[winner][1][i]
        else:
            heads[winner] = None
        node = (winner + width) >> 1
        while node:
            other = losers[node]
            if heads[other] is not None and (heads[winner] is None or known[winner] <= known[other]) and loses(winner, other):
                losers[node], winner = winner, other
            node >>= 1
    return out_run, out_index, out_shared


def repeated_spans(runs: list[Run]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(run, doc_id, from, to) of the repeated windows, joined where they follow one another at one anchor."""
    which, index, shared = (np.array(x, np.int64) for x in merge([(r.strings, r.shared) for r in runs]))
    if not len(which):
        return which, which, which, which
    start = np.concatenate([[0], np.cumsum([len(r.ids) for r in runs])])[which] + index
    ids, places = np.concatenate([r.ids for r in runs])[start], np.concatenate([r.places for r in runs])[start]
    least, most = np.concatenate([r.least for r in runs])[start], np.concatenate([r.most for r in runs])[start]
    lefts = np.zeros((len(start), LEFT + 4), np.uint8)
    lefts[:, :LEFT] = np.concatenate([r.lefts for r in runs])[start]
    left_order = np.argsort(lefts.view(f"S{LEFT + 4}").ravel(), kind="stable")
    differ = lefts[left_order][1:] != lefts[left_order][:-1]
    left_shared = np.concatenate([[0], np.where(differ.any(axis=1), differ.argmax(axis=1), LEFT)])
    rank = np.lexsort((places, ids))  # earliest first
    hit = np.zeros((len(start), LEFT + 2), bool)
    left_class = np.empty(len(start), np.int64)
    for a in range(LEFT + 1):
        right_class = np.cumsum(shared < WINDOW - a)
        left_class[left_order] = np.cumsum(left_shared < a) if a else 0
        member = rank[(least[rank] <= a) & (a <= most[rank])]
        if len(member):
            both = right_class[member] * (len(start) + 1) + left_class[member]
            repeated = np.ones(len(member), bool)
            repeated[np.unique(both, return_index=True)[1]] = False
            hit[member, a] = repeated
    row, edge = np.nonzero(np.diff(hit, axis=1, prepend=False))  # in pairs: first offset in, first offset out again
    row, a_in, a_out = row[::2], edge[::2], edge[1::2] - 1
    return which[row], ids[row], places[row] - a_out, places[row] - a_in + WINDOW


ADDED = ("n_bytes", "n_removed", "n_spans", "kept")


def _started(docs: DataFrame, start: str) -> DataFrame:
    """docs with the column `start`, by which rows of one doc_id follow one another in order of their text: the bytes and
    rows before in the order of all rows. Ranges of that order are numbered side by side, so a hot doc_id is split."""
    bounded_batches(docs.sparkSession)
    names = docs.columns
    plain = docs.toDF(*(c if c in ("doc_id", "text") else f"c{k}" for k, c in enumerate(names)))
    sized = plain.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)
    return sums_before(sized, [F.col("doc_id"), F.col("text")], start="size").drop("size").toDF(*names, start)


def cut(docs: DataFrame, prefix: str = "", characters: bool = False) -> DataFrame:
    """docs (doc_id, text, others) with n_bytes, n_removed, n_spans and kept (binary: the remaining bytes) added, their names
    after `prefix`. characters: what a cut leaves of a character of several bytes isn't kept; n_removed is without it.

    Counted in UTF-8 bytes of the whole text; a null text is empty. Documents are ordered by doc_id. Rows that share a
    doc_id (or have none, which comes first) count as documents one after the other in order of their text, so a
    repeated row is removed as a copy; they are dealt to blocks one by one, as rows of different ids are. Windows don't cross rows. Texts under WINDOW bytes stay as they are. An empty
    table gives no rows. Columns of docs with the names of added ones are replaced.
    """
    spark = docs.sparkSession
    added = [prefix + c for c in ADDED]
    docs = docs.drop(*added)
    names = docs.columns
    key, start = "_block", "_start"
    while key in names or start in names:
        key, start = key + "_", start + "_"
    size, rows = docs.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("size"), F.count("*").alias("n")).agg(F.coalesce(F.sum("size"), F.lit(0)), F.max("n")).first()
    dealt = docs.withColumn(start, F.lit(0).cast("long")) if (rows or 0) < 2 else _started(docs, start)
    blocks, buckets = max(LEAST_PARTS, -(-size // BLOCK_BYTES)), max(LEAST_PARTS, -(-size // BUCKET_BYTES))
    placed = dealt.withColumn(key, F.pmod(F.xxhash64("doc_id", start), F.lit(blocks))).repartition(partitions_for(spark, size, 24e6), key)

    def ask(table: pa.Table) -> pa.Table:
        b = Block(table, buckets, start)
        parts = b.slices()
        return pa.table({"bucket": pa.array([x[0] for x in parts], pa.int64()), "block": pa.array([table[key][0].as_py()] * len(parts), pa.int64()), "body": pa.array([b.unique[x[1] : x[2]].tobytes() for x in parts], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        bodies = [np.frombuffer(x, np.uint64) for x in table["body"].to_pylist()]
        every, of, count = np.unique(np.concatenate(bodies), return_inverse=True, return_counts=True)
        common = np.split(count[of] > 1, np.cumsum([len(x) for x in bodies])[:-1])
        return pa.table({"block": table["block"], "bucket": table["bucket"], "kind": pa.array([0] * len(bodies), pa.int32()), "body": pa.array([np.packbits(x).tobytes() for x in common], pa.binary())})

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"bucket": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "body": pa.array([], pa.binary())})
        b = Block(left, buckets, start)
        chosen = b.repeated(dict(zip(right["bucket"].to_pylist(), right["body"].to_pylist(), strict=True)))
        rec, order, leads = b.suffixes(chosen)
        rec, chosen = rec[leads], chosen[order[leads]]
        p = b.place[chosen]
        doc = np.searchsorted(b.offsets, p, "right") - 1
        bucket = np.ascontiguousarray(rec[:, :4]).view(">u4").ravel().astype(np.int64)
        out = []
        for x, y in zip(*stretches(bucket), strict=True):
            c = chosen[x:y]
            out.append((int(bucket[x]), pack_run(rec[x:y], b.ids[doc[x:y]], p[x:y] - b.base[doc[x:y]], p[x:y] - b.last[c], p[x:y] - b.first[c])))
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int64()), "block": pa.array([left[key][0].as_py()] * len(out), pa.int64()), "body": pa.array([x[1] for x in out], pa.binary())})

    def decide(table: pa.Table) -> pa.Table:
        bucket, owner = table["bucket"][0].as_py(), table["block"].to_pylist()
        which, ids, first, end = repeated_spans([Run(x) for x in table["body"].to_pylist()])
        order = np.argsort(which, kind="stable")
        which, spans = which[order], np.stack([ids, first, end], axis=1)[order]
        edges, ends = stretches(which)
        return pa.table({"block": pa.array([owner[which[x]] for x in edges], pa.int64()), "bucket": pa.array([bucket] * len(edges), pa.int64()), "kind": pa.array([1] * len(edges), pa.int32()), "body": pa.array([spans[x:y].astype("<i8").tobytes() for x, y in zip(edges, ends, strict=True)], pa.binary())})

    result = placed.schema.fieldNames()
    result.remove(key)
    result.remove(start)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields if f.name in result)

    def clean(left: pa.Table, right: pa.Table) -> pa.Table:
        b = Block(left, buckets, start)
        kind, bucket, body = (right[c].to_pylist() for c in ("kind", "bucket", "body"))
        gone = np.zeros(len(b.data) + 1, np.int32)
        chosen = b.repeated({k: x for t, k, x in zip(kind, bucket, body, strict=True) if t == 0})
        _, order, leads = b.suffixes(chosen)
        copies = chosen[order[~leads]]
        np.add.at(gone, b.first[copies], 1)
        np.add.at(gone, b.last[copies] + WINDOW, -1)
        spans = np.frombuffer(b"".join(x for t, x in zip(kind, body, strict=True) if t == 1), "<i8").reshape(-1, 3)
        begin = b.base[b.document_of(spans[:, 0], spans[:, 1])] if len(spans) else np.zeros(0, np.int64)
        np.add.at(gone, begin + spans[:, 1], 1)
        np.add.at(gone, begin + spans[:, 2], -1)
        out = np.cumsum(gone, out=gone)[:-1] > 0
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for x, y in zip(b.offsets[:-1], b.offsets[1:], strict=True):
            o = out[x:y]
            n_bytes.append(int(y - x))
            n_removed.append(int(o.sum()))
            n_spans.append(int(o[:1].sum() + (o[1:] & ~o[:-1]).sum()))
            rest = b.data[x:y][~o].tobytes()
            kept.append(rest.decode("utf-8", "ignore").encode() if characters and n_removed[-1] else rest)
        table = b.table.select(result)
        for name, values, kind_ in zip(added, (n_bytes, n_removed, n_spans, kept), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True):
            table = table.append_column(name, pa.array(values, kind_))
        return table

    bits = placed.groupBy(key).applyInArrow(ask, "bucket long, block long, body binary").groupBy("bucket").applyInArrow(answer, "block long, bucket long, kind int, body binary")
    runs = placed.groupBy(key).cogroup(bits.groupBy("block")).applyInArrow(send, "bucket long, block long, body binary")
    spans = runs.groupBy("bucket").applyInArrow(decide, "block long, bucket long, kind int, body binary")
    return placed.groupBy(key).cogroup(bits.unionByName(spans).groupBy("block")).applyInArrow(clean, kinds + "".join(f", `{c}` {kind}" for c, kind in zip(added, ("long", "long", "long", "binary"), strict=True)))


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of every document without passages that occur earlier."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return cut(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every row stays, its text without repeated passages and n_chars set anew; columns of documents.

    A cut may fall inside a character of several bytes; what is left of such a character goes too. A null text stays null.
    Other columns keep their values, whatever their names.
    """
    prefix = "_"
    while any(prefix + c in docs.columns for c in ADDED):
        prefix += "_"
    out = cut(docs, prefix, characters=True)  # a function of its own would double the Python workers of an executor
    text = F.when(F.col("text").isNotNull(), F.when(F.col(f"{prefix}n_removed") == 0, F.col("text")).otherwise(F.col(f"{prefix}kept").cast("string")))
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
