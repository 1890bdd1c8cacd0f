"""Best-fit packing of documents into training sequences of several permitted lengths.

A document is a sequence of tokens, by default its UTF-8 bytes and one end mark. What is longer than the largest
permitted length is cut into pieces of that length and a rest, so every token is packed exactly once. Pieces are dealt
by a hash of their keys to groups of bounded size, which are packed side by side: longest first, each into the open bin
that it fills best. If none has room, a bin is opened with the permitted length of least cost for each token that it is
expected to hold: its own piece, and what is left of shorter pieces for the rest. A sequence of length c costs
OVERHEAD + c + c * c / BALANCE, for its own handling, its tokens and attention among them. At the end each bin shrinks
to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITIES = (1024, 2048, 4096, 8192, 16384, 32768)
OVERHEAD, BALANCE = 256, 65536
#: Pieces of a group, about. The last bins of a group are emptier than others; with thousands of pieces that is little.
GROUP_PIECES = 5000
#: Equal pieces, those of rows with one doc_id and length, that go to a group together at most.
TOGETHER = 250


def cost(capacity: int) -> float:
    return OVERHEAD + capacity + capacity * capacity / BALANCE


def best_fit(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """(bin, position in it) of each length, and each bin's final capacity. lengths: longest first, none over the largest capacity."""
    sizes = sorted(capacities)
    bins, positions, used = [], [], []
    free: list[tuple[int, int]] = []  # (room left, bin) of open bins, sorted
    ascending = lengths[::-1]
    volume = np.concatenate([[0], np.cumsum(ascending)])
    for i, n in enumerate(lengths):
        at = bisect.bisect_left(free, (n, -1))
        if at < len(free):
            room, b = free.pop(at)
        else:
            left = len(lengths) - i - 1  # the shortest ones are still to come
            fits = [c for c in sizes if c >= n]
            expected = [n + min(c - n, int(volume[min(left, bisect.bisect_right(ascending, c - n))])) for c in fits]
            room = min(zip(fits, expected, strict=True), key=lambda x: (cost(x[0]) / max(x[1], 1), x[0]))[0]
            b = len(used)
            used.append(0)
        bins.append(b)
        positions.append(used[b])
        used[b] += n
        if room > n:
            bisect.insort(free, (room - n, b))
    return bins, positions, [sizes[bisect.bisect_left(sizes, u)] for u in used]


def pack(docs: DataFrame, length: Column | None = None, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """doc_id, piece, start, n_tokens, bin_id, position, capacity: where each piece of each row of docs goes.

    piece counts a document's pieces from 0, start is the piece's first token in the document, position its first in the
    bin, capacity the bin's permitted length. length: the tokens of a row, by default the bytes of `text` and one end
    mark, so a null or empty text has one token; a row of no tokens has no piece, and a length that is null counts as 0.
    Repeated rows are packed each. An empty table gives no rows. Only keys and lengths are shuffled. Equal pieces, as rows
    without doc_id may have in any number, are counted before they are shuffled and dealt TOGETHER at a time.
    """
    largest = max(capacities)
    length = F.coalesce(F.octet_length("text"), F.lit(0)) + 1 if length is None else F.coalesce(length, F.lit(0))
    sized = docs.select("doc_id", length.cast("long").alias("n")).where("n > 0")
    pieces = sized.select("doc_id", "n", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(largest).cast("long"))).alias("piece", "start"))
    pieces = pieces.select("doc_id", F.col("piece").cast("long"), "start", F.least(F.col("n") - F.col("start"), F.lit(largest)).alias("n_tokens"))
    total = sized.agg(F.sum(F.ceil(F.col("n") / largest))).first()[0] or 0
    groups = max(1, -(-int(total) // GROUP_PIECES))
    counted = pieces.groupBy("doc_id", "piece", "start", "n_tokens").agg(F.count("*").alias("n"))
    dealt = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(TOGETHER).cast("long"))).alias("part"))
    dealt = dealt.withColumn("n", F.least(F.col("n") - F.col("part"), F.lit(TOGETHER)))
    of = F.when(F.col("part") == 0, F.xxhash64("doc_id", "piece", "n_tokens")).otherwise(F.xxhash64("doc_id", "piece", "n_tokens", "part"))
    spread = dealt.withColumn("_group", F.pmod(of, F.lit(groups))).drop("part")

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.repeat(np.arange(table.num_rows), table["n"].to_numpy())))
        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, positions, held = best_fit(table["n_tokens"].to_pylist(), capacities)
        first = table["_group"][0].as_py() << 32
        out = table.select(["doc_id", "piece", "start", "n_tokens"])
        for name, values in (("bin_id", [first + b for b in bins]), ("position", positions), ("capacity", [held[b] for b in bins])):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    return spread.groupBy("_group").applyInArrow(run, "doc_id long, piece long, start long, n_tokens long, bin_id long, position long, capacity long")


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last one: the places of all pieces of all docs."""
    return pack(docs)
