"""Small helpers that the operators of this package share."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in one Arrow batch. A batch of documents stays at a few MB, so a Python worker needs little memory.
ARROW_ROWS = 1000


def bounded_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Keeps Arrow batches small enough for long texts; a smaller value set by the user stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, computed now and written to the shared checkpoint folder; lineage ends here.

    The folder is that of spark.checkpoint.dir. Only where it is unset, in local tests, is one chosen here.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def fold(key: str, parts: int) -> Column:
    """crc32 of an id's text, modulo parts; an id that is null counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % parts


def smallest(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most `rows` rows of df, those with the smallest hash of `key`; the same ones on any partitioning. Each task
    sends `rows` rows at most."""
    return df.orderBy(F.xxhash64(key), key).limit(rows)


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The rows of df of at most `rows` values of `key`, those with the smallest hash; the same ones on any partitioning.

    Only keys are sorted and broadcast, so that no task sends texts which are then dropped.
    """
    keys = smallest(df.select(key).where(F.col(key).isNotNull()).distinct(), key, rows)
    return df.join(F.broadcast(keys), key, "left_semi")


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and n + 1 offsets into them; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def texts(column: pa.Array) -> list[str]:
    """Python strings, a null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def partitions_for(spark: SparkSession, size: float, target: float) -> int:
    """Partitions of about `target` bytes each for `size` bytes, and no fewer than the session's number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / target))


def stretches(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of equal neighbours."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return starts, np.append(starts[1:], len(values))


def join_counted(left: DataFrame, right: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """left joined with right on key; right has one row for each key, whose column n (left out of the result) tells how
    many of the `total` rows of left have it.

    Keys with a thousandth of the rows or more are under a thousand, so those are broadcast; the others, none of which
    fills a task, are shuffled.
    """
    least = max(200, total // 1000 + 1)
    cold = right.where(F.col(n) < least).drop(n)
    if total < least:
        return left.join(cold, key)
    hot = F.broadcast(right.where(F.col(n) >= least).drop(n))
    return left.join(hot, key).unionByName(left.join(F.broadcast(right.where(F.col(n) >= least).select(key)), key, "left_anti").join(cold, key))


def sums_before(df: DataFrame, order: list[Column], **sums: str) -> DataFrame:
    """df, sorted by `order` over all its partitions and written to the checkpoint folder, with a column for each of
    `sums`: the sum of the long column of that value over all rows before. A null counts as 0.

    Ranges of the order are the partitions; only their totals, one row each, reach the driver. Rows that share the whole
    key share a partition, so the last column of `order` should tell rows of a hot key apart.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    totals = {r._part: list(r)[1:] for r in dealt.groupBy("_part").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(f"_{k}") for k, c in enumerate(sums.values()))).collect()}
    offsets, so_far = {}, [0] * len(sums)
    for part in sorted(totals):
        offsets[part] = so_far
        so_far = [a + b for a, b in zip(so_far, totals[part], strict=True)]
    kept, added = df.columns, list(sums)

    def run(batches):
        now = None
        for batch in batches:
            if batch.num_rows:
                now = now or list(offsets[batch.column("_part")[0].as_py()])
                out = [batch.column(c) for c in kept]
                for k, c in enumerate(sums.values()):
                    values = batch.column(c).fill_null(0).to_numpy().astype(np.int64)
                    ends = np.cumsum(values) + now[k]
                    out.append(pa.array(ends - values))
                    now[k] = int(ends[-1])
                yield pa.RecordBatch.from_arrays(out, [*kept, *added])

    return dealt.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(name, T.LongType()) for name in added)]))
