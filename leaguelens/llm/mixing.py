"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue. Its documents stand in it in an order shuffled by a hash of their doc_id, and the whole queue is
repeated up to REPEATS times. A document is served in packets of at most PACKET words. A packet's virtual finish time is
the number of words of its source up to its end, divided by the source's target: all sources are at time 1 when each has
had its target. Packets of all sources are sorted by that time over ranges and cut at the budget, so the mix has the
sources' shares not only in the end but at any place, and each source misses its target by about a packet at most.

Targets: the budget is SHARE times all words, split by weight; what a source would get over REPEATS times its size goes
to the others by weight, until none is above. That level is found from running sums over the sources in the order of
size by weight, as those that are capped come first in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaguelens.llm.common import checkpointed, join_counted, sums_before

WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
#: Words of a packet at most.
PACKET = 256
_WORD = r"[^\x20\x09-\x0D]+"


def _key(source: Column) -> Column:
    """A source as text that is never null, so that joins find null sources too."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def sized(docs: DataFrame, size: Column | None = None) -> DataFrame:
    """doc_id, source, size of each row, and its place in the shuffle; computed once, without texts."""
    size = F.coalesce(F.regexp_count("text", F.lit(_WORD)) if size is None else size, F.lit(0)).cast("long")
    shuffled = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return checkpointed(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), shuffled.alias("shuffled")))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> tuple[DataFrame, int]:
    """One row for each source of `rows` (sized): key, n rows, source_size, rank (by code point, null last), before (words of
    the sources before), target; and the budget. Any number of sources."""
    by_source = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    ranked = sums_before(by_source, [F.col("source").asc_nulls_last()], rank="one", before="source_size").drop("one")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    ranked = checkpointed(ranked.withColumns({"weight": weight, "most": F.col("source_size") * repeats, "key": _key(F.col("source"))}).drop("source"))
    total, all_weights = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    budget = share * total
    capped_first = sums_before(ranked.select("rank", "weight", "most", (F.col("most") / F.col("weight")).alias("ratio")), [F.col("ratio"), F.col("rank")], given="most", passed="weight")
    level = (F.lit(budget) - F.col("given")) / (F.lit(all_weights) - F.col("passed"))
    open_ones = capped_first.withColumn("level", level).where(F.col("level") * F.col("weight") <= F.col("most"))
    level = open_ones.agg(F.min(F.struct("ratio", "rank", "level")).alias("first")).first().first
    most = F.col("most").cast("double")
    target = most if level is None else F.least(F.lit(level.level) * F.col("weight"), most)
    return ranked.select("key", "n", "source_size", "rank", "before", target.alias("target")), min(int(budget), total * repeats)


def queued(rows: DataFrame, sources: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """`rows` with its source's row and `ahead`, the words before it in its source's shuffled queue."""
    # Rows of one doc_id are told apart by their number, as they may be many; equal ones can change places.
    told = rows.withColumns({"key": _key(F.col("source")), "row": F.monotonically_increasing_id()})
    order = [F.col("source").asc_nulls_last(), F.col("shuffled"), F.col("size"), F.col("row")]
    placed = sums_before(told, order, everything="size")
    joined = join_counted(placed, sources, "key", "n", rows.count())
    return joined.select("doc_id", "source", "size", "rank", "source_size", "target", (F.col("everything") - F.col("before")).alias("ahead"))


def served(queue: DataFrame, budget: int, repeats: int = REPEATS) -> DataFrame:
    """The mix in its order: doc_id, rank of its source, round (0: the first time), first (word of the document) and words
    of each packet that is served, and `place`, the words of the mix before it."""
    rounds = queue.where("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("round"))
    packets = rounds.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(PACKET).cast("long"))).alias("first"))
    packets = packets.withColumn("words", F.least(F.col("size") - F.col("first"), F.lit(PACKET)))
    packets = packets.withColumn("end", F.col("round") * F.col("source_size") + F.col("ahead") + F.col("first") + F.col("words"))
    timed = packets.select("doc_id", "rank", "round", "first", "words", "end", (F.col("end") / F.col("target")).alias("finish"))
    lined = sums_before(timed, [F.col("finish"), F.col("rank"), F.col("end")], place="words").where(F.col("place") < budget)
    return lined.select("doc_id", "rank", "round", "first", F.least(F.col("words"), F.lit(budget) - F.col("place")).alias("words"), "place")


def mix(docs: DataFrame, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> tuple[DataFrame, DataFrame]:
    """(queue, mix) of docs with columns doc_id, source and text: the rows of `queued` and of `served`.

    size: words of a row, by default those of its text; a null text or size counts as 0. A null source is a source of its
    own, the last. Rows without words are in no packet; a source or table without words has the target 0. Repeated rows
    are documents of their own; rows of one doc_id and size stand next to each other. Further columns are ignored. The
    same rows give the same mix on any partitioning.
    """
    rows = sized(docs, size)
    sources, budget = targets(rows, weights, share, repeats)
    queue = checkpointed(queued(rows, sources))
    return queue, served(queue, budget, repeats)


def taken(queue: DataFrame, served_rows: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """doc_id, size, source_size, target, taken: what the mix takes of each row of the queue, repeats counted.

    A source's packets are served in the order of its queue, so the words served of it tell how far each round came."""
    by_source = served_rows.groupBy("rank").agg(F.sum("words").alias("served"))
    counted = queue.groupBy("rank").agg(F.count("*").alias("n")).join(by_source, "rank", "left")
    counted = checkpointed(counted.select("rank", "n", F.coalesce("served", F.lit(0)).alias("served")))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = [F.least(F.greatest(F.col("served") - k * F.col("source_size") - F.col("ahead"), F.lit(0)), F.col("size")) for k in range(repeats)]
    return join_counted(queue, counted, "rank", "n", total).select("doc_id", "size", "source_size", "target", sum(parts[1:], parts[0]).cast("long").alias("taken"))


def op11_fair_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix of all documents takes of each."""
    return taken(*mix(spark.read.parquet(f"{sf_dir}/documents.parquet")))


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffled,
                  CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
s AS (SELECT *, 2 * source_size AS most, CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s0),
b AS (SELECT 1.5::DOUBLE * sum(source_size) AS budget, sum(weight) AS weights FROM s),
c AS (SELECT s.*, CAST(most AS DOUBLE) / weight AS ratio,
             (budget - coalesce(sum(most) OVER w, 0)::DOUBLE) / (weights - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
      FROM s, b WINDOW w AS (ORDER BY CAST(most AS DOUBLE) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, rank, least((SELECT level FROM c WHERE level * weight <= most ORDER BY ratio, rank LIMIT 1) * weight, CAST(most AS DOUBLE)) AS target FROM s),
q AS (SELECT d.*, rank, source_size, target, sum(size) OVER (PARTITION BY rank ORDER BY shuffled, size, r) - size AS ahead
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT r, rank, target, least(size - f, {PACKET}) AS words, k * source_size + ahead + f + least(size - f, {PACKET}) AS "end"
      FROM (SELECT *, unnest(range(0, size, {PACKET})) AS f FROM (SELECT *, unnest([0, 1]) AS k FROM q WHERE size > 0))),
g AS (SELECT rank, words, sum(words) OVER (ORDER BY CAST("end" AS DOUBLE) / target, rank, "end") - words AS place FROM p),
e AS (SELECT rank, sum(greatest(0, least(words, floor(budget) - place))) AS served FROM g, b GROUP BY rank)
SELECT doc_id, size, source_size, target,
       CAST(least(greatest(coalesce(served, 0) - ahead, 0), size) + least(greatest(coalesce(served, 0) - source_size - ahead, 0), size) AS BIGINT) AS taken
FROM q LEFT JOIN e USING (rank)
"""
