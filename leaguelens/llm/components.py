"""Connected components of a graph held in a DataFrame, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaguelens.llm.common import checkpointed, join_counted


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def roots(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the smallest node of its component. Nodes are of any type that
    has an order.

    Loops and repeated edges don't matter; an edge with a null end is left out; no edges give no rows. Each round is two
    joins of the edges with one minimum for each node, pre-aggregated before the shuffle, and ends in a checkpoint, so a
    lost executor costs one round at most. Nodes with very many edges, as the centre of a star has, don't meet their
    edges in one task. A path of n nodes takes about log n rounds; RuntimeError if `rounds` don't do.
    """
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = checkpointed(ordered.distinct())  # a > b
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        # large star: every larger neighbour of a node is hung on the smallest one around it
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = join_counted(both, least, "a", "n", 2 * state[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours are hung on the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        hung = join_counted(large, least, "a", "n", 2 * state[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = checkpointed(hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
