"""Connected components of an undirected graph of any size, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from ..session import cut_lineage

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour greater than a node is tied to the node's least neighbour (or to itself if less). Edges may repeat."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour less than a node, and the node, are tied to the least of them. Edges point down."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    down = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; root is the least node it reaches.

    Self loops and null ends are ignored; nodes without an edge are not listed. Each round is
    checkpointed; it ends when a round changes nothing, which is after about log(longest path) rounds.
    Only a count and a sum per round reach the driver.
    """
    now, mark = _cut(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.col("a").isNull().alias("x"), F.col("b").isNull().alias("y"))
        .where("NOT x AND NOT y AND a != b").select("a", "b").distinct()
    )
    for _ in range(MAX_ROUNDS):
        if not mark["edges"]:
            break
        was = mark
        now, mark = _cut(_small_star(_large_star(now)))
        if mark == was:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select("b", "b").distinct())


def _cut(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The checkpointed edges and a mark of them, taken while they are written."""
    seen, h = Observation(), F.xxhash64("a", "b")
    marked = edges.observe(seen, F.count(F.lit(1)).alias("edges"), F.bit_xor(h).alias("bits"), F.sum((h % 1000003).cast("bigint")).alias("sum"))
    return cut_lineage(marked), seen.get
