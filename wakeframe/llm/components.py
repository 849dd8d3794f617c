"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeframe.llm.stored import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node goes to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the smallest of them; edges here lead to smaller nodes."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionByName(moved).distinct()


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for nodes with a smaller one in reach, the smallest id in reach.

    ``edges`` has BIGINT columns a and b; loops and repeats are allowed. Each step is an aggregate and a join
    on the node, of which a hub's rows can be split; edges never outnumber those given. Each round's edges are
    written, and rounds go on until the edges are the same twice. Without edges, no rows.
    """
    now = stored(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _print(now)
    while mark[0]:
        now = stored(_small_star(_large_star(now)), "edges")
        last, mark = mark, _print(now)
        if mark == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
