"""Connected components of a distributed edge list: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quantloom.llm.common import checkpoint


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).distinct()
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) of every node that has an edge (a, b), a <> b. Each round is a few shuffles of the
    edge list and is cut off by a checkpoint; the number of edges never grows, and only a fingerprint of it reaches the
    driver, to see that nothing moves any more. Hubs are rows of one key on one side of a join, which adaptive execution
    splits."""
    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = checkpoint(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = mark(now)
    while seen[0]:
        after = checkpoint(_small_star(_large_star(now)))
        told = mark(after)
        now = after
        if told == seen:
            break
        seen = told
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
