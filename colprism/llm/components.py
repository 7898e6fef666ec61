"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import drop, written


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of all nodes of ``edges`` (a, b); root is the smallest node that links reach.

    Each round is a large star and a small star: nodes pass their smallest neighbour on, so paths halve. Minima are
    taken before rows are shuffled, and edges are never gathered: a hub of many links costs its links. Each round's
    edges are a table in the shared folder until the next round has read them. Rounds that run out before two agree raise an error.
    """
    now = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("k")).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(least, F.col("a") == F.col("k")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct()
        last, now = now, written(small, "edges")
        drop(last, large)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components are not final after {rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
