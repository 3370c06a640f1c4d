"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


def components(edges: DataFrame) -> DataFrame:
    """`(node, root)` for every node of `edges(a, b)`; root is the smallest node reachable.

    Alternating star contraction (large stars, then small stars): every round hangs neighbours below the smallest
    neighbour until all edges point at a root. Each round is stored, and its aggregates combine before the shuffle; its
    joins send a hub's edges (two numbers each) to one key, which adaptive execution splits where it is skewed. Rounds grow with the logarithm of the longest path.
    Null ends and self-loops are ignored; an empty table gives an empty one.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, "edges")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, "edges")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(down, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        small = stored(small.where("a <> b").distinct(), "edges")
        sums = [
            t.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for t in (edges, small)
        ]
        edges = small
        if sums[0] == sums[1]:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root"))
    ).distinct()
