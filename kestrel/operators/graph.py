"""Connected components of edges that fit no single task, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.session import cut


def contract(edges: DataFrame) -> DataFrame:
    """``(a, b)``: every node of ``edges(a, b)`` but the smallest of its component, with that smallest node.

    Alternating large-star and small-star steps: the number of rounds grows with the logarithm of the longest path,
    each keeps at most as many edges as there were, and each is written to the shared checkpoint folder.
    """
    last = None
    edges = edges.select("a", "b").where("a <> b")
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        down = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a <> b")
        edges = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            return edges
        last = state


def components(edges: DataFrame) -> DataFrame:
    """``(node, group_id)`` for every node with an edge; ``group_id`` is the smallest of its component. No edges: no rows."""
    stars = contract(edges)
    return stars.select(F.col("a").alias("node"), F.col("b").alias("group_id")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("group_id")).distinct())
