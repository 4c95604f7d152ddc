"""Connected components of an undirected graph, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (columns a, b of one orderable type): root is the
    least node of its component.

    Alternates large-star and small-star steps until the edges no longer change; the number of
    rounds grows with the logarithm of the longest path. Every step is one aggregation for the least
    neighbour (folded before the shuffle) and one join, whose hot keys adaptive execution splits.
    """
    now = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        before = now
        # large star: larger neighbours of a node are tied to its least neighbour (or itself)
        both = before.select(F.col("a").alias("u"), F.col("b").alias("v")).union(before.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("least").alias("b")).distinct()
        # small star: smaller neighbours of a node, and the node, are tied to the least of them
        floor = large.groupBy("a").agg(F.min("b").alias("floor"))
        small = large.join(floor, "a").select(F.explode(F.array(F.struct("a", F.col("floor").alias("b")), F.struct(F.col("b").alias("a"), F.col("floor").alias("b")))).alias("e"))
        now = cut_lineage(small.select("e.a", "e.b").where("a <> b").distinct())
        # nothing changed: equal counts and no edge that the other lacks
        if now.count() == before.count() and now.exceptAll(before).isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
