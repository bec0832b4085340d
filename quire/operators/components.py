"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.tables import cut


def connected_components(links: DataFrame, rounds: int = 100) -> DataFrame:
    """``(node, component)`` of ``links (a, b)``; the component is its least node.

    Each round links every neighbour of a node to the least node around it, first the greater neighbours, then the
    smaller ones, until a round changes nothing; a long chain takes rounds in the logarithm of its length. A node's
    neighbours are never gathered: the least of them is an aggregate that combines before the shuffle. Lineage is cut
    after each round. Null nodes and links of a node to itself give nothing; no links give no rows.
    Components that still change after ``rounds`` rounds are an error, never a result.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        after = cut(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small_least.select("u", F.col("m").alias("v"))).distinct()
        )
        done = after.count() == edges.count() and after.join(edges, ["u", "v"], "left_anti").isEmpty()
        edges = after
        if done:
            break
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component"))).distinct()
