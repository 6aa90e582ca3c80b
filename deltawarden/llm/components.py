"""Connected components of an undirected graph by alternating large-star and small-star steps.

Every step is two aggregates and a join over the edges; edges are never gathered at a vertex. The smallest neighbours
are a table of their own before they meet the edges again, so that the edges of a hub come to the join straight from
their own exchange, which Spark can split. The number of rounds grows with the logarithm of the graph. Each round is a
written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from deltawarden.session import cut_lineage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with a > b. Link neighbours to the smallest vertex among a vertex and its neighbours.

    large: of each vertex, only the larger neighbours are relinked; otherwise the smaller ones and the vertex itself.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = cut_lineage(edges.groupBy("a").agg(F.min("b").alias("m")))
        moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """vertex, component (the smallest vertex it reaches) for every vertex of an edge; edges has columns a and b."""
    now = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .distinct())
    state = None
    for _ in range(most_rounds):
        now = cut_lineage(_stars(cut_lineage(_stars(now, True)), False))
        # Stars whose centres are no leaf of another: then every leaf has one edge, to its component.
        fresh = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if fresh == state:
            leaves = now.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
            return leaves.unionByName(leaves.select(F.col("component").alias("vertex"), "component").distinct())
        state = fresh
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
