"""Connected components of a large graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Link the neighbours of each node to the least of them and the node.

    Large-star (``both_ways``) moves larger neighbours, small-star the smaller
    ones and the node itself. A node's least neighbour is an aggregate, so a
    node with very many links is never gathered in one place.
    """
    near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both_ways else edges
    least = near.groupBy("a").agg(F.min("b").alias("m"))
    least = least.withColumn("m", F.least("m", "a"))
    linked = near.join(least, "a")
    if both_ways:
        moved = linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = linked.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (its least node) for every node of ``links(a, b)``; unlinked nodes have no row.

    Null ends and loops are ignored. Ends when the links form stars, after a
    number of rounds that grows with the logarithm of the longest path.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = links.where("a is not null and b is not null and a != b").select(high.alias("a"), low.alias("b")).distinct()
    edges = materialise(edges, "links", tidy=True)
    mark = None
    while True:
        nxt = materialise(_star(_star(edges, True), False), "links", tidy=True)
        seen = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 31))).first()
        discard(edges)
        edges = nxt
        if tuple(seen) == mark or not seen[0]:
            break
        mark = tuple(seen)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
