"""Connected components of an edge table, without gathering a component or the edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for every node of edges (a, b), stored: root is the least node of its component.

    Alternates large-star and small-star steps until the edges are stars. The table of least neighbours, one aggregate
    a turn, tells whether they are, has the result if so, and serves the large star if not. Edges that are stars from
    the start take no turn. What a turn makes is stored, so nothing in it is computed or shuffled twice. Groups are
    reduced to their least neighbour by map-side aggregation, and the join that hands it out can be split at a hot
    node by adaptive execution. Self edges and null ends are ignored; repeated edges don't matter.
    """
    edges = edges.select("a", "b").filter(F.col("a") != F.col("b"))
    current = scratch.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    turn = 0
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.save(least_neighbours(both), f"{name}-least-{turn}")
        if least.filter("open").isEmpty():
            scratch.drop(f"{name}-{turn}")
            return least.select(F.col("a").alias("node"), F.col("m").alias("root"))
        # large star: every larger neighbour of a node, and the node, point to the node's least neighbour
        large = both.join(least.select("a", "m"), "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b"))
        large = scratch.save(large, f"{name}-large-{turn}")
        # small star: every smaller neighbour of a node, and the node, point to the least of them
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        small = small.select("e.a", "e.b").filter(F.col("a") != F.col("b")).distinct()
        turn += 1
        current = scratch.save(small, f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}", f"{name}-least-{turn - 1}", f"{name}-large-{turn - 1}")


def least_neighbours(both: DataFrame) -> DataFrame:
    """(a, m, open) for each node a of distinct edges (a, b), given in both directions: m is the least of a and its
    neighbours. No node is open if and only if the edges are stars about their least nodes: an open one has two smaller
    neighbours, or smaller and larger ones."""
    up, down = F.count(F.when(F.col("b") < F.col("a"), 1)), F.count(F.when(F.col("b") > F.col("a"), 1))
    return both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), ((up > 1) | ((up > 0) & (down > 0))).alias("open"))
