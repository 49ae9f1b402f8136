"""Structure fingerprints by colour refinement on a graph (Weisfeiler and Lehman)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.sources.store import Scratch


def refined_classes(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, class, members) for edges (a, b): nodes that refinement can't tell apart, named by the least of them.

    All nodes begin alike; in each round a node's colour becomes a hash of its own and of the multiset of its
    neighbours'. A multiset's hash is the sum of its members' hashes, in two independent 64-bit sums as decimals, which
    merges in any order before it is shuffled, so a node with many neighbours is no burden. Rounds go on until they
    split no class, at most `rounds` times if that is given.

    Edges count once, in both directions; self edges count once. Edges with a null end are ignored. Empty table: no rows.
    """
    scratch = Scratch(edges.sparkSession, "refined")
    known = edges.select("a", "b").filter("a is not null and b is not null")
    both = scratch.save(known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    colours = scratch.save(both.select(F.col("a").alias("node")).distinct().withColumn("colour", F.lit(0).cast("long")), "colours-0")
    classes, turn = 1, 0
    while rounds is None or turn < rounds:
        near = both.join(colours.withColumnRenamed("node", "b"), "b")
        sums = [F.sum(F.xxhash64("colour", F.lit(s)).cast("decimal(38,0)")).alias(f"s{s}") for s in (1, 2)]
        met = near.groupBy(F.col("a").alias("node")).agg(*sums)
        turn += 1
        colours = scratch.save(met.join(colours, "node").select("node", F.xxhash64("colour", "s1", "s2").alias("colour")), f"colours-{turn}")
        scratch.drop(f"colours-{turn - 1}")
        now = colours.agg(F.count_distinct("colour")).first()[0]
        if now == classes:
            break
        classes = now
    named = colours.groupBy("colour").agg(F.min("node").alias("class"), F.count(F.lit(1)).alias("members"))
    return colours.join(named, "colour").select("node", "class", "members")
