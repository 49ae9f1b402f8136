"""Work in the order of a key's values, where one key may hold much of the table: running sums, clusters by tolerance,
stratified splits.

Rows are range-partitioned by (key, order) and stored with the number of their range, so a key with many rows lies in
many ranges. What a range needs from those before it is a row for each (range, key), which windows over that small table
give; the rest is done within ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapwise.sources.store import Scratch, fresh


def _ranged(df: DataFrame, by: list[str], order: list[Column], part: str, scratch: Scratch, name: str) -> DataFrame:
    keys = [F.col(f"`{c}`").asc_nulls_last() for c in by] + order
    return scratch.save(df.repartitionByRange(*keys).withColumn(part, F.spark_partition_id()), name)


def _same(left: DataFrame, right: DataFrame, columns: list[tuple[str, str]]) -> Column:
    on = F.lit(True)
    for a, b in columns:
        on = on & left[f"`{a}`"].eqNullSafe(right[f"`{b}`"])
    return on


def running_sums(df: DataFrame, by: list[str], order: list[Column], value: str, into: str) -> DataFrame:
    """Adds `into`: the sum of `value` (a long) over the rows of the same `by` that come before in `order`.

    order should tell all rows apart, or else rows that are equal in it share their places in any way. Null keys are a key
    of their own. Null values count as 0. Empty table: no rows.
    """
    scratch = Scratch(df.sparkSession, "running")
    part, sums, at_part = fresh(df, "part", "sums", "at_part")
    own = fresh(df, *(f"own_{k}" for k in range(len(by))))
    ordered = _ranged(df, by, order, part, scratch, "ordered")
    number = F.coalesce(F.col(f"`{value}`"), F.lit(0)).cast("long")
    held = ordered.groupBy(part, *(f"`{c}`" for c in by)).agg(F.sum(number).alias(sums))
    earlier = Window.partitionBy(*(f"`{c}`" for c in by)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn(sums, F.coalesce(F.sum(sums).over(earlier), F.lit(0)))
    held = scratch.save(held.select(F.col(part).alias(at_part), *(F.col(f"`{c}`").alias(o) for c, o in zip(by, own, strict=True)), sums), "held")
    within = Window.partitionBy(part, *(f"`{c}`" for c in by)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = ordered.withColumn(into, F.coalesce(F.sum(number).over(within), F.lit(0)))
    met = before.join(held, _same(before, held, [(part, at_part), *zip(by, own, strict=True)]))
    return met.withColumn(into, F.col(into) + F.col(sums)).select(*(f"`{c}`" for c in df.columns), into)


def tolerance_clusters(df: DataFrame, key: str, value: str, tolerance: float, into: str = "cluster") -> DataFrame:
    """Adds `into`: the number, from 0, of the row's cluster within its key.

    In the order of `value`, a row that is more than `tolerance` above the one before starts a cluster, so a cluster's
    neighbours are close, however far its ends are apart. A run that goes on from one range to the next is joined there
    by the values at both sides of the border. Null keys are a key of their own. Rows whose value is null or not a number
    have no cluster (null). Empty table: no rows.
    """
    scratch = Scratch(df.sparkSession, "clusters")
    part, start, low, high, starts, base, at_part, at_key = fresh(df, "part", "start", "low", "high", "starts", "base", "at_part", "at_key")
    number = F.col(f"`{value}`")
    sound = number.isNotNull() & ~F.isnan(number.cast("double"))
    good = df.filter(sound)
    ordered = _ranged(good, [key], [number.asc()], part, scratch, "ordered")
    within = Window.partitionBy(part, f"`{key}`").orderBy(number)
    gap = number - F.lag(number).over(within) > tolerance
    local = ordered.withColumn(start, F.coalesce(gap, F.lit(True)).cast("long"))
    local = local.withColumn(start, F.sum(start).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    borders = local.groupBy(part, f"`{key}`").agg(F.min(number).alias(low), F.max(number).alias(high), F.max(start).alias(starts))
    by_part = Window.partitionBy(f"`{key}`").orderBy(part)
    goes_on = F.coalesce(F.col(low) - F.lag(high).over(by_part) <= tolerance, F.lit(False)).cast("long")
    borders = borders.withColumn(base, goes_on)
    # clusters that begin in earlier ranges, less one if the first run is the last of those
    before = F.coalesce(F.sum(F.col(starts) - F.col(base)).over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    borders = scratch.save(borders.select(F.col(part).alias(at_part), F.col(f"`{key}`").alias(at_key), (before - F.col(base)).alias(base)), "borders")
    met = local.join(borders, _same(local, borders, [(part, at_part), (key, at_key)]))
    found = met.select(*(f"`{c}`" for c in df.columns), (F.col(base) + F.col(start) - 1).alias(into))
    return found.unionByName(df.filter(~F.coalesce(sound, F.lit(False))).withColumn(into, F.lit(None).cast("long")))


def without_polymorphs(df: DataFrame, key: str, value: str, tolerance: float, best: list[str]) -> DataFrame:
    """One row of each cluster of tolerance_clusters(): the least by the columns in `best`, with `cluster` and `members`.

    Rows without a cluster each stay, with one member. Of rows that are equal in `best` any one stays. A cluster is
    reduced before it is shuffled, so one with many rows is no burden. Empty table: no rows.
    """
    cluster, members = fresh(df, "cluster", "members")
    found = tolerance_clusters(df, key, value, tolerance, cluster)
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    rank = F.struct(*(F.col(f"`{c}`").isNull() for c in best), *(F.col(f"`{c}`") for c in best))
    kept = found.filter(F.col(cluster).isNotNull()).groupBy(f"`{key}`", cluster).agg(F.min_by(row, rank).alias("kept"), F.count(F.lit(1)).alias("times"))
    kept = kept.select("kept.*", F.col(cluster).alias(cluster), F.col("times").alias(members))
    return kept.unionByName(found.filter(F.col(cluster).isNull()).withColumn(members, F.lit(1).cast("long")))


def stratified_split(rows: DataFrame, group: str, stratum: str, shares: dict[str, int], seed: int = 0) -> DataFrame:
    """(group, stratum, rows, split): whole groups dealt to the splits in proportion to `shares` within each stratum.

    A group belongs to the least of its strata, so it's in one split, whatever its rows say. Groups are ordered by a hash
    of `seed` and the group, and a group goes to the split in whose part of its stratum's rows it begins. So each
    stratum's splits miss their quotas by less than one group at each border; rows that are added move a group only where
    a border passes it. Null groups are one group; null strata are one, used where a group has no other. Empty table: no rows.
    """
    total = sum(shares.values())
    sized = rows.groupBy(F.col(f"`{group}`").alias("group")).agg(F.min(f"`{stratum}`").alias("stratum"), F.count(F.lit(1)).alias("rows"))
    sized = sized.withColumn("hash", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("group").cast("string"), F.lit("null")))))
    sized = running_sums(sized, ["stratum"], [F.col("hash"), F.col("group").asc_nulls_last()], "rows", "start")
    whole = sized.groupBy(F.col("stratum").alias("of")).agg(F.sum("rows").alias("whole"))
    met = sized.join(whole, F.col("stratum").eqNullSafe(F.col("of")))
    split, upto = F.lit(None).cast("string"), 0
    borders = []
    for name, share in shares.items():
        upto += share
        borders.append((name, upto))
    for name, end in reversed(borders):
        split = F.when(F.col("start") * total < F.col("whole") * end, name).otherwise(split)
    return met.select(F.col("group").alias(group), F.col("stratum").alias(stratum), "rows", split.alias("split"))
