"""Prediction bands with a stated coverage: exact quantiles of calibration errors, by group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapwise.sources.store import Scratch

#: Bins of a round of narrowing.
BINS = 256


def _scaled(v: Column, turn: int) -> Column:
    """A rising function of the value: half of it, which keeps widths finite, or in every other round its logarithm,
    which parts values of different size."""
    if turn % 2 == 0:
        return v / 2
    return F.signum(v) * (F.log(F.when(v != 0, F.abs(v)).otherwise(5e-324)) + 800.0)


def ranked_values(df: DataFrame, group: str, value: Column, rank: Column) -> DataFrame:
    """(group, n, rank, value): the value of that rank, from 1, among each group's values; null where there are fewer.

    `rank` is a column over n, the group's number of values. Exact, and no group is sorted or gathered: in each round the
    values between a group's bounds are counted in BINS bins, by sums that are merged before they are shuffled, and the
    bounds become the least and the greatest value of the bin that holds the rank. A group is done when those are equal.
    Bins are even in the values and in their logarithms in turn, so a few rounds do, whatever the values' sizes.

    Null and NaN values count nowhere. Null groups are a group. Empty table: no rows.
    """
    scratch = Scratch(df.sparkSession, "ranked")
    values = df.select(F.col(f"`{group}`").alias("grp"), value.cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    values = scratch.save(values, "values")
    state = values.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    state = state.withColumn("rank", rank.cast("long")).withColumn("below", F.lit(0).cast("long"))
    state = scratch.save(state, "state-0")
    turn = 0
    while not (open_ := state.filter("low < high and rank between 1 and n")).isEmpty():
        bounds = open_.select(F.col("grp").alias("of"), "low", "high", "rank", "below")
        inside = values.join(bounds, F.col("grp").eqNullSafe(F.col("of"))).filter(F.col("v").between(F.col("low"), F.col("high")))
        at, low, high = (_scaled(F.col(c), turn) for c in ("v", "low", "high"))
        share = F.when(high > low, (at - low) / F.when(high > low, high - low)).otherwise(0.0)
        bins = inside.groupBy("grp", "rank", "below", F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("count"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.sum("count").over(Window.partitionBy("grp").orderBy("bin"))
        bins = bins.withColumn("upto", F.col("below") + upto)
        hit = bins.filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("count") < F.col("rank")))
        hit = hit.select(F.col("grp").alias("of"), F.col("low").alias("to_low"), F.col("high").alias("to_high"), (F.col("upto") - F.col("count")).alias("to_below"))
        turn += 1
        state = state.join(hit, F.col("grp").eqNullSafe(F.col("of")), "left").select("grp", "n", F.coalesce("to_low", "low").alias("low"), F.coalesce("to_high", "high").alias("high"), "rank", F.coalesce("to_below", "below").alias("below"))
        state = scratch.save(state, f"state-{turn}")
    return state.select(F.col("grp").alias(group), "n", "rank", F.when(F.col("rank").between(1, F.col("n")), F.col("low")).alias("value"))


def conformal_bands(df: DataFrame, group: str, actual: Column, predicted: Column, coverage: float = 0.9) -> DataFrame:
    """(group, n, rank, band): the half width that holds the actual value around a prediction of new rows like these
    with a chance of at least `coverage`: the ceil((n + 1) coverage)-th smallest calibration error (split conformal).

    Infinite where a group has too few rows to promise it. Edge cases are as in ranked_values().
    """
    rank = F.ceil((F.col("n") + 1) * F.lit(coverage) - 1e-9)
    found = ranked_values(df, group, F.abs(predicted - actual), rank)
    return found.select(group, "n", "rank", F.coalesce("value", F.lit(math.inf)).alias("band"))
