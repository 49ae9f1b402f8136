"""Regression metrics over groups, for any prediction column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metric_columns(actual: Column, predicted: Column) -> list[Column]:
    """mae, rmse, r2, n as aggregates. r2 = 1 - SSres / SStot: negative where worse than the mean, null where n < 2
    or the actual values are constant. Over no rows: nulls and 0. (regr_r2 is a squared correlation, another thing.)"""
    error, n, spread = predicted - actual, F.count(F.lit(1)), F.var_pop(actual)
    squares = F.sum(error * error)
    return [
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(squares / F.when(n > 0, n)).alias("rmse"),
        F.when((n >= 2) & (spread > 0), 1.0 - squares / F.when(spread > 0, spread * n)).alias("r2"),
        n.alias("n"),
    ]


def compute_metrics(df: DataFrame, actual: Column, predicted: Column, *groups: str) -> DataFrame:
    """One row for each group, or one for the table."""
    return df.groupBy(*groups).agg(*metric_columns(actual, predicted))


def metrics_report(df: DataFrame, actual: str, predicted: dict[str, str], group: str, order: str) -> DataFrame:
    """model, grp (null for all rows), mae, rmse, r2, n, ord (first place of the group), overall first.

    All models, overall and by group, in one pass of grouping sets: rows are summed before they are shuffled.
    """
    models = ", ".join(f"'{name}', `{column}`" for name, column in predicted.items())
    long = df.select(F.col(actual).alias("actual"), F.col(group).alias("grp"), F.col(order).alias("ord"), F.expr(f"stack({len(predicted)}, {models}) as (model, predicted)"))
    sets = long.groupingSets([[F.col("model")], [F.col("model"), F.col("grp")]], "model", "grp")
    found = sets.agg(*metric_columns(F.col("actual"), F.col("predicted")), F.min("ord").alias("ord"), F.grouping("grp").alias("overall"))
    return found.orderBy(F.desc("overall"), "model", "ord")


def distinct_in_order(df: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with the place where each first appears, in that order."""
    return df.groupBy(value).agg(F.min(order).alias("first_ord")).orderBy("first_ord")


def metric_states(df: DataFrame, actual: Column, predicted: Column, *groups: str) -> DataFrame:
    """A row for each group: n, sum_abs, sum_sq (of the errors), mean and m2 (of the actual values), m2 being the sum of
    squared deviations. Such rows can be stored, a day's for instance, and merged to any range by merged_states().

    Rows whose actual or predicted value is null count nowhere. Null groups are a group. Over no rows: no row, or one of
    n = 0 where there are no groups.
    """
    error, n = predicted - actual, F.count(F.lit(1))
    known = df.filter(actual.isNotNull() & predicted.isNotNull())
    return known.groupBy(*groups).agg(n.alias("n"), F.sum(F.abs(error)).alias("sum_abs"), F.sum(error * error).alias("sum_sq"), F.avg(actual).alias("mean"), (F.var_pop(actual) * n).alias("m2"))


def merged_states(states: DataFrame, *groups: str) -> DataFrame:
    """The states of unions: rows of metric_states(), of any finer groups, summed by `groups`.

    Deviations are moved to the common mean (Chan's rule for many parts), m2 + n (mean - common)^2, which adds
    non-negative terms alone, where a sum of squares less a squared sum cancels. Two aggregates over the few state rows.
    """
    whole = states.groupBy(*groups).agg((F.sum(F.col("n") * F.col("mean")) / F.when(F.sum("n") > 0, F.sum("n"))).alias("common"))
    whole = whole.select(*(F.col(g).alias(f"of_{g}") for g in groups), "common")
    on = F.lit(True)
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"of_{g}"))
    met = states.join(whole, on) if groups else states.crossJoin(F.broadcast(whole))  # one row
    off = F.col("mean") - F.col("common")
    return met.groupBy(*groups).agg(F.sum("n").alias("n"), F.sum("sum_abs").alias("sum_abs"), F.sum("sum_sq").alias("sum_sq"), F.first("common").alias("mean"), F.sum(F.col("m2") + F.col("n") * off * off).alias("m2"))


def metrics_of_states(states: DataFrame) -> DataFrame:
    """The states' other columns with mae, rmse, r2, n, as compute_metrics() gives them over the rows themselves."""
    n = F.when(F.col("n") > 0, F.col("n"))
    r2 = F.when((F.col("n") >= 2) & (F.col("m2") > 0), 1.0 - F.col("sum_sq") / F.when(F.col("m2") > 0, F.col("m2")))
    others = [c for c in states.columns if c not in ("n", "sum_abs", "sum_sq", "mean", "m2")]
    return states.select(*others, (F.col("sum_abs") / n).alias("mae"), F.sqrt(F.col("sum_sq") / n).alias("rmse"), r2.alias("r2"), "n")
