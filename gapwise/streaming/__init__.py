"""Estimators and their metrics on streams.

Every column function and broadcast join of this library works on a streaming DataFrame. What streams add is when a
metric is final: here once the watermark has passed the end of its window.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.operators.metrics import metric_columns
from gapwise.operators.predict import predictions


def score_stream(materials: DataFrame, bias: DataFrame) -> DataFrame:
    """Both stand-ins for each arriving material; `bias` is a static table. Stateless."""
    return predictions(materials, bias)


def windowed_metrics(scored: DataFrame, actual: Column, predicted: Column, time_col: str, width: str, lateness: str, *groups: str) -> DataFrame:
    """window_start, the groups, mae, rmse, r2 and n of each window of `width`.

    State is a few sums for each open window and group. Rows later than `lateness` behind the newest are dropped, and
    a window is emitted (append mode) when the watermark passes its end.
    """
    rows = scored.withWatermark(time_col, lateness)
    found = rows.groupBy(F.window(time_col, width), *groups).agg(*metric_columns(actual, predicted))
    return found.select(F.col("window.start").alias("window_start"), *groups, "mae", "rmse", "r2", "n")
