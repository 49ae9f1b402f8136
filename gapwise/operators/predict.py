"""The two stand-in estimators. Both take the true gap as input: they are not predictive models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.functions.scalar import seeded_unit

# Fixed values
FLOOR_EV, BASELINE_JITTER, CORRECTED_JITTER = 0.02, 0.08, 0.09


def with_bias(df: DataFrame, bias: DataFrame, family_col: str = "family") -> DataFrame:
    """Adds the family's bias; NaN for an unknown family, so that it can't pass for a number.

    `bias` has a row for each chemical family, a closed set of a few, so it is broadcast.
    """
    met = df.join(F.broadcast(bias.select(F.col("family").alias("__family"), "bias")), F.col(family_col) == F.col("__family"), "left")
    return met.withColumn("bias", F.coalesce("bias", F.lit(float("nan")))).drop("__family")


def baseline(eg: Column, bias: Column, id_: Column) -> Column:
    return F.greatest(F.lit(FLOOR_EV), eg * bias + seeded_unit(F.concat(id_, F.lit(":baseline"))) * BASELINE_JITTER * eg)


def corrected(eg: Column, id_: Column) -> Column:
    return F.greatest(F.lit(FLOOR_EV), eg + seeded_unit(F.concat(id_, F.lit(":corrected"))) * CORRECTED_JITTER * eg)


def baseline_uncertainty(eg: Column, bias: Column) -> Column:
    return F.abs(bias - 1.0) * eg * 0.5 + 0.03


def corrected_uncertainty(eg: Column) -> Column:
    return eg * 0.09 + 0.02


def interval(prediction: Column, uncertainty: Column, actual: Column) -> dict[str, Column]:
    """lo may be below 0; only drawing clamps it."""
    return {"lo": prediction - uncertainty, "hi": prediction + uncertainty, "err_abs": F.abs(prediction - actual)}


def predictions(materials: DataFrame, bias: DataFrame) -> DataFrame:
    """Adds bias, baseline, corrected and their uncertainties."""
    eg, id_, b = F.col("actual_eg_ev"), F.col("id"), F.col("bias")
    return with_bias(materials, bias).select(
        "*", baseline(eg, b, id_).alias("baseline"), corrected(eg, id_).alias("corrected"), baseline_uncertainty(eg, b).alias("baseline_u"), corrected_uncertainty(eg).alias("corrected_u")
    )
