"""Composition features from element properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: sum(value * weight) / sum(weight); the sum alone where the weights sum to 0, and 0 over no rows."""
    total = F.coalesce(F.sum(weight), F.lit(0.0))
    return F.coalesce(F.sum(value * weight), F.lit(0.0)) / F.when(total == 0, 1.0).otherwise(total)


def long_components(materials: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, role, symbol, frac), a row for each component of either sublattice."""
    parts = F.concat(*(F.transform(role + "s", _with_role(role)) for role in ("cation", "anion")))
    return materials.select(id_col, F.inline(parts))


def _with_role(role: str):
    return lambda c: F.struct(F.lit(role).alias("role"), c["symbol"].alias("symbol"), c["frac"].alias("frac"))


def with_elements(parts: DataFrame, elements: DataFrame, strict: bool = True) -> DataFrame:
    """Joins element properties by symbol; an unknown symbol fails if strict, else its properties are null.

    `elements` is the periodic table: at most some hundred rows, so it is broadcast.
    """
    met = parts.join(F.broadcast(elements), "symbol", "left")
    if strict:
        found = F.assert_true(F.col("electronegativity").isNotNull(), F.concat(F.lit("unknown element "), F.col("symbol")))
        met = met.withColumn("electronegativity", F.when(found.isNull(), F.col("electronegativity")))
    return met


def composition_features(materials: DataFrame, elements: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, en_difference, mean_valence, mean_period, mean_radius_pm) by one pass of conditional aggregates."""
    met = with_elements(long_components(materials, id_col), elements)

    def of(role: str) -> Column:
        mine = F.col("role") == role
        return weighted_mean(F.when(mine, F.col("electronegativity")), F.when(mine, F.col("frac")))

    return met.groupBy(id_col).agg(
        F.abs(of("anion") - of("cation")).alias("en_difference"),
        *(weighted_mean(F.col(c), F.col("frac")).alias(n) for c, n in (("valence_electrons", "mean_valence"), ("period", "mean_period"), ("covalent_radius_pm", "mean_radius_pm"))),
    )
