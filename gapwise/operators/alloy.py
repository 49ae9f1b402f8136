"""Pseudo-binary alloys: band gap with bowing, and virtual material rows over a composition grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapwise.functions.exact import exact_fixed


def eg_at(a: Column, b: Column, bowing: Column, x: Column) -> Column:
    return (1.0 - x) * a + x * b - bowing * x * (1.0 - x)


def lerp(a: Column, b: Column, x: Column) -> Column:
    return a * (1.0 - x) + b * x


def endpoints(alloys: DataFrame, materials: DataFrame) -> DataFrame:
    """Alloy systems with both endpoint rows as structs `a` and `b`; an unknown endpoint fails."""
    m = materials.select(F.col("id").alias("__id"), F.struct(*materials.columns).alias("__row"))
    for end in "ab":
        name = f"endpoint_{end}"
        alloys = alloys.join(m, F.col(name) == F.col("__id"), "left")
        found = F.assert_true(F.col("__id").isNotNull(), F.concat(F.lit("unknown endpoint "), F.col(name)))
        alloys = alloys.withColumn(end, F.when(found.isNull(), F.col("__row"))).drop("__id", "__row")
    return alloys


def virtual_materials(alloys: DataFrame, materials: DataFrame, grid: DataFrame) -> DataFrame:
    """A material row for each system and x of the grid, with `system` and `x`.

    The grid has a fixed number of points, so each system's row is multiplied by a constant.
    """
    return _virtual_rows(_systems(alloys, materials).crossJoin(F.broadcast(grid)))


def virtual_at(requests: DataFrame, alloys: DataFrame, materials: DataFrame) -> DataFrame:
    """A material row for each request (system, x); none where the system is unknown."""
    return _virtual_rows(requests.select("system", "x").join(_systems(alloys, materials), "system"))


def _systems(alloys: DataFrame, materials: DataFrame) -> DataFrame:
    return endpoints(alloys.select(F.col("id").alias("system"), "label", "endpoint_a", "endpoint_b", "bowing_ev", "varying_sublattice", "description"), materials)


def _virtual_rows(rows: DataFrame) -> DataFrame:
    """The varying sublattice mixes the endpoints' first components; the rest, structure and family come from the
    first endpoint. The id holds x with two decimals and seeds the estimators' jitter."""
    x = F.col("x")

    def sublattice(role: str) -> Column:
        mixed = F.array(*(F.struct(F.get(F.col(f"{e}.{role}s"), F.lit(0))["symbol"].alias("symbol"), w.alias("frac")) for e, w in (("a", 1.0 - x), ("b", x))))
        return F.when(F.col("varying_sublattice") == role, mixed).otherwise(F.col(f"a.{role}s")).alias(f"{role}s")

    name = exact_fixed(x, 2)
    return rows.select(
        F.concat("system", F.lit("-x"), name).alias("id"),
        F.col("label").alias("formula"),
        F.concat("label", F.lit(" (x = "), name, F.lit(")")).alias("display_name"),
        sublattice("cation"),
        sublattice("anion"),
        F.col("a.structure").alias("structure"),
        F.col("a.family").alias("family"),
        lerp(F.col("a.lattice_constant_ang"), F.col("b.lattice_constant_ang"), x).alias("lattice_constant_ang"),
        eg_at(F.col("a.actual_eg_ev"), F.col("b.actual_eg_ev"), F.col("bowing_ev"), x).alias("actual_eg_ev"),
        F.col("description").alias("note"),
        "system",
        "x",
    )
