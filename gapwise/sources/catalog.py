"""The embedded catalog as DataFrames: materials, elements, alloy systems, family bias, composition grid."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

COMPONENTS = "array<struct<symbol:string,frac:double>>"
MATERIAL_SCHEMA = f"ord int, id string, formula string, display_name string, cations {COMPONENTS}, anions {COMPONENTS}, structure string, family string, lattice_constant_ang double, actual_eg_ev double, note string"
ELEMENT_SCHEMA = "symbol string, name string, electronegativity double, covalent_radius_pm int, valence_electrons int, period int, color string"
ALLOY_SCHEMA = "id string, label string, endpoint_a string, endpoint_b string, bowing_ev double, varying_sublattice string, description string"
BIAS_SCHEMA = "family string, bias double"

STRUCTURES = ("rocksalt", "zincblende", "wurtzite", "diamond")
SUBLATTICES = ("cation", "anion")

# The catalog's rows. Components are (symbol, fraction of their sublattice).
MATERIALS = [
    ("PbS", "PbS", "Lead sulfide", [("Pb", 1.0)], [("S", 1.0)], "rocksalt", "IV-VI rocksalt (Pb-chalcogenide)", 5.936, 0.41, "Classic colloidal-quantum-dot NIR/SWIR photodetector material."),
    ("PbSe", "PbSe", "Lead selenide", [("Pb", 1.0)], [("Se", 1.0)], "rocksalt", "IV-VI rocksalt (Pb-chalcogenide)", 6.117, 0.27, "Narrower gap than PbS; tuned via quantum confinement for SWIR imaging."),
    ("PbTe", "PbTe", "Lead telluride", [("Pb", 1.0)], [("Te", 1.0)], "rocksalt", "IV-VI rocksalt (Pb-chalcogenide)", 6.462, 0.32, "Gap set by relativistic band inversion, not simple ionicity trends."),
    ("SnTe", "SnTe", "Tin telluride", [("Sn", 1.0)], [("Te", 1.0)], "rocksalt", "IV-VI rocksalt (Sn-chalcogenide)", 6.327, 0.18, "Topological-crystalline-insulator parent compound; very narrow gap."),
    ("InAs", "InAs", "Indium arsenide", [("In", 1.0)], [("As", 1.0)], "zincblende", "III-V zincblende", 6.058, 0.36, "High-mobility narrow-gap III-V, used in SWIR avalanche photodiodes."),
    ("InSb", "InSb", "Indium antimonide", [("In", 1.0)], [("Sb", 1.0)], "zincblende", "III-V zincblende", 6.479, 0.17, "Narrowest-gap III-V in this set; mainly a mid-IR material at the SWIR edge."),
    ("GaSb", "GaSb", "Gallium antimonide", [("Ga", 1.0)], [("Sb", 1.0)], "zincblende", "III-V zincblende", 6.096, 0.73, "Substrate and barrier layer for InGaAs/GaSb SWIR photodiode stacks."),
    ("InGaAs-lattice-matched", "In₀.₅₃Ga₀.₄₇As", "InGaAs (telecom, lattice-matched to InP)", [("In", 0.53), ("Ga", 0.47)], [("As", 1.0)], "zincblende", "III-V zincblende", 5.869, 0.75, "The incumbent commercial NIR detector material, used across the 900-1700 nm telecom band."),
    ("InP", "InP", "Indium phosphide", [("In", 1.0)], [("P", 1.0)], "zincblende", "III-V zincblende", 5.869, 1.35, "Substrate/window layer for InGaAs detectors; near the upper edge of the target window."),
    ("GaAs", "GaAs", "Gallium arsenide", [("Ga", 1.0)], [("As", 1.0)], "zincblende", "III-V zincblende", 5.653, 1.42, "Just above the target window; included as an upper-bound reference point."),
    ("CdTe", "CdTe", "Cadmium telluride", [("Cd", 1.0)], [("Te", 1.0)], "zincblende", "II-VI zincblende", 6.482, 1.5, "Anchors the CdTe-family named explicitly in the spec's material scope."),
    ("CdSe", "CdSe", "Cadmium selenide", [("Cd", 1.0)], [("Se", 1.0)], "wurtzite", "II-VI wurtzite", 4.3, 1.74, "Wurtzite polymorph; classic quantum-dot host, just past the target window."),
    ("Si", "Si", "Silicon", [("Si", 1.0)], [("Si", 1.0)], "diamond", "Group IV (diamond)", 5.431, 1.12, "Ubiquitous visible/near-NIR detector material; the group-IV control case."),
    ("Ge", "Ge", "Germanium", [("Ge", 1.0)], [("Ge", 1.0)], "diamond", "Group IV (diamond)", 5.658, 0.67, "Standard NIR photodiode material below 1550 nm; a second group-IV control case."),
]

# Symbol, name, electronegativity (Pauling), covalent radius (pm), valence electrons, period, color.
ELEMENTS = [
    ("Pb", "Lead", 2.33, 146, 4, 6, "#5b5650"),
    ("Sn", "Tin", 1.96, 139, 4, 5, "#8f9ca3"),
    ("S", "Sulfur", 2.58, 105, 6, 3, "#d9b23c"),
    ("Se", "Selenium", 2.55, 120, 6, 4, "#bf8f2e"),
    ("Te", "Tellurium", 2.1, 140, 6, 5, "#8a7048"),
    ("In", "Indium", 1.78, 142, 3, 5, "#7d8fae"),
    ("Ga", "Gallium", 1.81, 122, 3, 4, "#6f9c92"),
    ("As", "Arsenic", 2.18, 119, 5, 4, "#7a689c"),
    ("Sb", "Antimony", 2.05, 139, 5, 5, "#8a6ba0"),
    ("P", "Phosphorus", 2.19, 107, 5, 3, "#c17a3e"),
    ("Cd", "Cadmium", 1.69, 144, 2, 5, "#a888b8"),
    ("Ge", "Germanium", 2.01, 122, 4, 4, "#5f8a7c"),
    ("Si", "Silicon", 1.9, 111, 4, 3, "#5a7f8c"),
]

# Id, label, endpoints, bowing (eV), the sublattice that varies, description.
ALLOYS = [
    ("InGaAs", "In₁₋ₓGaₓAs", "InAs", "GaAs", 0.477, "cation", "The commercial NIR-detector alloy family; x = 0.47 is the telecom composition lattice-matched to InP."),
    ("PbSSe", "PbS₁₋ₓSeₓ", "PbS", "PbSe", 0.15, "anion", "Rocksalt IV-VI alloy; tunes SWIR cutoff wavelength across both lead-chalcogenide endpoints."),
    ("CdSeTe", "CdSe₁₋ₓTeₓ", "CdSe", "CdTe", 0.3, "anion", "II-VI alloy spanning the wurtzite/zincblende boundary near the top of the target window."),
]

# What the baseline stand-in multiplies a family's gap by.
FAMILY_BIAS = [
    ("III-V zincblende", 0.92),
    ("II-VI zincblende", 0.9),
    ("II-VI wurtzite", 0.9),
    ("Group IV (diamond)", 0.88),
    ("IV-VI rocksalt (Sn-chalcogenide)", 1.8),
    ("IV-VI rocksalt (Pb-chalcogenide)", 2.6),
]


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Fixed rows as one literal of the plan, which needs no Python worker."""
    columns = StructType.fromDDL(schema)
    text = json.dumps([dict(zip(columns.names, map(_plain, row), strict=True)) for row in rows])
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(text), ArrayType(columns))))


def _plain(value):
    """Components, which are lists of (symbol, fraction), as objects."""
    return [{"symbol": s, "frac": f} for s, f in value] if isinstance(value, list) else value


def materials(spark: SparkSession) -> DataFrame:
    """The catalog; `ord` is a row's place, which several reports order by."""
    return _table(spark, [(i, *row) for i, row in enumerate(MATERIALS)], MATERIAL_SCHEMA)


def elements(spark: SparkSession) -> DataFrame:
    return _table(spark, ELEMENTS, ELEMENT_SCHEMA)


def alloys(spark: SparkSession) -> DataFrame:
    return _table(spark, ALLOYS, ALLOY_SCHEMA)


def family_bias(spark: SparkSession) -> DataFrame:
    return _table(spark, FAMILY_BIAS, BIAS_SCHEMA)


def composition_grid(spark: SparkSession, steps: int = 100) -> DataFrame:
    """x = 0, 1/steps .. 1. Dividing gives the doubles that the decimal texts parse to; multiplying wouldn't."""
    return spark.range(steps + 1).select((F.col("id") / F.lit(float(steps))).alias("x"))


def _checked(df: DataFrame, column: str, good: Column) -> DataFrame:
    """Fails at run time where a value isn't good; null isn't."""
    failed = F.concat(F.lit(f"unknown {column} "), F.coalesce(F.col(column).cast("string"), F.lit("null")))
    return df.withColumn(column, F.when(good, F.col(column)).otherwise(F.raise_error(failed)))


def checked_materials(df: DataFrame) -> DataFrame:
    """Fails at run time on a structure or family outside the closed sets, or a material without cations or anions."""
    df = _checked(df, "structure", F.col("structure").isin(*STRUCTURES))
    df = _checked(df, "family", F.col("family").isin(*(f for f, _ in FAMILY_BIAS)))
    return _checked(_checked(df, "cations", F.size("cations") > 0), "anions", F.size("anions") > 0)


def checked_alloys(df: DataFrame) -> DataFrame:
    """Fails at run time on a varying sublattice outside the closed set."""
    return _checked(df, "varying_sublattice", F.col("varying_sublattice").isin(*SUBLATTICES))


def by_id(df: DataFrame, wanted: str, id_col: str = "id") -> DataFrame:
    """Point lookup; no row where the id is unknown."""
    return df.filter(F.col(id_col) == F.lit(wanted))


def last_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """The index of an ordered table: of rows with equal keys the last one, as building a map by key leaves it."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("last")).select(key, "last.*")
