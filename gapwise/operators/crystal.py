"""Unit cells as long tables: sites with boundary images, nearest-neighbour bonds and cell edges.

Positions depend on the structure alone, so the geometry of each structure is built once, from the site table, and
joined to materials by structure: a broadcast of a few fixed rows, without a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gapwise.functions.scalar import atom_radius

ENDS = ("x1", "y1", "z1", "x2", "y2", "z2")
BOND_SLACK, ON_BOUNDARY, UNKNOWN_COLOR = 1.06, 1e-6, "#999999"
# Face-centred positions, and what each cubic structure adds to them for its second sublattice
FACE_CENTRED = [(0.0, 0.0, 0.0), (0.0, 0.5, 0.5), (0.5, 0.0, 0.5), (0.5, 0.5, 0.0)]
SECOND_SUBLATTICE = {"rocksalt": (0.5, 0.0, 0.0), "zincblende": (0.25, 0.25, 0.25), "diamond": (0.25, 0.25, 0.25)}
# The hexagonal cell's height, internal parameter and in-plane positions
WURTZITE_C, WURTZITE_U, WURTZITE_XY = 1.62, 0.375, [(1 / 3, 2 / 3, 0.0), (2 / 3, 1 / 3, 0.5)]
CUBIC_DIVISOR, WURTZITE_DIVISOR = 6.0, 4.3
CUBIC_BASIS = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))
WURTZITE_BASIS = ((1.0, 0.0, 0.0), (-0.5, math.sqrt(3) / 2, 0.0), (0.0, 0.0, WURTZITE_C))


def cell_kind(structure: Column) -> Column:
    """Any other structure is treated as zincblende."""
    return F.when(structure.isin("rocksalt", "diamond", "wurtzite"), structure).otherwise("zincblende")


def site_table(spark: SparkSession) -> DataFrame:
    """kind, role, pos, sites (of that role), fx, fy, fz."""
    rows = []
    for kind, shift in SECOND_SUBLATTICE.items():
        rows += [(kind, "cation", i, 4, *p) for i, p in enumerate(FACE_CENTRED)]
        rows += [(kind, "anion", i, 4, *(a + b for a, b in zip(p, shift, strict=True))) for i, p in enumerate(FACE_CENTRED)]
    rows += [("wurtzite", "cation", i, 2, *p) for i, p in enumerate(WURTZITE_XY)]
    rows += [("wurtzite", "anion", i, 2, x, y, z + WURTZITE_U) for i, (x, y, z) in enumerate(WURTZITE_XY)]
    return spark.createDataFrame(rows, "kind string, role string, pos int, sites int, fx double, fy double, fz double")


def boundary_images(df: DataFrame, *axes: str) -> DataFrame:
    """Each coordinate at 0 also appears at 1; one at 1 isn't mirrored to 0."""
    for axis in axes:
        df = df.withColumn(axis, F.explode(F.when(F.abs(F.col(axis)) < ON_BOUNDARY, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(axis))))
    return df


def to_cartesian(fx: Column, fy: Column, fz: Column, kind: Column) -> list[Column]:
    out = []
    for k in range(3):
        basis = [F.when(kind == "wurtzite", w[k]).otherwise(c[k]) for w, c in zip(WURTZITE_BASIS, CUBIC_BASIS, strict=True)]
        out.append(basis[0] * fx + basis[1] * fy + basis[2] * fz)
    return out


def assigned_symbol(components: Column, pos: Column, sites: Column) -> Column:
    """One component fills all sites; of two, the second takes the last round(sites * fraction). Further ones don't count."""
    second = F.get(components, F.lit(1))
    return F.when(F.size(components) == 1, F.get(components, F.lit(0))["symbol"]).when(pos < sites - F.round(sites * second["frac"]), F.get(components, F.lit(0))["symbol"]).otherwise(second["symbol"])


def distance(p: tuple[str, str, str], q: tuple[str, str, str]) -> Column:
    return F.sqrt(sum((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in zip(p, q, strict=True)))


def nearest_bonds(first: DataFrame, second: DataFrame, key: str, slack: float = BOND_SLACK) -> DataFrame:
    """Pairs within a key at up to `slack` times the key's least distance: key, columns of both sides, dist.

    first has x1, y1, z1, second x2, y2, z2. The equi-join on the key bounds the work by the key's own sites; key
    sizes are those of a unit cell. The least distance is a window over the join's own partitioning.
    """
    met = first.join(second, key).withColumn("dist", distance(("x1", "y1", "z1"), ("x2", "y2", "z2")))
    return met.withColumn("least", F.min("dist").over(Window.partitionBy(key))).filter(F.col("dist") <= F.col("least") * slack).drop("least")


def kind_atoms(spark: SparkSession) -> DataFrame:
    """kind, role, pos, sites, x, y, z of each structure, boundary images included."""
    sites = boundary_images(site_table(spark), "fx", "fy", "fz")
    x, y, z = to_cartesian(F.col("fx"), F.col("fy"), F.col("fz"), F.col("kind"))
    return sites.select("kind", "role", "pos", "sites", x.alias("x"), y.alias("y"), z.alias("z"))


def kind_bonds(spark: SparkSession) -> DataFrame:
    atoms = kind_atoms(spark)
    sides = [atoms.filter(F.col("role") == role).select("kind", *(F.col(a).alias(f"{a}{n}") for a in "xyz")) for n, role in ((1, "cation"), (2, "anion"))]
    return nearest_bonds(*sides, "kind")


def wireframe(spark: SparkSession) -> DataFrame:
    """kind, axis, x1..z2: the 12 edges of each structure's cell. An edge starts at a corner whose axis is 0."""
    corner = F.array(F.lit(0.0), F.lit(1.0))
    corners = spark.range(1).select(F.explode(F.array(*map(F.lit, ("rocksalt", "zincblende", "diamond", "wurtzite")))).alias("kind"))
    for axis in ("fx", "fy", "fz"):
        corners = corners.withColumn(axis, F.explode(corner))
    starts = corners.withColumn("axis", F.explode(F.array(*map(F.lit, range(3))))).filter(F.get(F.array("fx", "fy", "fz"), F.col("axis")) == 0.0)
    first = to_cartesian(F.col("fx"), F.col("fy"), F.col("fz"), F.col("kind"))
    ends = [F.when(F.col("axis") == k, 1.0).otherwise(F.col(f)) for k, f in enumerate(("fx", "fy", "fz"))]
    last = to_cartesian(*ends, F.col("kind"))
    return starts.select("kind", "axis", *(c.alias(f"{a}{n}") for n, side in ((1, first), (2, last)) for c, a in zip(side, "xyz", strict=True)))


def centroids(edges: DataFrame, key: str = "kind") -> DataFrame:
    """The mean of all edge ends by key."""
    return edges.groupBy(key).agg(*((F.avg(F.col(f"{a}1") + F.col(f"{a}2")) / 2.0).alias(f"c{a}") for a in "xyz"))


def _cells(materials: DataFrame) -> DataFrame:
    kind = cell_kind(F.col("structure"))
    divisor = F.when(kind == "wurtzite", WURTZITE_DIVISOR).otherwise(CUBIC_DIVISOR)
    # diamond fills both sublattices from its cations
    anions = F.when(kind == "diamond", F.col("cations")).otherwise(F.col("anions"))
    return materials.select(F.col("id").alias("material_id"), kind.alias("kind"), "cations", anions.alias("anions"), (F.col("lattice_constant_ang") / divisor).alias("scale"))


def _atoms(materials: DataFrame, elements: DataFrame) -> DataFrame:
    met = _cells(materials).join(F.broadcast(kind_atoms(materials.sparkSession)), "kind")
    symbol = assigned_symbol(F.when(F.col("role") == "cation", F.col("cations")).otherwise(F.col("anions")), F.col("pos"), F.col("sites"))
    met = met.withColumn("symbol", symbol).join(F.broadcast(elements.select("symbol", "color")), "symbol", "left")
    return met.select("material_id", "kind", "role", "symbol", F.coalesce("color", F.lit(UNKNOWN_COLOR)).alias("color"), atom_radius(F.col("role")).alias("radius"), "x", "y", "z", "scale")


def atoms(materials: DataFrame, elements: DataFrame) -> DataFrame:
    """material_id, role, symbol, color, radius, x, y, z, scale. Unknown symbols get a grey.

    The structures' atoms (64 rows) and the elements are broadcast.
    """
    return _atoms(materials, elements).drop("kind")


def bonds(materials: DataFrame) -> DataFrame:
    return _cells(materials).join(F.broadcast(kind_bonds(materials.sparkSession)), "kind").select("material_id", "kind", *ENDS, "scale")


def cell_edges(materials: DataFrame) -> DataFrame:
    return _cells(materials).join(F.broadcast(wireframe(materials.sparkSession)), "kind").select("material_id", "kind", "axis", *ENDS, "scale")


def centred(df: DataFrame, *places: str) -> DataFrame:
    """The columns in `places`, each named by its axis first, moved to the middle of the cell of `kind` and scaled, as a
    viewer draws them; kind and scale are dropped."""
    met = df.join(F.broadcast(centroids(wireframe(df.sparkSession))), "kind")
    moved = [((F.col(c) - F.col(f"c{c[0]}")) * F.col("scale")).alias(c) if c in places else F.col(c) for c in df.columns if c not in ("kind", "scale")]
    return met.select(*moved)


def centred_atoms(materials: DataFrame, elements: DataFrame) -> DataFrame:
    return centred(_atoms(materials, elements), "x", "y", "z")


def centred_bonds(materials: DataFrame) -> DataFrame:
    return centred(bonds(materials), *ENDS)


def centred_edges(materials: DataFrame) -> DataFrame:
    return centred(cell_edges(materials), *ENDS)
