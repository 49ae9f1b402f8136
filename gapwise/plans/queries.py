"""The registered queries and their DuckDB SQL.

cat_* queries run on the embedded catalog, tbl_* queries run the same operators on the star-schema tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.functions import scalar as S
from gapwise.functions.exact import rounded_product
from gapwise.operators import alloy, crystal, features, metrics, predict
from gapwise.sources import catalog as C

from . import reports, scale_queries

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*((F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)) for f in df.schema))


def _catalog(report: Callable) -> Query:
    return lambda spark, _: rounded(report(spark))


# ---- the catalog as SQL ----


def _text(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, float):
        return f"{v!r}::DOUBLE"
    if isinstance(v, list):
        return "[" + ", ".join(f"{{'symbol': {_text(s)}, 'frac': {_text(f)}}}" for s, f in v) + "]"
    return str(v)


def _values(name: str, columns: str, rows) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(_text, r)) + ")" for r in rows) + ")"


MATERIALS_SQL = _values("materials", "ord, id, formula, display_name, cations, anions, structure, family, lattice_constant_ang, actual_eg_ev, note", [(i, *r) for i, r in enumerate(C.MATERIALS)])
ELEMENTS_SQL = _values("elements", "symbol, name, electronegativity, covalent_radius_pm, valence_electrons, period, color", C.ELEMENTS)
ALLOYS_SQL = _values("alloys", "id, label, endpoint_a, endpoint_b, bowing_ev, varying_sublattice, description", C.ALLOYS)
BIAS_SQL = _values("family_bias", "family, bias", C.FAMILY_BIAS)


def _fnv_sql(text: str) -> str:
    return f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({text}, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


def _unit_sql(text: str) -> str:
    return f"({_fnv_sql(text)} / 4294967295.0::DOUBLE * 2.0::DOUBLE - 1.0::DOUBLE)"


def _predicted_sql(source: str) -> str:
    return f"""predicted AS (
  SELECT m.*, b.bias,
    greatest(0.02::DOUBLE, actual_eg_ev * bias + {_unit_sql("id || ':baseline'")} * 0.08::DOUBLE * actual_eg_ev) AS baseline,
    greatest(0.02::DOUBLE, actual_eg_ev + {_unit_sql("id || ':corrected'")} * 0.09::DOUBLE * actual_eg_ev) AS corrected,
    abs(bias - 1.0::DOUBLE) * actual_eg_ev * 0.5::DOUBLE + 0.03::DOUBLE AS baseline_u,
    actual_eg_ev * 0.09::DOUBLE + 0.02::DOUBLE AS corrected_u
  FROM {source} m JOIN family_bias b USING (family))"""


def _axis_sql(eg: str) -> str:
    return f"(20.0::DOUBLE + (least(greatest(1239.84::DOUBLE / {eg}, 380.0::DOUBLE), 2600.0::DOUBLE) - 380.0::DOUBLE) / 2220.0::DOUBLE * 600.0::DOUBLE)"


def _ev_sql(v: str) -> str:
    return f"printf('%.2f eV', {v})"


def _track_sql(v: str) -> str:
    return f"(least(greatest({v}, 0.0::DOUBLE), 2.2::DOUBLE) / 2.2::DOUBLE * 100.0::DOUBLE)"


CLASS_SQL = "CASE WHEN {v} < 0.2 THEN 0 WHEN {v} < 0.5 THEN 1 WHEN {v} <= 1.5 THEN 2 WHEN {v} <= 1.8 THEN 3 ELSE 4 END"
METRICS_SQL = """round(avg(abs(p - a)), {d}) AS mae, round(sqrt(sum((p - a) * (p - a)) / count(*)), {d}) AS rmse,
  round(CASE WHEN count(*) >= 2 AND var_pop(a) > 0 THEN 1.0::DOUBLE - sum((p - a) * (p - a)) / (var_pop(a) * count(*)) END, {d}) AS r2, count(*)::BIGINT AS n"""

PANEL_SQL = f"""{_values("context", "class, context", enumerate(S.SENSING))}, long AS (
SELECT id, actual_eg_ev, 'baseline' AS model, baseline AS predicted, baseline_u AS uncertainty FROM predicted UNION ALL SELECT id, actual_eg_ev, 'corrected', corrected, corrected_u FROM predicted
), classed AS (SELECT *, predicted - uncertainty AS lo, predicted + uncertainty AS hi, {CLASS_SQL.format(v="actual_eg_ev")} AS class FROM long)
SELECT id, model, round(actual_eg_ev, 6) AS actual_eg_ev, round(predicted, 6) AS predicted, round(uncertainty, 6) AS uncertainty, round(lo, 6) AS lo, round(hi, 6) AS hi,
  round(abs(predicted - actual_eg_ev), 6) AS err_abs, round({_track_sql("predicted")}, 6) AS at_percent, round({_track_sql("lo")}, 6) AS lo_percent,
  round({_track_sql("hi")} - {_track_sql("lo")}, 6) AS band_percent, round(1239.84::DOUBLE / actual_eg_ev, 6) AS nm, actual_eg_ev BETWEEN 0.5 AND 1.5 AS in_window, class, context,
  {_ev_sql("actual_eg_ev")} AS actual_eg_ev_text, {_ev_sql("predicted")} AS predicted_text, {_ev_sql("uncertainty")} AS uncertainty_text, {_ev_sql("abs(predicted - actual_eg_ev)")} AS err_abs_text, printf('%.0f nm', 1239.84::DOUBLE / actual_eg_ev) AS nm_text
FROM classed JOIN context USING (class)"""

#: Two materials, and compositions as a slider gives them.
SELECTIONS = [("curated", "InP", "InGaAs", "0.47"), ("curated", "CdSe", "", ""), ("alloy", "InP", "InGaAs", "0.47"), ("alloy", "", "PbSSe", " 0.3"), ("alloy", "", "CdSeTe", "1"), ("curated", "none such", "", "")]
SELECTIONS_SQL = _values("selections", "mode, material_id, system, x_text", SELECTIONS)
VIRTUAL_SQL = """SELECT s.id || '-x' || printf('%.2f', x) AS id, s.label AS formula, s.label || ' (x = ' || printf('%.2f', x) || ')' AS display_name, a.structure, a.family,
  a.lattice_constant_ang * (1 - x) + b.lattice_constant_ang * x AS lattice_constant_ang, (1 - x) * a.actual_eg_ev + x * b.actual_eg_ev - s.bowing_ev * x * (1 - x) AS actual_eg_ev, s.description AS note,
  CASE WHEN varying_sublattice = 'cation' THEN [{'symbol': a.cations[1].symbol, 'frac': 1 - x}, {'symbol': b.cations[1].symbol, 'frac': x}] ELSE a.cations END AS cations,
  CASE WHEN varying_sublattice = 'anion' THEN [{'symbol': a.anions[1].symbol, 'frac': 1 - x}, {'symbol': b.anions[1].symbol, 'frac': x}] ELSE a.anions END AS anions
FROM alloys s JOIN materials a ON a.id = s.endpoint_a JOIN materials b ON b.id = s.endpoint_b"""
SELECTED_SQL = f"""chosen AS (
SELECT m.id, formula, display_name, structure, family, lattice_constant_ang, actual_eg_ev, note, cations, anions FROM selections JOIN materials m ON m.id = material_id WHERE mode = 'curated'
UNION ALL {VIRTUAL_SQL} JOIN (SELECT system, trim(x_text)::DOUBLE AS x FROM selections WHERE mode = 'alloy') q ON q.system = s.id)"""

# ---- catalog queries ----


def _predicted(spark: SparkSession) -> DataFrame:
    return predict.predictions(C.materials(spark), C.family_bias(spark))


def _gallery(spark):
    return reports.gallery(C.materials(spark), C.family_bias(spark))


def _report(spark):
    return reports.metrics_rows(C.materials(spark), C.family_bias(spark))


def _panel(spark):
    return reports.panel(C.materials(spark), C.family_bias(spark))


def _sweep(spark):
    return reports.alloy_sweep(C.alloys(spark), C.materials(spark), C.family_bias(spark), C.composition_grid(spark))


def _selected(spark):
    chosen = spark.createDataFrame(SELECTIONS, "mode string, material_id string, system string, x_text string")
    return reports.selected(chosen, C.materials(spark), C.alloys(spark))


def _virtual(spark):
    rows = alloy.virtual_materials(C.checked_alloys(C.alloys(spark)), C.checked_materials(C.materials(spark)), C.composition_grid(spark))
    return rows.select("id", "formula", "display_name", "structure", "family", "lattice_constant_ang", "actual_eg_ev", "note", S.exact_fixed(F.col("x"), 2).alias("x_text"))


def _virtual_parts(spark):
    rows = alloy.virtual_materials(C.alloys(spark), C.materials(spark), C.composition_grid(spark))
    return features.long_components(rows)


def _atom_counts(spark):
    return crystal.atoms(C.materials(spark), C.elements(spark)).groupBy("material_id", "role", "symbol", "color", "radius").agg(F.count(F.lit(1)).alias("atoms"), F.min("scale").alias("scale"))


def _bond_summary(spark):
    return crystal.bonds(C.materials(spark)).groupBy("material_id").agg(F.count(F.lit(1)).alias("bonds"), F.min(crystal.distance(("x1", "y1", "z1"), ("x2", "y2", "z2"))).alias("least"))


SITES_SQL = """sites AS (
  SELECT k.kind, r.role, fcc.pos, 4 AS sites, fcc.x + r.second * k.dx AS fx, fcc.y + r.second * k.dy AS fy, fcc.z + r.second * k.dz AS fz
  FROM (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), (1, 0.0, 0.5, 0.5), (2, 0.5, 0.0, 0.5), (3, 0.5, 0.5, 0.0)) fcc(pos, x, y, z),
    (VALUES ('rocksalt', 0.5::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), ('zincblende', 0.25, 0.25, 0.25), ('diamond', 0.25, 0.25, 0.25)) k(kind, dx, dy, dz),
    (VALUES ('cation', 0), ('anion', 1)) r(role, second)
  UNION ALL SELECT 'wurtzite', r.role, w.pos, 2, w.x, w.y, w.z + r.second * 0.375::DOUBLE
  FROM (VALUES (0, 1.0::DOUBLE / 3, 2.0::DOUBLE / 3, 0.0::DOUBLE), (1, 2.0::DOUBLE / 3, 1.0::DOUBLE / 3, 0.5::DOUBLE)) w(pos, x, y, z), (VALUES ('cation', 0), ('anion', 1)) r(role, second)
), images AS (
  SELECT kind, role, pos, sites, ix.v AS fx, iy.v AS fy, iz.v AS fz FROM sites,
    LATERAL (SELECT unnest(CASE WHEN abs(fx) < 1e-6 THEN [0.0::DOUBLE, 1.0::DOUBLE] ELSE [fx] END) AS v) ix,
    LATERAL (SELECT unnest(CASE WHEN abs(fy) < 1e-6 THEN [0.0::DOUBLE, 1.0::DOUBLE] ELSE [fy] END) AS v) iy,
    LATERAL (SELECT unnest(CASE WHEN abs(fz) < 1e-6 THEN [0.0::DOUBLE, 1.0::DOUBLE] ELSE [fz] END) AS v) iz
), points AS (
  SELECT kind, role, pos, sites, CASE WHEN kind = 'wurtzite' THEN fx - 0.5::DOUBLE * fy ELSE fx END AS x,
    CASE WHEN kind = 'wurtzite' THEN sqrt(3.0::DOUBLE) / 2 * fy ELSE fy END AS y, CASE WHEN kind = 'wurtzite' THEN 1.62::DOUBLE * fz ELSE fz END AS z FROM images
)"""

BONDS_SQL = """bonds AS (
SELECT c.kind, c.x AS x1, c.y AS y1, c.z AS z1, a.x AS x2, a.y AS y2, a.z AS z2, sqrt((c.x - a.x) * (c.x - a.x) + (c.y - a.y) * (c.y - a.y) + (c.z - a.z) * (c.z - a.z)) AS dist
FROM points c JOIN points a USING (kind) WHERE c.role = 'cation' AND a.role = 'anion' QUALIFY dist <= min(dist) OVER (PARTITION BY c.kind) * 1.06)"""
EDGES_SQL = """unit(v) AS (VALUES (0.0::DOUBLE), (1.0::DOUBLE)), starts AS (
SELECT kind, axis, a.v AS fx, b.v AS fy, c.v AS fz FROM (VALUES ('rocksalt'), ('zincblende'), ('diamond'), ('wurtzite')) k(kind), unit a, unit b, unit c, range(3) t(axis)
WHERE CASE axis WHEN 0 THEN a.v WHEN 1 THEN b.v ELSE c.v END = 0
), ends AS (SELECT *, CASE axis WHEN 0 THEN 1 ELSE fx END AS gx, CASE axis WHEN 1 THEN 1 ELSE fy END AS gy, CASE axis WHEN 2 THEN 1 ELSE fz END AS gz FROM starts
), edges AS (SELECT kind, axis::INTEGER AS axis, CASE kind WHEN 'wurtzite' THEN fx - 0.5::DOUBLE * fy ELSE fx END AS x1, CASE kind WHEN 'wurtzite' THEN sqrt(3.0::DOUBLE) / 2 * fy ELSE fy END AS y1, CASE kind WHEN 'wurtzite' THEN 1.62::DOUBLE * fz ELSE fz END AS z1,
  CASE kind WHEN 'wurtzite' THEN gx - 0.5::DOUBLE * gy ELSE gx END AS x2, CASE kind WHEN 'wurtzite' THEN sqrt(3.0::DOUBLE) / 2 * gy ELSE gy END AS y2, CASE kind WHEN 'wurtzite' THEN 1.62::DOUBLE * gz ELSE gz END AS z2 FROM ends)"""
CELLS_SQL = """cells AS (SELECT id AS material_id, structure AS kind, lattice_constant_ang / CASE structure WHEN 'wurtzite' THEN 4.3::DOUBLE ELSE 6.0::DOUBLE END AS scale FROM materials),
middles(kind, cx, cy, cz) AS (VALUES ('rocksalt', 0.5::DOUBLE, 0.5::DOUBLE, 0.5::DOUBLE), ('zincblende', 0.5, 0.5, 0.5), ('diamond', 0.5, 0.5, 0.5), ('wurtzite', 0.25, sqrt(3.0::DOUBLE) / 4, 0.81))"""
LEGEND_SQL = """parts AS (SELECT id, list_transform(cations || anions, lambda c: c.symbol) AS symbols FROM materials),
long AS (SELECT id, unnest(symbols) AS symbol, generate_subscripts(symbols, 1) AS k FROM parts), firsts AS (SELECT id, symbol, min(k) AS k FROM long GROUP BY ALL)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY k) - 1)::INTEGER AS pos, symbol, coalesce(name, symbol) AS name, coalesce(color, '#999') AS color FROM firsts LEFT JOIN elements USING (symbol)"""


def _moved_sql() -> str:
    return ", ".join(f"round(({a}{n} - c{a}) * scale, 6) AS {a}{n}" for n in (1, 2) for a in "xyz")


CATALOG: dict[str, tuple[Query, str]] = {
    "cat_materials": (
        _catalog(lambda s: C.materials(s).select("ord", "id", "formula", "display_name", "structure", "family", "lattice_constant_ang", "actual_eg_ev", "note")),
        f"WITH {MATERIALS_SQL} SELECT ord, id, formula, display_name, structure, family, lattice_constant_ang, actual_eg_ev, note FROM materials",
    ),
    "cat_elements": (_catalog(C.elements), f"WITH {ELEMENTS_SQL} SELECT * FROM elements"),
    "cat_alloys": (_catalog(C.alloys), f"WITH {ALLOYS_SQL} SELECT * FROM alloys"),
    "cat_family_bias": (_catalog(C.family_bias), f"WITH {BIAS_SQL} SELECT * FROM family_bias"),
    "cat_grid": (_catalog(C.composition_grid), "SELECT round(k / 100.0::DOUBLE, 6) AS x FROM range(101) t(k)"),
    "cat_material_by_id": (_catalog(lambda s: C.by_id(_predicted(s), "InP").select("id", "actual_eg_ev", "baseline", "corrected")), f"WITH {MATERIALS_SQL}, {BIAS_SQL}, {_predicted_sql('materials')} SELECT id, round(actual_eg_ev, 6) AS actual_eg_ev, round(baseline, 6) AS baseline, round(corrected, 6) AS corrected FROM predicted WHERE id = 'InP'"),
    "cat_gallery": (
        _catalog(_gallery),
        f"""WITH {MATERIALS_SQL}, {BIAS_SQL}, {_predicted_sql("materials")}
SELECT id, formula, structure, family, round(actual_eg_ev, 6) AS actual_eg_ev, round(baseline, 6) AS baseline, round(corrected, 6) AS corrected,
  round({_axis_sql("actual_eg_ev")}, 6) AS x_act, round({_axis_sql("baseline")}, 6) AS x_base, round({_axis_sql("corrected")}, 6) AS x_corr,
  {_ev_sql("actual_eg_ev")} AS actual_text, {_ev_sql("baseline")} AS baseline_text, {_ev_sql("corrected")} AS corrected_text FROM predicted""",
    ),
    "cat_markers": (
        _catalog(lambda s: reports.markers(_predicted(s))),
        f"""WITH {MATERIALS_SQL}, {BIAS_SQL}, {_predicted_sql("materials")}, long AS (
SELECT id, 'act' AS marker, actual_eg_ev AS eg FROM predicted UNION ALL SELECT id, 'base', baseline FROM predicted UNION ALL SELECT id, 'corr', corrected FROM predicted)
SELECT id, marker, round(eg, 6) AS eg, round({_axis_sql("eg")}, 6) AS axis_x FROM long""",
    ),
    "cat_metrics": (
        _catalog(_report),
        f"""WITH {MATERIALS_SQL}, {BIAS_SQL}, {_predicted_sql("materials")}, long AS (
SELECT 'baseline' AS model, family, actual_eg_ev AS a, baseline AS p FROM predicted UNION ALL SELECT 'corrected', family, actual_eg_ev, corrected FROM predicted), found AS (
SELECT model, coalesce(family, 'overall') AS grp, {METRICS_SQL.format(d=12)} FROM long GROUP BY GROUPING SETS ((model), (model, family)))
SELECT model, grp, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 6) AS r2, n, printf('%.3f', mae) AS mae_text, printf('%.3f', rmse) AS rmse_text, coalesce(printf('%.2f', r2), 'n/a') AS r2_text, coalesce(r2 < 0, false) AS r2_negative FROM found""",
    ),
    "cat_scatter": (
        _catalog(lambda s: reports.scatter(C.materials(s), C.family_bias(s))),
        f"""WITH {MATERIALS_SQL}, {BIAS_SQL}, {_predicted_sql("materials")}, long AS (
SELECT id, 'baseline' AS model, actual_eg_ev AS a, baseline AS p FROM predicted UNION ALL SELECT id, 'corrected', actual_eg_ev, corrected FROM predicted)
SELECT id, model, round(34 + a / 1.9::DOUBLE * 249, 6) AS cx, round(300 - (34 + p / 1.9::DOUBLE * 249), 6) AS cy FROM long""",
    ),
    "cat_panel": (
        _catalog(_panel),
        f"""WITH {MATERIALS_SQL}, {BIAS_SQL}, {_predicted_sql("materials")}, {PANEL_SQL}""",
    ),
    "cat_features": (
        _catalog(lambda s: features.composition_features(C.materials(s), C.elements(s))),
        f"""WITH {MATERIALS_SQL}, {ELEMENTS_SQL}, parts AS (
SELECT id, 'cation' AS role, unnest(cations, recursive := true) FROM materials UNION ALL SELECT id, 'anion', unnest(anions, recursive := true) FROM materials
), met AS (SELECT * FROM parts JOIN elements USING (symbol))
SELECT id, round(abs(sum(electronegativity * frac) FILTER (role = 'anion') / sum(frac) FILTER (role = 'anion') - sum(electronegativity * frac) FILTER (role = 'cation') / sum(frac) FILTER (role = 'cation')), 6) AS en_difference,
  round(sum(valence_electrons * frac) / sum(frac), 6) AS mean_valence, round(sum(period * frac) / sum(frac), 6) AS mean_period, round(sum(covalent_radius_pm * frac) / sum(frac), 6) AS mean_radius_pm
FROM met GROUP BY id""",
    ),
    "cat_alloy_sweep": (
        _catalog(_sweep),
        f"""WITH {MATERIALS_SQL}, {BIAS_SQL}, {ALLOYS_SQL}, grid AS (SELECT k / 100.0::DOUBLE AS x FROM range(101) t(k)), virtual AS (
SELECT s.id AS system, x, s.id || '-x' || printf('%.2f', x) AS id, a.structure, a.family, a.lattice_constant_ang * (1 - x) + b.lattice_constant_ang * x AS lattice_constant_ang,
  (1 - x) * a.actual_eg_ev + x * b.actual_eg_ev - s.bowing_ev * x * (1 - x) AS actual_eg_ev
FROM alloys s JOIN materials a ON a.id = s.endpoint_a JOIN materials b ON b.id = s.endpoint_b, grid), {_predicted_sql("virtual")}
SELECT system, round(x, 6) AS x, id, structure, family, round(lattice_constant_ang, 6) AS lattice_constant_ang, round(actual_eg_ev, 6) AS actual_eg_ev, round(baseline, 6) AS baseline, round(corrected, 6) AS corrected,
  actual_eg_ev BETWEEN 0.5 AND 1.5 AS in_window FROM predicted""",
    ),
    "cat_alloy_components": (
        _catalog(_virtual_parts),
        f"""WITH {MATERIALS_SQL}, {ALLOYS_SQL}, grid AS (SELECT k / 100.0::DOUBLE AS x FROM range(101) t(k)), virtual AS (
SELECT s.id || '-x' || printf('%.2f', x) AS id, CASE WHEN varying_sublattice = 'cation' THEN [{{'symbol': a.cations[1].symbol, 'frac': 1 - x}}, {{'symbol': b.cations[1].symbol, 'frac': x}}] ELSE a.cations END AS cations,
  CASE WHEN varying_sublattice = 'anion' THEN [{{'symbol': a.anions[1].symbol, 'frac': 1 - x}}, {{'symbol': b.anions[1].symbol, 'frac': x}}] ELSE a.anions END AS anions
FROM alloys s JOIN materials a ON a.id = s.endpoint_a JOIN materials b ON b.id = s.endpoint_b, grid), parts AS (
SELECT id, 'cation' AS role, unnest(cations, recursive := true) FROM virtual UNION ALL SELECT id, 'anion', unnest(anions, recursive := true) FROM virtual)
SELECT id, role, symbol, round(frac, 6) AS frac FROM parts""",
    ),
    "cat_images": (
        _catalog(lambda s: crystal.kind_atoms(s).drop("sites")),
        f"WITH {SITES_SQL} SELECT kind, role, pos, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM points",
    ),
    "cat_bonds": (
        _catalog(crystal.kind_bonds),
        f"""WITH {SITES_SQL}, {BONDS_SQL}
SELECT kind, round(x1, 6) AS x1, round(y1, 6) AS y1, round(z1, 6) AS z1, round(x2, 6) AS x2, round(y2, 6) AS y2, round(z2, 6) AS z2, round(dist, 6) AS dist FROM bonds""",
    ),
    "cat_edges": (
        _catalog(crystal.wireframe),
        f"WITH {EDGES_SQL} SELECT kind, axis, round(x1, 6) AS x1, round(y1, 6) AS y1, round(z1, 6) AS z1, round(x2, 6) AS x2, round(y2, 6) AS y2, round(z2, 6) AS z2 FROM edges",
    ),
    "cat_unit_cells": (
        _catalog(lambda s: crystal.centred_atoms(C.materials(s), C.elements(s))),
        f"""WITH {MATERIALS_SQL}, {ELEMENTS_SQL}, {SITES_SQL}, cells AS (
SELECT id AS material_id, structure AS kind, cations, CASE WHEN structure = 'diamond' THEN cations ELSE anions END AS anions, lattice_constant_ang / CASE structure WHEN 'wurtzite' THEN 4.3::DOUBLE ELSE 6.0::DOUBLE END AS scale FROM materials
), placed AS (SELECT *, CASE role WHEN 'cation' THEN cations ELSE anions END AS parts FROM cells JOIN points USING (kind)), named AS (
SELECT *, CASE WHEN len(parts) = 1 OR pos < sites - round(sites * parts[2].frac) THEN parts[1].symbol ELSE parts[2].symbol END AS symbol FROM placed)
SELECT material_id, role, symbol, coalesce(color, '#999999') AS color, CASE role WHEN 'cation' THEN 0.085::DOUBLE ELSE 0.065::DOUBLE END AS radius,
  round((x - CASE kind WHEN 'wurtzite' THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END) * scale, 6) AS x, round((y - CASE kind WHEN 'wurtzite' THEN sqrt(3.0::DOUBLE) / 4 ELSE 0.5::DOUBLE END) * scale, 6) AS y, round((z - CASE kind WHEN 'wurtzite' THEN 0.81::DOUBLE ELSE 0.5::DOUBLE END) * scale, 6) AS z
FROM named LEFT JOIN elements USING (symbol)""",
    ),
    "cat_cell_bonds": (
        _catalog(lambda s: reports.unit_cell(C.materials(s), C.elements(s))["bonds"]),
        f"""WITH {MATERIALS_SQL}, {SITES_SQL}, {BONDS_SQL}, {CELLS_SQL}
SELECT material_id, {_moved_sql()} FROM cells JOIN bonds USING (kind) JOIN middles USING (kind)""",
    ),
    "cat_cell_edges": (
        _catalog(lambda s: reports.unit_cell(C.materials(s), C.elements(s))["cell_edges"]),
        f"""WITH {MATERIALS_SQL}, {EDGES_SQL}, {CELLS_SQL}
SELECT material_id, axis, {_moved_sql()} FROM cells JOIN edges USING (kind) JOIN middles USING (kind)""",
    ),
    "cat_selected_panel": (
        _catalog(lambda s: reports.panel(_selected(s), C.family_bias(s))),
        f"""WITH {MATERIALS_SQL}, {BIAS_SQL}, {ALLOYS_SQL}, {SELECTIONS_SQL}, {SELECTED_SQL}, {_predicted_sql("chosen")}, {PANEL_SQL}""",
    ),
    "cat_selected_legend": (
        _catalog(lambda s: reports.legend(_selected(s), C.elements(s))),
        f"""WITH {MATERIALS_SQL}, {ELEMENTS_SQL}, {ALLOYS_SQL}, {SELECTIONS_SQL}, {SELECTED_SQL}, {LEGEND_SQL.replace("FROM materials", "FROM chosen")}""",
    ),
    "cat_selected_structure": (
        _catalog(lambda s: reports.structure_lines(_selected(s))),
        f"""WITH {MATERIALS_SQL}, {ALLOYS_SQL}, {SELECTIONS_SQL}, {SELECTED_SQL} SELECT id, structure, family, 'a ≈ ' || printf('%.2f', lattice_constant_ang) || ' Å' AS lattice_text FROM chosen""",
    ),
    "cat_virtual_materials": (
        _catalog(_virtual),
        f"""WITH {MATERIALS_SQL}, {ALLOYS_SQL}, grid AS (SELECT k / 100.0::DOUBLE AS x FROM range(101) t(k)), virtual AS (SELECT x, v.* FROM ({VIRTUAL_SQL.replace("SELECT s.id", "SELECT x, s.id", 1)}, grid) v)
SELECT id, formula, display_name, structure, family, round(lattice_constant_ang, 6) AS lattice_constant_ang, round(actual_eg_ev, 6) AS actual_eg_ev, note, printf('%.2f', x) AS x_text FROM virtual""".replace("SELECT x, v.* FROM (", "SELECT v.* FROM ("),
    ),
    "cat_alloy_by_id": (
        _catalog(lambda s: C.by_id(C.alloys(s), "PbSSe")),
        f"WITH {ALLOYS_SQL} SELECT * FROM alloys WHERE id = 'PbSSe'",
    ),
    "cat_bond_summary": (
        _catalog(_bond_summary),
        f"""WITH {MATERIALS_SQL}, {SITES_SQL}, {BONDS_SQL}, counted AS (SELECT kind, count(*)::BIGINT AS bonds, min(dist) AS least FROM bonds GROUP BY kind)
SELECT id AS material_id, bonds, round(least, 6) AS least FROM materials JOIN counted ON kind = structure""",
    ),
    "cat_legend": (
        _catalog(lambda s: reports.legend(C.materials(s), C.elements(s))),
        f"WITH {MATERIALS_SQL}, {ELEMENTS_SQL}, {LEGEND_SQL}",
    ),
    "cat_axis": (
        _catalog(lambda s: s.range(1).select(*(c.alias(n) for n, c in S.axis_marks().items()))),
        f"SELECT round({_axis_sql('(1239.84::DOUBLE / 700)')}, 6) AS visible_end, round({_axis_sql('1.5::DOUBLE')}, 6) AS target_start, round({_axis_sql('0.5::DOUBLE')}, 6) AS target_end",
    ),
}

# ---- table queries: the same operators at scale ----


def tbl_regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overall and by-group metrics of quantity x retail price as an estimate of the extended price."""
    lines = _table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag")
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    met = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).withColumn("predicted", F.col("l_quantity") * F.col("p_retailprice"))
    report = metrics.metrics_report(met, "l_extendedprice", {"retail": "predicted"}, "l_returnflag", "l_orderkey")
    return rounded(report.select("model", F.coalesce("grp", F.lit("overall")).alias("grp"), "mae", "rmse", "r2", "n"), 4)


def tbl_fnv_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select("c_custkey", S.fnv1a(F.col("c_name")).alias("h"), F.round(S.seeded_unit(F.col("c_name")), 9).alias("u"))


def tbl_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    met = lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
    return rounded(met.groupBy("l_suppkey").agg(features.weighted_mean(F.col("p_retailprice"), F.col("l_quantity")).alias("mean_price")), 4)


def _gap(column: str):
    # classes are bounded by exact tenths
    return F.round(F.col(column) * 20.0, 6)


def tbl_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").groupBy(S.sensing_class(_gap("l_discount")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def tbl_window_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").filter(S.in_target_window(_gap("l_discount"))).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def tbl_clamp_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return rounded(_table(spark, sf_dir, "events").select("event_id", S.axis_x(v).alias("axis_x"), S.track_percent(v / 100.0).alias("percent"), S.scatter_scale(v).alias("cx"), S.scatter_y(v).alias("cy")))


def tbl_ev_to_nm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", rounded_product(S.ev_to_nm(F.col("value")), 4).alias("nm"))


def tbl_bowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as an alloy system: its whole composition grid, reduced to the least gap and the points in the window."""
    parts = _table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 1000.0).alias("a"), (F.col("p_size") / 25.0).alias("b"))
    x = F.sequence(F.lit(0), F.lit(100))
    eg = parts.select("p_partkey", F.transform(x, lambda k: F.round(alloy.eg_at(F.col("a"), F.col("b"), F.lit(0.3), k / 100.0), 9)).alias("eg"))
    return rounded(eg.select("p_partkey", F.array_min("eg").alias("least_eg"), F.size(F.filter("eg", S.in_target_window)).cast("long").alias("in_window")))


def tbl_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    band = predict.interval(price, price * 0.05, F.lit(150000.0))
    return rounded(_table(spark, sf_dir, "orders").select("o_orderkey", *(c.alias(n) for n, c in band.items())), 4)


def tbl_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr("stack(3, 'quantity', l_quantity, 'price', l_extendedprice, 'tax', l_tax) as (measure, amount)"))


def tbl_nearest_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a cell: its odd and even lines as sites, bonds up to 1.06 times the order's least distance."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100).alias("z"))
    sides = [lines.filter(F.col("l_linenumber") % 2 == odd).select("l_orderkey", F.col("l_linenumber").alias(f"line{n}"), *(F.col(a).alias(f"{a}{n}") for a in "xyz")) for n, odd in ((1, 1), (2, 0))]
    return rounded(crystal.nearest_bonds(*sides, "l_orderkey").select("l_orderkey", "line1", "line2", "dist"))


def tbl_distinct_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.distinct_in_order(_table(spark, sf_dir, "events"), "event_type", "event_id")


def tbl_last_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index by key of a table with repeated keys: the last order of each customer."""
    return C.last_of_each(_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")


TABLES: dict[str, tuple[Query, str | None]] = {
    "tbl_regression_metrics": (
        tbl_regression_metrics,
        f"""WITH met AS (SELECT l_returnflag, l_extendedprice AS a, l_quantity * p_retailprice AS p FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT 'retail' AS model, coalesce(l_returnflag, 'overall') AS grp, {METRICS_SQL.format(d=4)} FROM met GROUP BY GROUPING SETS ((), (l_returnflag))""",
    ),
    "tbl_fnv_unit": (tbl_fnv_unit, f"SELECT c_custkey, {_fnv_sql('c_name')}::BIGINT AS h, round({_unit_sql('c_name')}, 9) AS u FROM customer"),
    "tbl_weighted_mean": (tbl_weighted_mean, "SELECT l_suppkey, round(sum(p_retailprice * l_quantity) / sum(l_quantity), 4) AS mean_price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey"),
    "tbl_classify": (tbl_classify, f"SELECT {CLASS_SQL.format(v='round(l_discount * 20, 6)')}::INTEGER AS class, count(*)::BIGINT AS n FROM lineitem GROUP BY 1"),
    "tbl_window_predicate": (tbl_window_predicate, "SELECT l_returnflag, count(*)::BIGINT AS n FROM lineitem WHERE round(l_discount * 20, 6) BETWEEN 0.5 AND 1.5 GROUP BY 1"),
    "tbl_clamp_scale": (tbl_clamp_scale, f"SELECT event_id, round(20.0::DOUBLE + (least(greatest(value, 380.0::DOUBLE), 2600.0::DOUBLE) - 380) / 2220.0::DOUBLE * 600, 6) AS axis_x, round({_track_sql('value / 100.0::DOUBLE')}, 6) AS percent, round(34 + value / 1.9::DOUBLE * 249, 6) AS cx, round(300 - (34 + value / 1.9::DOUBLE * 249), 6) AS cy FROM events"),
    "tbl_ev_to_nm": (tbl_ev_to_nm, "SELECT event_id, round(1239.84::DOUBLE / value, 4) AS nm FROM events"),
    "tbl_bowing": (
        tbl_bowing,
        """WITH rows AS (SELECT p_partkey, round((1 - x) * (p_retailprice / 1000.0::DOUBLE) + x * (p_size / 25.0::DOUBLE) - 0.3::DOUBLE * x * (1 - x), 9) AS eg FROM part, (SELECT k / 100.0::DOUBLE AS x FROM range(101) t(k)))
SELECT p_partkey, round(min(eg), 6) AS least_eg, count(*) FILTER (eg BETWEEN 0.5 AND 1.5)::BIGINT AS in_window FROM rows GROUP BY 1""",
    ),
    "tbl_interval": (tbl_interval, "SELECT o_orderkey, round(o_totalprice - o_totalprice * 0.05::DOUBLE, 4) AS lo, round(o_totalprice + o_totalprice * 0.05::DOUBLE, 4) AS hi, round(abs(o_totalprice - 150000.0::DOUBLE), 4) AS err_abs FROM orders"),
    "tbl_unpivot": (tbl_unpivot, "SELECT l_orderkey, l_linenumber, 'quantity' AS measure, l_quantity AS amount FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'price', l_extendedprice FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'tax', l_tax FROM lineitem"),
    "tbl_nearest_cutoff": (
        tbl_nearest_cutoff,
        """WITH p AS (SELECT l_orderkey, l_linenumber AS line, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 AS z FROM lineitem), pairs AS (
SELECT a.l_orderkey, a.line AS line1, b.line AS line2, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS dist
FROM p a JOIN p b USING (l_orderkey) WHERE a.line % 2 = 1 AND b.line % 2 = 0)
SELECT l_orderkey, line1, line2, round(dist, 6) AS dist FROM pairs QUALIFY dist <= min(dist) OVER (PARTITION BY l_orderkey) * 1.06""",
    ),
    "tbl_distinct_first": (tbl_distinct_first, "SELECT event_type, min(event_id) AS first_ord FROM events GROUP BY 1"),
    "tbl_last_index": (tbl_last_index, "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1"),
}

TABLES |= scale_queries.QUERIES


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in (CATALOG | TABLES).items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in (CATALOG | TABLES).items() if sql is not None}
