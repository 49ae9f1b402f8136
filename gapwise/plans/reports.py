"""Composite queries over material rows; each takes DataFrames and returns one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.functions import scalar as S
from gapwise.operators import alloy, crystal, metrics, predict


def markers(predicted: DataFrame) -> DataFrame:
    """A row for each of the actual, baseline and corrected gap, with its place on the wavelength axis."""
    long = predicted.select("id", F.expr("stack(3, 'act', actual_eg_ev, 'base', baseline, 'corr', corrected) as (marker, eg)"))
    return long.withColumn("axis_x", S.axis_x(S.ev_to_nm(F.col("eg"))))


def gallery(materials: DataFrame, bias: DataFrame) -> DataFrame:
    p = predict.predictions(materials, bias)
    places = [S.axis_x(S.ev_to_nm(F.col(c))).alias(n) for c, n in (("actual_eg_ev", "x_act"), ("baseline", "x_base"), ("corrected", "x_corr"))]
    return p.select("id", "formula", "structure", "family", "actual_eg_ev", "baseline", "corrected", *places, *(S.ev_text(F.col(c)).alias(f"{n}_text") for c, n in (("actual_eg_ev", "actual"), ("baseline", "baseline"), ("corrected", "corrected"))))


def metrics_rows(materials: DataFrame, bias: DataFrame) -> DataFrame:
    report = metrics.metrics_report(predict.predictions(materials, bias), "actual_eg_ev", {"baseline": "baseline", "corrected": "corrected"}, "family", "ord")
    r2 = F.col("r2")
    return report.select("model", F.coalesce("grp", F.lit("overall")).alias("grp"), "mae", "rmse", "r2", "n", S.exact_fixed(F.col("mae"), 3).alias("mae_text"), S.exact_fixed(F.col("rmse"), 3).alias("rmse_text"), S.r2_text(r2).alias("r2_text"), S.is_negative(r2).alias("r2_negative"))


def scatter(materials: DataFrame, bias: DataFrame) -> DataFrame:
    p = predict.predictions(materials, bias).select("id", "actual_eg_ev", F.expr("stack(2, 'baseline', baseline, 'corrected', corrected) as (model, predicted)"))
    return p.select("id", "model", S.scatter_scale(F.col("actual_eg_ev")).alias("cx"), S.scatter_y(F.col("predicted")).alias("cy"))


def panel(materials: DataFrame, bias: DataFrame) -> DataFrame:
    """For each material and model: prediction, error interval, places on the track, wavelength and class."""
    p = predict.predictions(materials, bias)
    long = p.select("id", "actual_eg_ev", F.expr("stack(2, 'baseline', baseline, baseline_u, 'corrected', corrected, corrected_u) as (model, predicted, uncertainty)"))
    band = predict.interval(F.col("predicted"), F.col("uncertainty"), F.col("actual_eg_ev"))
    long = long.select("*", *(c.alias(n) for n, c in band.items()))
    eg = F.col("actual_eg_ev")
    return long.select(
        "id", "model", "actual_eg_ev", "predicted", "uncertainty", "lo", "hi", "err_abs",
        *(S.ev_text(F.col(c)).alias(f"{c}_text") for c in ("actual_eg_ev", "predicted", "uncertainty", "err_abs")),
        S.track_percent(F.col("predicted")).alias("at_percent"), S.track_percent(F.col("lo")).alias("lo_percent"), S.band_percent(F.col("lo"), F.col("hi")).alias("band_percent"),
        S.ev_to_nm(eg).alias("nm"), S.nm_text(S.ev_to_nm(eg)).alias("nm_text"), S.in_target_window(eg).alias("in_window"), S.sensing_class(eg).alias("class"), S.sensing_context(eg).alias("context"),
    )


def alloy_sweep(alloys: DataFrame, materials: DataFrame, bias: DataFrame, grid: DataFrame) -> DataFrame:
    rows = predict.predictions(alloy.virtual_materials(alloys, materials, grid), bias)
    return rows.select("system", "x", "id", "structure", "family", "lattice_constant_ang", "actual_eg_ev", "baseline", "corrected", S.in_target_window(F.col("actual_eg_ev")).alias("in_window"))


def unit_cell(materials: DataFrame, elements: DataFrame) -> dict[str, DataFrame]:
    """Atoms, bonds and edges of each material's cell, all in the viewer's frame."""
    return {"atoms": crystal.centred_atoms(materials, elements), "bonds": crystal.centred_bonds(materials), "cell_edges": crystal.centred_edges(materials)}


def selected(selections: DataFrame, materials: DataFrame, alloys: DataFrame) -> DataFrame:
    """Material rows by selections (mode, material_id, system, x_text): "curated" looks the material up, any other mode
    makes the virtual row of the system at x. A selection of an unknown material or system has no row."""
    columns = [c for c in materials.columns if c != "ord"]
    curated = selections.filter("mode = 'curated'").select(F.col("material_id").alias("id")).join(materials, "id").select(*columns)
    requests = selections.filter("mode <> 'curated'").select("system", S.parse_number(F.col("x_text")).alias("x"))
    return curated.unionByName(alloy.virtual_at(requests, alloys, materials).select(*columns))


def structure_lines(materials: DataFrame) -> DataFrame:
    """What stands below a cell: structure, family and lattice constant."""
    return materials.select("id", "structure", "family", S.angstrom_text(F.col("lattice_constant_ang")).alias("lattice_text"))


def composition_lines(virtual: DataFrame) -> DataFrame:
    """The label of each composition."""
    return virtual.select("id", F.concat(F.lit("Composition x = "), S.exact_fixed(F.col("x"), 2)).alias("x_text"))


def legend(materials: DataFrame, elements: DataFrame) -> DataFrame:
    """Symbols of each material in order of appearance, cations first; fraction 0 counts. Unknown ones keep their symbol as name."""
    parts = materials.select("id", F.posexplode(F.array_distinct(F.transform(F.concat("cations", "anions"), lambda c: c["symbol"]))).alias("pos", "symbol"))
    met = parts.join(F.broadcast(elements.select("symbol", "name", "color")), "symbol", "left")
    return met.select("id", "pos", "symbol", F.coalesce("name", "symbol").alias("name"), F.coalesce("color", F.lit("#999")).alias("color"))
