"""Derived values, traps and invariants of the catalog operators."""

import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gapwise.functions import scalar as S
from gapwise.operators import alloy, crystal, features, metrics, predict
from gapwise.plans import reports
from gapwise.sources import catalog as C


ROOT = Path(__file__).resolve().parents[1]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.fixture(scope="module")
def predicted(spark):
    return predict.predictions(C.materials(spark), C.family_bias(spark))


def test_seed_hash(spark):
    assert one(spark, S.fnv1a(F.lit("a"))) == 0xE40C292C
    assert one(spark, S.fnv1a(F.lit(""))) == 2166136261
    assert one(spark, S.seeded_unit(F.lit("PbS:baseline"))) == 0.9257537415078267
    h = 2166136261
    for unit in (0xD83D, 0xDE00):  # a character outside the BMP is two units
        h = ((h ^ unit) * 16777619) & 0xFFFFFFFF
    assert one(spark, S.fnv1a(F.lit("😀"))) == h


def test_predictions(predicted):
    got = {r.id: r for r in predicted.collect()}
    for id_, base, corr, ub, uc in [("PbS", 1.096365, 0.441286, 0.358, 0.0569), ("InSb", 0.158681, 0.182079, 0.0368, 0.0353), ("CdSe", 1.47104, 1.587918, 0.117, 0.1766), ("Ge", 0.575448, 0.660238, 0.0702, 0.0803)]:
        r = got[id_]
        assert (r.baseline, r.corrected, r.baseline_u, r.corrected_u) == pytest.approx((base, corr, ub, uc), abs=1e-6)
    assert all(r.baseline >= 0.02 and r.corrected >= 0.02 for r in got.values())


def test_unknown_family_is_not_a_number(spark):
    odd = C.materials(spark).limit(1).withColumn("family", F.lit("none such"))
    assert math.isnan(predict.predictions(odd, C.family_bias(spark)).first().baseline)


def test_metrics_report(spark):
    got = [(r.model, r.grp, r.mae, r.rmse, r.r2, r.n) for r in reports.metrics_rows(C.materials(spark), C.family_bias(spark)).collect()]
    assert [g[:2] for g in got[:3]] == [("baseline", "overall"), ("corrected", "overall"), ("baseline", "IV-VI rocksalt (Pb-chalcogenide)")]
    assert got[0][2:] == pytest.approx((0.197288333, 0.282076992, 0.708570902, 14), abs=1e-8)
    assert got[1][2:] == pytest.approx((0.042309597, 0.062405618, 0.985735881, 14), abs=1e-8)
    assert got[2][2:] == pytest.approx((0.547195623, 0.557578680, -91.650525295, 3), abs=1e-6)
    assert sum(g[4] is None for g in got) == 6 and len(got) == 14
    for model in ("baseline", "corrected"):
        groups = [g for g in got if g[0] == model and g[1] != "overall"]
        overall = next(g for g in got if g[:2] == (model, "overall"))
        assert sum(g[2] * g[5] for g in groups) / 14 == pytest.approx(overall[2])
    assert all(g[3] >= g[2] - 1e-12 for g in got)


def test_metrics_edges(spark):
    df = spark.createDataFrame([(0.1, 1.0)] * 3, "a double, p double")
    r = metrics.compute_metrics(df, F.col("a"), F.col("p")).first()
    assert r.r2 is None and r.n == 3
    r = metrics.compute_metrics(df.limit(0), F.col("a"), F.col("p")).first()
    assert (r.mae, r.rmse, r.r2, r.n) == (None, None, None, 0)


def test_partitions_do_not_matter(spark, predicted):
    def run(n):
        return sorted((r.model, r.grp or "", round(r.mae, 9)) for r in metrics.metrics_report(predicted.repartition(n), "actual_eg_ev", {"b": "baseline"}, "family", "ord").collect())

    assert run(1) == run(8)


def test_class_bounds(spark):
    values = [0.19, 0.2, 0.49, 0.5, 1.5, 1.51, 1.8, 1.81, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select(S.sensing_class(F.col("v")).alias("c"), S.in_target_window(F.col("v")).alias("w"), S.sensing_context(F.col("v")).alias("t")).collect()
    assert [r.c for r in rows] == [0, 1, 1, 2, 2, 3, 3, 4, None]
    assert [r.w for r in rows] == [False, False, False, True, True, False, False, False, None]
    assert rows[3].t == S.SENSING[2]


def test_scales(spark):
    assert one(spark, S.ev_to_nm(F.lit(0.0))) == math.inf
    assert one(spark, S.track_percent(F.lit(-1.0))) == 0 and one(spark, S.track_percent(F.lit(9.0))) == 100
    assert one(spark, S.axis_x(F.lit(1.0))) == 20 and one(spark, S.axis_x(F.lit(9e9))) == 620
    assert one(spark, S.scatter_scale(F.lit(3.8))) == 34 + 2 * 249


def test_number_texts(spark):
    assert one(spark, S.exact_fixed(F.lit(1.005), 2)) == "1.00" and one(spark, S.exact_fixed(F.lit(0.125), 2)) == "0.13"
    assert one(spark, S.ev_text(F.lit(0.5))) == "0.50 eV" and one(spark, S.nm_text(F.lit(826.56))) == "827 nm"
    assert one(spark, S.r2_text(F.lit(None).cast("double"))) == "n/a" and one(spark, S.r2_text(F.lit(-91.65))) == "-91.65"


def test_texts_of_odd_numbers(spark):
    values = [math.inf, -math.inf, math.nan, None, 1e20, 1e21, -2.5e25, 0.0, -0.0, -0.001, 2.5, -2.5, 0.5, 1e-320]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double").repartition(2)
    got = [r.t for r in df.select("k", S.exact_fixed(F.col("v"), 0).alias("t")).orderBy("k").collect()]
    assert got == ["Infinity", "-Infinity", "NaN", None, "100000000000000000000", "1e+21", "-2.5e+25", "0", "0", "-0", "3", "-3", "1", "0"]
    assert one(spark, S.nm_text(S.ev_to_nm(F.lit(0.0)))) == "Infinity nm"
    assert one(spark, S.angstrom_text(F.lit(5.869))) == "a ≈ 5.87 Å"


def test_parsed_numbers(spark):
    texts = ["0.47", " 1", ".5", "3.", "-2e-1x", "1e", "", "x1", None, "Infinity", "1e999", "0x10"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.v for r in df.select("k", S.parse_number(F.col("t")).alias("v")).orderBy("k").collect()]
    assert [None if v is None else "nan" if v != v else v for v in got] == [0.47, 1.0, 0.5, 3.0, -0.2, 1.0, "nan", "nan", None, math.inf, math.inf, 0.0]


def fixture_table(heading):
    """Rows of the first table below a heading of FIXTURES.md, which was written apart from the catalog."""
    lines = (ROOT / "FIXTURES.md").read_text(encoding="utf-8").split(heading, 1)[1].splitlines()
    rows = []
    for line in lines:
        if line.startswith("|"):
            rows.append([c.strip() for c in line.strip("|").split("|")])
        elif rows:
            break
    return rows[2:]


def fixture_rows_of_cells():
    text = (ROOT / "FIXTURES.md").read_text(encoding="utf-8").split("| structure | cation atoms", 1)[1]
    return [[c.strip() for c in line.strip("|").split("|")] for line in text.splitlines()[2:5]]


def test_catalog_against_fixtures(spark):
    def components(text):
        return [(p.split(":")[0].strip(), float(p.split(":")[1])) for p in text.split(",")]

    got = [(str(r.ord), r.id, [tuple(c) for c in r.cations], [tuple(c) for c in r.anions], r.structure, r.family, r.lattice_constant_ang, r.actual_eg_ev) for r in C.materials(spark).orderBy("ord").collect()]
    assert got == [(o, i, components(c), components(a), s, f, float(x), float(e)) for o, i, c, a, s, f, x, e, _ in fixture_table("### A1.")]
    got = [(r.symbol, r.name, r.electronegativity, r.covalent_radius_pm, r.valence_electrons, r.period) for r in C.elements(spark).collect()]
    assert sorted(got) == sorted((s, n, float(e), int(r), int(v), int(p)) for s, n, e, r, v, p in fixture_table("### A2."))
    got = [(r.id, r.endpoint_a, r.endpoint_b, r.bowing_ev, r.varying_sublattice) for r in C.alloys(spark).collect()]
    assert sorted(got) == sorted((i, a, b, float(w), v) for i, a, b, w, v in fixture_table("### A3."))
    assert {r.family: r.bias for r in C.family_bias(spark).collect()} == {f: float(b) for f, b in fixture_table("### A4.")}
    bonds = {r.kind: (r.n, r.least) for r in crystal.kind_bonds(spark).groupBy("kind").agg(F.count("*").alias("n"), F.min("dist").alias("least")).collect()}
    for kinds, _, _, n, _, least in fixture_rows_of_cells():
        for kind in kinds.split(", "):
            assert bonds[kind] == (int(n), pytest.approx(float(least)))


def test_features(spark):
    got = {r.id: r for r in features.composition_features(C.materials(spark), C.elements(spark)).collect()}
    r = got["InGaAs-lattice-matched"]
    assert (r.en_difference, r.mean_valence, r.mean_period, r.mean_radius_pm) == pytest.approx((0.3859, 4.0, 4.265, 125.8))
    assert got["Si"].en_difference == 0
    zero = spark.createDataFrame([(5.0, 0.0), (7.0, 0.0)], "v double, w double")
    assert zero.agg(features.weighted_mean(F.col("v"), F.col("w")).alias("m")).first().m == 0
    assert zero.limit(0).agg(features.weighted_mean(F.col("v"), F.col("w")).alias("m")).first().m == 0


def test_unknown_element_fails(spark):
    odd = spark.createDataFrame([("x", [("Zz", 1.0)], [("S", 1.0)])], f"id string, cations {C.COMPONENTS}, anions {C.COMPONENTS}")
    with pytest.raises(Exception, match="unknown element Zz"):
        features.composition_features(odd, C.elements(spark)).collect()


def test_alloy_sweep(spark):
    rows = reports.alloy_sweep(C.alloys(spark), C.materials(spark), C.family_bias(spark), C.composition_grid(spark)).collect()
    assert len(rows) == 303
    at = {(r.system, round(r.x, 2)): r for r in rows}
    assert at["InGaAs", 0.47].id == "InGaAs-x0.47" and at["InGaAs", 0.47].actual_eg_ev == pytest.approx(0.739379, abs=1e-6)
    assert (at["CdSeTe", 0.47].baseline, at["CdSeTe", 0.47].corrected) == pytest.approx((1.510108, 1.436451), abs=1e-6)
    assert at["CdSeTe", 1.0].structure == "wurtzite"  # the first endpoint's, all along
    assert [at[s, x].actual_eg_ev for s, x in (("PbSSe", 0.0), ("PbSSe", 1.0))] == [0.41, 0.27]
    assert [sum(r.in_window for r in rows if r.system == s) for s in ("InGaAs", "PbSSe", "CdSeTe")] == [80, 0, 21]


def test_unit_cells(spark):
    cells = reports.unit_cell(C.materials(spark), C.elements(spark))
    atoms = {(r.material_id, r.role): r.n for r in cells["atoms"].groupBy("material_id", "role").agg(F.count("*").alias("n")).collect()}
    assert (atoms["PbS", "cation"], atoms["PbS", "anion"]) == (14, 9)
    assert (atoms["GaAs", "anion"], atoms["Si", "anion"], atoms["CdSe", "cation"], atoms["CdSe", "anion"]) == (4, 4, 3, 2)
    bonds = {r.material_id: r["count"] for r in cells["bonds"].groupBy("material_id").count().collect()}
    assert (bonds["PbS"], bonds["GaAs"], bonds["Ge"], bonds["CdSe"]) == (38, 16, 16, 4)
    assert {r["count"] for r in cells["cell_edges"].groupBy("material_id").count().collect()} == {12}

    def places(df, *columns):
        return {(r.material_id, *(round(r[c], 6) + 0.0 for c in columns)) for r in df.collect()}

    # one frame for all three: bonds end at atoms, and a cell's edges have their middle at 0
    atom_places = places(cells["atoms"], "x", "y", "z")
    assert places(cells["bonds"], "x1", "y1", "z1") | places(cells["bonds"], "x2", "y2", "z2") <= atom_places
    middle = cells["cell_edges"].groupBy("material_id").agg(*(F.sum(F.col(f"{a}1") + F.col(f"{a}2")).alias(a) for a in "xyz")).collect()
    assert all(abs(v) < 1e-9 for r in middle for v in (r.x, r.y, r.z))
    assert "CartesianProduct" not in cells["bonds"]._jdf.queryExecution().toString()


def test_unknown_structures_and_symbols(spark):
    odd = C.materials(spark).filter("id = 'GaAs'").withColumn("structure", F.lit("cube")).withColumn("cations", F.array(F.struct(F.lit("Zz").alias("symbol"), F.lit(1.0).alias("frac"))))
    rows = crystal.atoms(odd, C.elements(spark)).collect()
    assert len(rows) == 18 and {r.color for r in rows if r.symbol == "Zz"} == {"#999999"}
    assert [(r.symbol, r.name, r.color) for r in reports.legend(odd, C.elements(spark)).orderBy("pos").collect()][0] == ("Zz", "Zz", "#999")


def test_selected_materials(spark):
    asked = spark.createDataFrame([("curated", "GaAs", None, None), ("curated", "none", None, None), ("alloy", None, "InGaAs", "0.47"), ("alloy", None, "none", "0.1")], "mode string, material_id string, system string, x_text string")
    rows = {r.id: r for r in reports.selected(asked, C.materials(spark), C.alloys(spark)).collect()}
    assert set(rows) == {"GaAs", "InGaAs-x0.47"}
    r = rows["InGaAs-x0.47"]
    assert r.display_name == f"{r.formula} (x = 0.47)" and [c.symbol for c in r.cations] == ["In", "Ga"]
    assert [r.x_text for r in reports.composition_lines(spark.createDataFrame([("a", 0.3)], "id string, x double")).collect()] == ["Composition x = 0.30"]


def test_site_assignment(spark):
    parts = F.array(F.struct(F.lit("A").alias("symbol"), F.lit(0.75).alias("frac")), F.struct(F.lit("B").alias("symbol"), F.lit(0.25).alias("frac")))
    got = spark.range(2).select(crystal.assigned_symbol(parts, F.col("id"), F.lit(2)).alias("s")).collect()
    assert [r.s for r in got] == ["A", "B"]  # half a site rounds up


def test_legend_keeps_zero_fractions(spark):
    virtual = alloy.virtual_materials(C.alloys(spark), C.materials(spark), C.composition_grid(spark)).filter("id = 'PbSSe-x0.00'")
    assert [r.symbol for r in reports.legend(virtual, C.elements(spark)).orderBy("pos").collect()] == ["Pb", "S", "Se"]


def test_lookup_and_index(spark):
    assert C.by_id(C.materials(spark), "nope").count() == 0
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 3)], "k string, ord int, v int")
    assert C.last_of_each(df, "k", "ord").first().v == 3
    with pytest.raises(Exception, match="unknown structure"):
        C.checked_materials(C.materials(spark).withColumn("structure", F.lit("cube"))).collect()
    with pytest.raises(Exception, match="unknown family"):
        C.checked_materials(C.materials(spark).withColumn("family", F.lit(None).cast("string"))).collect()
    with pytest.raises(Exception, match="unknown varying_sublattice both"):
        C.checked_alloys(C.alloys(spark).withColumn("varying_sublattice", F.lit("both"))).collect()
    assert C.checked_materials(C.materials(spark)).count() == 14 and C.checked_alloys(C.alloys(spark)).count() == 3


def test_stream(spark, tmp_path):
    from gapwise.streaming import score_stream

    C.materials(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(C.MATERIAL_SCHEMA).parquet(str(tmp_path / "in"))
    query = score_stream(stream, C.family_bias(spark)).writeStream.format("memory").queryName("scored").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("scored").count() == 14


def test_windowed_metrics_on_a_stream(spark, tmp_path):
    from gapwise.streaming import windowed_metrics

    rows = [(k, float(k % 7), k % 7 + 0.5, "a" if k % 2 else "b") for k in range(120)]
    df = spark.createDataFrame(rows, "second int, actual double, predicted double, grp string").select(F.timestamp_seconds("second").alias("at"), "actual", "predicted", "grp")
    df.filter("second(at) >= 0").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    found = windowed_metrics(stream, F.col("actual"), F.col("predicted"), "at", "30 seconds", "10 seconds", "grp")
    query = found.writeStream.format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("windows").collect()
    assert len(got) == 6 and {r.n for r in got} == {15} and all(r.mae == r.rmse == 0.5 for r in got)
