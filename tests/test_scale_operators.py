"""Operators for large tables against brute force: exact texts, neighbours, clusters, splits, states, bands, cleaning."""

import collections
import itertools
import math
import random
import struct
from decimal import ROUND_HALF_UP, Context, Decimal

import pytest
from pyspark.sql import functions as F

from gapwise.functions.exact import exact_fixed, let, rounded_product, with_product
from gapwise.operators import alloy, boosting, calibration, fingerprint, metrics, ordered, quality, spatial
from gapwise.sources import catalog as C
from gapwise.sources.store import fresh

# ---- exact texts ----


def fixed(v, digits):
    if v != v:
        return "NaN"
    if math.isinf(v):
        return "Infinity" if v > 0 else "-Infinity"
    text = format(Context(prec=400, rounding=ROUND_HALF_UP).quantize(Decimal(v), Decimal(1).scaleb(-digits)), "f")
    return text.lstrip("-") if v == 0 else text


def test_exact_texts(spark):
    r = random.Random(1)
    values = [v for _ in range(20_000) if not abs(v := struct.unpack("<d", r.randbytes(8))[0]) >= 1e21]
    values += [r.uniform(-1e6, 1e6) for _ in range(20_000)] + [r.randrange(-(10**9), 10**9) / 1000 for _ in range(20_000)]
    values += [r.randrange(-(2**40), 2**40) / 2 ** r.randrange(30) for _ in range(20_000)] + [float(r.randrange(2**52, 2**69)) for _ in range(20_000)]
    values += [x for d in range(9) for k in range(1000) for x in ((k + 0.5) / 10**d, math.nextafter((k + 0.5) / 10**d, -1.0))]
    values += [0.0, -0.0, math.inf, -math.inf, math.nan, 0.9999999999999999, -0.5, 2.0**52 - 0.5, 5e-324, 999.995, 1e15 + 0.5]
    digits = (0, 1, 2, 3, 11, 12, 15)
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4).select("v", *(exact_fixed(F.col("v"), d).alias(f"d{d}") for d in digits))
    assert not any(w in df._jdf.queryExecution().toString() for w in ("ArrowEvalPython", "BatchEvalPython"))
    wrong = [(row.v, d, row[f"d{d}"]) for row in df.collect() for d in digits if row[f"d{d}"] != fixed(row.v, d)]
    assert not wrong, wrong[:5]
    with pytest.raises(ValueError):
        exact_fixed(F.col("v"), 16)


def test_products_are_exact(spark):
    r = random.Random(2)
    df = spark.createDataFrame([(r.uniform(-1e9, 1e9),) for _ in range(2000)], "a double")
    for b in (10.0**15, 0.1, 1 / 3):
        for row in df.select("a", with_product(F.col("a"), b, lambda p, e: F.struct(p.alias("p"), e.alias("e"))).alias("x")).collect():
            assert Context(prec=200).add(Decimal(row.x.p), Decimal(row.x.e)) == Context(prec=200).multiply(Decimal(row.a), Decimal(b))
    assert spark.range(1).select(let(F.lit(3), lambda x: x * x)).first()[0] == 9


def test_rounding_by_products(spark):
    """As DuckDB rounds, at ties above all."""
    import duckdb

    r = random.Random(5)
    values = [k / p for p in (640, 512, 3) for k in range(-500, 2500)] + [v for _ in range(5000) if math.isfinite(v := struct.unpack("<d", r.randbytes(8))[0])]
    values += [3.22875, 0.064062500000000001, 1e305, -1e305, 2.0**52 / 1e4, 0.0, -0.0, math.inf, -math.inf]
    duck = duckdb.connect()
    duck.execute("create table t(k bigint, v double)")
    duck.executemany("insert into t values (?, ?)", list(enumerate(values)))
    df = spark.createDataFrame(list(enumerate(values)), "k long, v double")
    for digits in (0, 4, 6):
        want = duck.sql(f"select k, round(v, {digits}) from t order by k").fetchall()
        got = df.select("k", rounded_product(F.col("v"), digits)).orderBy("k").collect()
        assert [(k, repr(x)) for k, x in map(tuple, got)] == [(k, repr(x)) for k, x in want]
    odd = spark.createDataFrame([(math.nan,), (None,)], "v double").select(rounded_product(F.col("v"), 4).alias("r")).collect()
    assert math.isnan(odd[0].r) and odd[1].r is None


def test_wavelengths_match_their_sql(spark, tmp_path):
    """Of all gaps in hundredths up to 2000, the tie at 384 differed; zeros keep their sign."""
    import duckdb

    from gapwise.plans import queries as plans

    gaps = spark.range(200_001).select(F.col("id").alias("event_id"), (F.col("id") / 100).alias("value"))
    odd = spark.createDataFrame([(-1, -0.0), (-2, None), (-3, -3.84), (-4, 1e-320)], "event_id long, value double")
    gaps.unionByName(odd).write.parquet(f"{tmp_path}/events.parquet")
    query, sql = plans.TABLES["tbl_ev_to_nm"]
    duck = duckdb.connect()
    duck.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert {r.event_id: r.nm for r in query(spark, str(tmp_path)).collect()} == dict(duck.sql(sql).fetchall())


def test_virtual_ids_go_by_the_exact_value(spark):
    """0.145 is a little less than its text, so its id, which seeds the jitter, ends in 0.14."""
    asked = spark.createDataFrame([("InGaAs", 0.145), ("InGaAs", 0.47)], "system string, x double")
    rows = alloy.virtual_at(asked, C.alloys(spark), C.materials(spark)).orderBy("x").collect()
    assert [r.id for r in rows] == ["InGaAs-x0.14", "InGaAs-x0.47"]


def test_fresh_names(spark):
    df = spark.range(1).select(F.lit(1).alias("Row"), F.lit(1).alias("row_"))
    assert fresh(df, "row", "row", "other") == ["row__", "row___", "other"]


# ---- neighbours ----


def sites(spark, n, seed, keys=2, spread=10.0):
    r = random.Random(seed)
    rows = [(k, f"k{r.randrange(keys)}", *(round(r.uniform(0, spread), 3) for _ in range(3))) for k in range(n)]
    return rows, spark.createDataFrame(rows, "id long, key string, x double, y double, z double")


def brute_pairs(a, b, slack=1.06):
    out = []
    for key in {r[1] for r in a} & {r[1] for r in b}:
        met = [(math.sqrt((p[2] - q[2]) * (p[2] - q[2]) + (p[3] - q[3]) * (p[3] - q[3]) + (p[4] - q[4]) * (p[4] - q[4])), p[0], q[0]) for p in a for q in b if p[1] == q[1] == key]
        least = min(met)[0]
        out += [(key, i, j, d) for d, i, j in met if d <= least * slack]
    return sorted(out)


@pytest.mark.parametrize("spread, slack", [(10.0, 1.06), (10.0, 3.0), (0.002, 1.06), (0.0, 1.06)])
def test_nearest_pairs(spark, spread, slack):
    a, first = sites(spark, 120, 1, spread=spread)
    b, second = sites(spark, 140, 2, spread=spread)
    got = sorted((r.key, r.a.id, r.b.id, r.dist) for r in spatial.nearest_pairs(first, second, "key", slack=slack).collect())
    assert got == brute_pairs(a, b, slack)


def test_nearest_pairs_of_odd_points(spark):
    """Clusters on both sides of cell borders, repeated rows, null and infinite places, keys of one table."""
    a = [(1, "k", -1e-9, 0.0, 0.0), (2, "k", 5.0, 5.0, 5.0), (3, "k", None, 0.0, 0.0), (4, "only", 0.0, 0.0, 0.0), (5, None, 0.0, 0.0, 0.0), (6, "k", math.inf, 0.0, 0.0), (1, "k", -1e-9, 0.0, 0.0)]
    b = [(1, "k", 1e-9, 0.0, 0.0), (2, "k", 9.0, 9.0, 9.0), (3, "k", math.nan, 0.0, 0.0), (5, None, 0.0, 0.0, 0.0)]
    schema = "id long, key string, x double, y double, z double"
    found = spatial.nearest_pairs(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "key")
    assert [(r.key, r.a.id, r.b.id) for r in found.collect()] == [("k", 1, 1)] * 2
    assert spatial.nearest_pairs(spark.createDataFrame(a, schema).limit(0), spark.createDataFrame(b, schema), "key").count() == 0


def test_pairs_compared_grow_with_the_points(spark):
    """The rows that the join over cells makes, of one key, before any is left out."""
    from gapwise.sources.store import Scratch

    def compared(n):
        parts = [sites(spark, n, s, keys=1)[1] for s in (n, n + 1)]
        bounds = spatial.least_distance_bounds(*(p.select("key", "x", "y", "z") for p in parts), Scratch(spark, "t")).first().bound
        cells = [collections.Counter(tuple(math.floor(r[k] / bounds) for k in "xyz") for r in p.collect()) for p in parts]
        return sum(c * cells[1][tuple(a + b for a, b in zip(cell, step, strict=True))] for cell, c in cells[0].items() for step in itertools.product((-1, 0, 1), repeat=3))

    assert compared(2000) < 2000 * 30 and compared(8000) < 8000 * 30


def test_coordination(spark):
    """The known numbers of cubic crystals from one cell, and brute force over images beyond a period."""
    faces = [(0.0, 0.0, 0.0), (0.0, 0.5, 0.5), (0.5, 0.0, 0.5), (0.5, 0.5, 0.0)]
    for shift, reach, want in (((0.5, 0.5, 0.5), 0.51, 6), ((0.25, 0.25, 0.25), 0.44, 4)):
        rows = [("c", k, *p) for k, p in enumerate(faces)] + [("c", 4 + k, *(a + b for a, b in zip(p, shift, strict=True))) for k, p in enumerate(faces)]
        df = spark.createDataFrame(rows, "key string, id long, x double, y double, z double")
        got = spatial.coordination(df, "key", "id", (1.0, 1.0, 1.0), reach).collect()
        assert {r.neighbours for r in got} == {want} and all(r.m2 < 1e-12 for r in got)
    r = random.Random(3)
    rows = [("a", k, *(r.uniform(-5, 9) for _ in range(3))) for k in range(25)] + [("a", 7, 1.0, 1.0, 1.0), ("b", 1, 0.0, 0.0, 0.0), ("a", 8, None, 1.0, 1.0), (None, 9, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "key string, id long, x double, y double, z double")
    box, cutoff = (2.0, 3.0, 7.0), 2.6
    want = []
    for m, p in enumerate(rows):
        lengths = [
            d for n, q in enumerate(rows) if None not in (*p, *q) and p[0] == q[0] for s in itertools.product(range(-12, 13), range(-9, 10), range(-4, 5))
            if (m != n or any(s)) and (d := math.sqrt(sum((q[2 + k] + s[k] * box[k] - p[2 + k]) ** 2 for k in range(3)))) <= cutoff
        ]
        want.append((p[0], p[1], len(lengths), round(sum(lengths) / len(lengths), 9) if lengths else None))
    got = [(x.key, x.id, x.neighbours, None if x["mean"] is None else round(x["mean"], 9)) for x in spatial.coordination(df, "key", "id", box, cutoff).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    stats = {x.key: x for x in spatial.bond_statistics(spatial.coordination(df, "key", "id", box, cutoff), "key").collect()}
    assert stats["b"].bonds == 1 and stats["b"].mean_length == 2.0 and stats[None].bonds == 0  # its own image, seen from both ends


def shuffled_rows(spark, act):
    """The rows that act() shuffles, where no join is broadcast."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteRecords() for k in range(found.size())}

    before = stages()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        act()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return sum(rows for stage, rows in stages().items() if stage not in before)


@pytest.mark.parametrize("swept", [20_000, 300, 0])
def test_bonds_match_their_sql(spark, tmp_path, monkeypatch, swept):
    """Points on a lattice, where many distances are the cutoff, in keys whose mean of bonds lies between two last digits;
    swept keys and those on the grid. Small keys are last."""
    import duckdb

    from gapwise.plans import queries as plans

    monkeypatch.setattr(spatial, "SWEPT", swept)
    r = random.Random(6)
    sizes = [640] * 6 + [300, 41, 1]
    rows = [(k, r.randrange(10**6), 1, "N", float(r.randrange(1, 51)), r.randrange(20, 2100) * 50.0, r.randrange(11) / 100) for k, n in enumerate(sizes) for _ in range(n)]
    df = spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_linenumber int, l_returnflag string, l_quantity double, l_extendedprice double, l_discount double")
    df.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    query, sql = plans.TABLES["tbl_bond_statistics"]
    duck = duckdb.connect()
    duck.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    got = query(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(duck.sql(f"select {', '.join(got.columns)} from ({sql})").fetchall())


@pytest.mark.parametrize("swept", [20, 0])
def test_coordination_of_large_keys(spark, monkeypatch, swept):
    """Sweeps and grids see the same neighbours, with several images and with one."""
    r = random.Random(7)
    rows = [(k % 3 + 0.5 if k % 11 else math.nan, k, *(r.uniform(-9, 9) for _ in range(3))) for k in range(90)] + [(-0.0, 90, 0.0, 0.0, 0.0), (0.0, 91, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "key double, id long, x double, y double, z double").repartition(3)

    def seen(box, cutoff):
        found = spatial.coordination(df, "key", "id", box, cutoff)
        states = {repr(x.key + 0.0): (x.points, x.bonds, x.most, *(round(x[c], 6) for c in ("mean_length", "length_sd", "least"))) for x in spatial.bond_statistics(found, "key").collect()}
        return {x.id: (x.neighbours, *(None if x[c] is None else round(x[c], 6) for c in ("mean", "m2", "least"))) for x in found.collect()}, states

    whole = [seen(*of) for of in (((18.0, 9.0, 9.0), 4.1), ((2.0, 3.0, 8.2), 4.1), ((18.0, 8.0, 3.0), 4.1))]
    assert all(len(points) == 92 and len(states) == 5 for points, states in whole) and whole[0][0][90][0] == 1
    monkeypatch.setattr(spatial, "SWEPT", swept)
    for of, want in zip((((18.0, 9.0, 9.0), 4.1), ((2.0, 3.0, 8.2), 4.1), ((18.0, 8.0, 3.0), 4.1)), whole, strict=True):
        points, states = seen(*of)
        assert not {k for k, v in points.items() if v != want[0][k]} and states == want[1]


def test_coordination_shuffles_points_once(spark):
    """Not once for each of the 27 cells around each."""
    df = sites(spark, 3000, 8, keys=30)[1]
    assert shuffled_rows(spark, lambda: spatial.bond_statistics(spatial.coordination(df, "key", "id", (10.0, 10.0, 10.0), 1.0), "key").collect()) < 2 * 3000


def test_neighbours_of_no_points(spark):
    """Tables that are empty, or whose plan Spark empties, and points without key or place."""
    df = sites(spark, 20, 14)[1]
    for empty in (df.limit(0), df.filter(F.lit(False)), spark.createDataFrame([], df.schema)):
        found = spatial.coordination(empty, "key", "id", (3.0, 3.0, 3.0), 1.0)
        assert found.count() == spatial.bond_statistics(found, "key").count() == spatial.nearest_pairs(empty, df, "key").count() == spatial.nearest_pairs(df, empty, "key").count() == 0
    for column in ("key", "x"):
        bare = df.withColumn(column, F.lit(None).cast(df.schema[column].dataType))
        assert {r.neighbours for r in spatial.coordination(bare, "key", "id", (3.0, 3.0, 3.0), 1.0).collect()} == {0} and spatial.nearest_pairs(bare, df, "key").count() == 0


def test_values_of_keys():
    """Equal keys have equal numbers: nulls, NaNs and both zeros too."""
    import pyarrow as pa

    from gapwise.operators.sweep import codes

    for values in ([0.0, -0.0, math.nan, math.nan, None, 1.0, None], ["a", "a", "b", "b", None, "c", None], [[1], [1], [2], [2], None, [], None]):
        c = codes(pa.array(values)).tolist()
        assert [c[0] == c[1], c[2] == c[3], c[4] == c[6], len(set(c))] == [True, True, True, 4]


@pytest.mark.parametrize("swept", [20_000, 100, 0])
@pytest.mark.parametrize("spread, slack", [(10.0, 3.0), (0.002, 1.06), (0.0, 1.06)])
def test_nearest_pairs_by_sweep_and_grid(spark, monkeypatch, swept, spread, slack):
    """Keys of 60 and 200 points, in tables that differ in their columns: swept, one of each, on the grid."""
    from pyspark.sql.types import StructType

    monkeypatch.setattr(spatial, "SWEPT", swept)
    a, b = ([r for s, keys in ((1, 1), (3, 1)) for r in sites(spark, 30 if s == 1 else 100, s + of, keys, spread)[0] for r in [(*r[:1], f"k{s}", *r[2:])]] for of in (0, 1))
    schema = StructType.fromDDL("id long, key string, x double, y double, z double")
    first = spark.createDataFrame(a, schema).withColumn("a.b", F.array("id"))
    second = spark.createDataFrame([r[::-1] for r in b], StructType(schema.fields[::-1])).withColumn("day", F.lit("2020-02-02").cast("timestamp"))
    found = spatial.nearest_pairs(first, second, "key", slack=slack)
    rows = found.collect()
    assert sorted((r.key, r.a.id, r.b.id, r.dist) for r in rows) == brute_pairs(a, b, slack)
    assert found.columns == ["key", "a", "b", "dist"] and all(r.a["a.b"] == [r.a.id] and r.b.day.day == 2 and r.a.key == r.b.key == r.key for r in rows)


@pytest.mark.parametrize("swept", [20_000, 0])
def test_nearest_grid_matches_its_sql(spark, tmp_path, monkeypatch, swept):
    """Places on a lattice, with ties at the least distance and at the slack."""
    import duckdb

    from gapwise.plans import queries as plans

    monkeypatch.setattr(spatial, "SWEPT", swept)
    r = random.Random(11)
    rows = [(k, r.randrange(10**6), 1, r.choice("RAN"), float(r.randrange(1, 51)), r.randrange(20, 2100) * 50.0, r.randrange(11) / 100) for k, n in enumerate([300, 41, 3, 3, 1]) for _ in range(n)]
    df = spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_linenumber int, l_returnflag string, l_quantity double, l_extendedprice double, l_discount double")
    df.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    query, sql = plans.TABLES["tbl_nearest_grid"]
    duck = duckdb.connect()
    duck.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    got = query(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(duck.sql(f"select {', '.join(got.columns)} from ({sql})").fetchall())


def test_nearest_pairs_shuffle_points_once(spark):
    """Not once for each of the 27 cells around each and for each level of a grid."""
    first, second = (sites(spark, 3000, s, keys=30)[1] for s in (12, 13))
    assert shuffled_rows(spark, lambda: spatial.nearest_pairs(first, second, "key").collect()) < 2 * 6000


# ---- order within hot keys ----


def keyed(spark, n=3000, partitions=7):
    r = random.Random(9)
    rows = [(k, "hot" if k % 3 else r.choice(["a", "b", None]), r.choice([None, math.nan, round(r.uniform(0, 400), 2), float(r.randrange(50))]) if k % 50 == 0 else round(r.uniform(0, 4000), 1), k % 9) for k in range(n)]
    return rows, spark.createDataFrame(rows, "id long, key string, value double, part long").repartition(partitions)


def test_running_sums(spark):
    rows, df = keyed(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.id: r.before for r in ordered.running_sums(df, ["key"], [F.col("part").desc(), F.col("id").asc()], "part", "before").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sums = collections.Counter()
    for i, key, _, part in sorted(rows, key=lambda x: (-x[3], x[0])):
        assert got[i] == sums[key]
        sums[key] += part
    assert len(got) == len(rows) and ordered.running_sums(df.limit(0), ["key"], [F.col("id").asc()], "part", "before").count() == 0


def brute_clusters(rows, tolerance):
    out = {}
    for key in {r[1] for r in rows}:
        last, number = None, -1
        for i, _, v, _ in sorted((r for r in rows if r[1] == key and r[2] is not None and r[2] == r[2]), key=lambda x: x[2]):
            number += last is None or v - last > tolerance
            out[i], last = number, v
    return out


@pytest.mark.parametrize("tolerance", [0.0, 0.7, 3.0, 1e6])
def test_tolerance_clusters(spark, tolerance):
    """Runs of the hot key cross the borders of its ranges."""
    rows, df = keyed(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {r.id: r.cluster for r in ordered.tolerance_clusters(df, "key", "value", tolerance).collect()}
        kept = ordered.without_polymorphs(df, "key", "value", tolerance, ["part", "id"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = brute_clusters(rows, tolerance)
    assert len(got) == len(rows) and {i: c for i, c in got.items() if c is not None} == want
    by = collections.defaultdict(list)
    for i, key, _, part in rows:
        by[(key, want[i]) if i in want else i].append((part, i))
    assert sorted((r.id, r.members) for r in kept) == sorted((min(m)[1], len(m)) for m in by.values())
    assert ordered.tolerance_clusters(df.limit(0), "key", "value", 1.0).count() == 0


def test_stratified_split(spark):
    r = random.Random(4)
    rows = [(g, f"s{g % 3}" if g % 11 else None, k) for g in range(900) for k in range(r.choice((1, 2, 30)))] + [(None, "s1", 0), (5, "s0", 1)]
    df = spark.createDataFrame(rows, "group long, stratum string, k long")
    shares = {"train": 8, "validation": 1, "test": 1}
    got = ordered.stratified_split(df, "group", "stratum", shares).collect()
    assert len(got) == len({g for g, _, _ in rows}) == len({x.group for x in got})
    total, of = collections.Counter(), collections.Counter()
    for x in got:
        total[x.stratum] += x.rows
        of[x.stratum, x.split] += x.rows
    assert sum(total.values()) == len(rows)
    assert all(abs(of[s, name] - total[s] * share / 10) <= 60 for s in total for name, share in shares.items())
    more = df.unionByName(spark.createDataFrame([(5000 + g, "s1", 0) for g in range(20)], df.schema))
    after = {x.group: x.split for x in ordered.stratified_split(more, "group", "stratum", shares).collect()}
    assert sum(after[x.group] != x.split for x in got) <= 6
    assert ordered.stratified_split(df.limit(0), "group", "stratum", shares).count() == 0


# ---- metrics, bands ----


def test_merged_states_equal_a_rescan(spark):
    r = random.Random(8)
    rows = [(k % 40, r.choice("ab"), r.gauss(0, 1) + 1e9, r.gauss(0, 1) + 1e9) for k in range(4000)] + [(1, "a", None, 1.0), (1, "a", 1.0, None)]
    df = spark.createDataFrame(rows, "day int, grp string, actual double, predicted double")
    days = metrics.metric_states(df.repartition(5), F.col("actual"), F.col("predicted"), "day", "grp")
    weeks = metrics.merged_states(days.withColumn("week", F.floor(F.col("day") / 7)), "week", "grp")
    known = [x for x in rows if None not in x]
    for got, part in [(metrics.merged_states(weeks), known), (metrics.merged_states(days.filter("day between 3 and 17")), [x for x in known if 3 <= x[0] <= 17])]:
        got = metrics.metrics_of_states(got).first()
        mean = math.fsum(x[2] for x in part) / len(part)
        tot, res = math.fsum((x[2] - mean) ** 2 for x in part), math.fsum((x[3] - x[2]) ** 2 for x in part)
        assert got.n == len(part) and got.r2 == pytest.approx(1 - res / tot, rel=1e-6) and got.rmse == pytest.approx(math.sqrt(res / len(part)))
    one = metrics.metrics_of_states(metrics.merged_states(metrics.metric_states(df.limit(0), F.col("actual"), F.col("predicted")))).first()
    assert (one.n, one.mae, one.r2) == (0, None, None)


def test_ranked_values(spark):
    r = random.Random(6)
    rows = [("hot", r.choice([r.gauss(0, 1), 10.0 ** r.uniform(-300, 300), 3.0, -1e308, 1e308])) for _ in range(3000)] + [("few", 2.0), ("same", 1.0), ("same", 1.0), (None, 5.0), ("nan", math.nan), ("null", None), ("few", -1.0)]
    df = spark.createDataFrame(rows, "grp string, v double").repartition(5)
    for share in (0.0, 0.31, 0.9, 1.2):
        got = {x.grp: (x.n, x["rank"], x.value) for x in calibration.ranked_values(df, "grp", F.col("v"), F.ceil(F.col("n") * F.lit(share))).collect()}
        by = collections.defaultdict(list)
        for g, v in rows:
            if v is not None and v == v:
                by[g].append(v)
        for g, values in by.items():
            k = math.ceil(len(values) * share)
            assert got[g] == (len(values), k, sorted(values)[k - 1] if 1 <= k <= len(values) else None)
        assert set(got) == set(by)


def test_bands_cover_new_rows(spark):
    r = random.Random(5)
    rows = [(k, r.choice("ab"), r.gauss(0, 1) ** 3) for k in range(30_000)] + [(0, "few", 1.0)]
    df = spark.createDataFrame(rows, "k long, grp string, y double")
    bands = {x.grp: x.band for x in calibration.conformal_bands(df.filter("k % 2 = 0"), "grp", F.col("y"), F.lit(0.0), 0.9).collect()}
    assert bands["few"] == math.inf
    for g in "ab":
        new = [abs(y) for k, x, y in rows if x == g and k % 2]
        assert abs(sum(e <= bands[g] for e in new) / len(new) - 0.9) < 0.01


# ---- cleaning, fingerprints, boosting ----


def test_quarantine(spark):
    rows = [(k, None if k % 10 == 0 else k, "x" if k % 3 else "y") for k in range(100)]
    df = spark.createDataFrame([(*x, "u", "v") for x in rows], "id long, v long, t string, broken string, accepted string")
    rules = {"low": F.col("v") > 20, "type": F.col("t") == "x"}
    good, bad, counts = quality.quarantined(df, rules)
    want = {i: [n for n, ok in (("low", v is not None and v > 20), ("type", t == "x")) if not ok] for i, v, t in rows}
    assert {r.id for r in good.collect()} == {i for i, b in want.items() if not b} and good.columns == df.columns
    assert {r.id: r["broken_"] for r in bad.collect()} == {i: b for i, b in want.items() if b} and {r.broken for r in bad.collect()} == {"u"}
    assert counts == {"rows": 100, "accepted": sum(not b for b in want.values()), "low": sum("low" in b for b in want.values()), "type": sum("type" in b for b in want.values())}
    good, bad, counts = quality.quarantined(df.limit(0), rules)
    assert good.count() == bad.count() == counts["rows"] == counts["low"] == 0


def test_refined_classes(spark):
    """A path's nodes by their distance from its ends; two rings of one size can't be told apart; a star with a tail."""
    path = [(k, k + 1) for k in range(1, 7)]
    rings = [(20 + k, 20 + (k + 1) % 5) for k in range(5)] + [(30 + k, 30 + (k + 1) % 5) for k in range(5)]
    star = [(50, 51 + k) for k in range(6)] + [(51, 60)]
    edges = spark.createDataFrame([*path, *rings, *star, (1, 2), (2, 1), (None, 3)], "a long, b long").repartition(3)
    got = {r.node: (r["class"], r.members) for r in fingerprint.refined_classes(edges).collect()}
    assert [got[k][0] for k in range(1, 8)] == [1, 2, 3, 4, 3, 2, 1]
    assert {got[k] for k in (*range(20, 25), *range(30, 35))} == {(20, 10)}
    assert len({got[k][0] for k in range(52, 57)}) == 1 and got[51][0] != got[52][0] != got[60][0]
    assert fingerprint.refined_classes(edges.limit(0)).count() == 0


def test_boosting(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice", F.col("p_size").cast("double").alias("p_size"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(part, "l_partkey").select(F.col("l_partkey").cast("double").alias("key"), "l_orderkey", "l_quantity", "p_size", "p_retailprice")
    lines = lines.withColumn("p_size", F.when(F.col("l_orderkey") % 5 > 0, F.col("p_size")))
    features = ["p_size", "key", "l_quantity"]
    train, test = lines.filter("key % 2 = 0"), lines.filter("key % 2 = 1")
    model = boosting.fit_boosted(train, features, "p_retailprice", trees=6, depth=3)
    row = metrics.compute_metrics(test, F.col("p_retailprice"), model.predict()).first()
    assert row.r2 > 0.7  # the mean has 0
    assert not any(w in test.select(model.predict())._jdf.queryExecution().toString() for w in ("ArrowEvalPython", "BatchEvalPython"))
    # the first tree's splits by brute force over all rows
    edges = boosting.bin_edges(train, features)
    rows = [{**r.asDict(), "rest": round(r.p_retailprice - model.base, 6)} for r in train.collect()]

    def check(node, rows):
        if node.feature is None:
            return 0
        best = None
        for f in features:
            for e in edges[f]:
                sides = [[r["rest"] for r in rows if (r[f] is not None and r[f] <= e) == left] for left in (True, False)]
                if min(map(len, sides)) >= 20:
                    gain = sum(math.fsum(s) ** 2 / (len(s) + 1) for s in sides) - math.fsum(math.fsum(s) for s in sides) ** 2 / (len(rows) + 1)
                    if best is None or gain > best[0] * (1 + 1e-12):
                        best = gain, f, e
        assert (node.feature, node.edge) == best[1:]
        left = [r for r in rows if r[node.feature] is not None and r[node.feature] <= node.edge]
        return 1 + check(node.left, left) + check(node.right, [r for r in rows if r not in left])

    assert check(model.trees[0], rows) == 7
    assert boosting.fit_boosted(train.limit(0), features, "p_retailprice").predict() is not None
