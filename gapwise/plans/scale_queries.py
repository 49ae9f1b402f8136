"""Registered queries of the operators for large tables, and their DuckDB SQL, over the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.functions.exact import exact_fixed, rounded_product
from gapwise.operators import boosting, calibration, fingerprint, metrics, ordered, quality, spatial

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- number texts of the exact binary value ----


def fixed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.lit(0).alias("line"), F.col("value").alias("v"))
    lines = _table(spark, sf_dir, "lineitem").select(F.lit("line").alias("kind"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("int").alias("line"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 8).alias("v"))
    texts = [exact_fixed(F.col("v"), d).alias(f"text{d}") for d in (0, 1, 2, 9)]
    return events.unionByName(lines).select("kind", "id", "line", *texts)


def _fixed_sql(digits: int) -> str:
    """printf writes all digits of the binary value; the digit after the last decides."""
    kept = f"(regexp_replace(substr(all_digits, 1, length(all_digits) - {80 - digits}), '[.]', ''))::HUGEINT + (substr(all_digits, length(all_digits) - {80 - digits}+ 1, 1) >= '5')::INT"
    if not digits:
        return f"({kept})::VARCHAR"
    return f"(({kept}) // {10**digits})::VARCHAR || '.' || lpad((({kept}) % {10**digits})::VARCHAR, {digits}, '0')"


FIXED_TEXTS_SQL = f"""
WITH numbers AS (
  SELECT 'event' AS kind, event_id AS id, 0 AS line, value AS v FROM events
  UNION ALL SELECT 'line', l_orderkey, l_linenumber::INTEGER, l_extendedprice * (1 - l_discount) / 8 FROM lineitem
), digits AS (SELECT *, printf('%.80f', v) AS all_digits FROM numbers)
SELECT kind, id, line::INTEGER AS line, {", ".join(f"{_fixed_sql(d)} AS text{d}" for d in (0, 1, 2, 9))} FROM digits
"""


# ---- neighbours in space ----

PLACE = ("l_quantity", "price", "discount")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    return lines.select("l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", (F.col("l_extendedprice") / 1000).alias("price"), (F.col("l_discount") * 100).alias("discount"))


PLACES_SQL = "places AS (SELECT *, l_extendedprice / 1000 AS price, l_discount * 100 AS discount FROM lineitem)"


def nearest_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = _places(spark, sf_dir)
    sides = [places.filter(f"l_returnflag {of} 'R'").select("l_suppkey", "l_orderkey", *PLACE) for of in ("=", "<>")]
    pairs = spatial.nearest_pairs(*sides, "l_suppkey", PLACE)
    return pairs.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("pairs"), rounded_product(F.min("dist"), 6).alias("least"), rounded_product(F.max("dist"), 6).alias("longest"), F.sum(F.col("a.l_orderkey") + F.col("b.l_orderkey")).alias("keys"))


NEAREST_GRID_SQL = f"""
WITH {PLACES_SQL}, pairs AS (
  SELECT a.l_suppkey, a.l_orderkey + b.l_orderkey AS keys,
    sqrt((a.l_quantity - b.l_quantity) * (a.l_quantity - b.l_quantity) + (a.price - b.price) * (a.price - b.price) + (a.discount - b.discount) * (a.discount - b.discount)) AS dist
  FROM places a JOIN places b ON a.l_suppkey = b.l_suppkey WHERE a.l_returnflag = 'R' AND b.l_returnflag <> 'R'
), least AS (SELECT l_suppkey, min(dist) AS least FROM pairs GROUP BY l_suppkey)
SELECT l_suppkey, count(*)::BIGINT AS pairs, round(min(dist), 6) AS least, round(max(dist), 6) AS longest, sum(keys)::BIGINT AS keys
FROM pairs JOIN least USING (l_suppkey) WHERE dist <= least.least * 1.06::DOUBLE GROUP BY l_suppkey
"""

BOX, CUTOFF = (50.0, 110.0, 11.0), 3.05


def bond_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spatial.bond_statistics(spatial.coordination(_places(spark, sf_dir), "l_suppkey", "l_orderkey", BOX, CUTOFF, PLACE), "l_suppkey")
    return found.select("l_suppkey", "points", "bonds", "most", *(rounded_product(F.col(c), 6).alias(c) for c in ("mean_coordination", "mean_length", "length_sd", "least")))


def _wrapped(axis: str, length: float) -> str:
    d = f"(a.{axis} - b.{axis})"
    return f"({d} - {length}::DOUBLE * round({d} / {length}::DOUBLE))"


BOND_STATISTICS_SQL = f"""
WITH {PLACES_SQL}, numbered AS (SELECT *, row_number() OVER () AS id FROM places), apart AS (
  SELECT a.l_suppkey, a.id, {", ".join(f"{_wrapped(c, s)} AS d{k}" for k, (c, s) in enumerate(zip(PLACE, BOX, strict=True)))}
  FROM numbered a JOIN numbered b ON a.l_suppkey = b.l_suppkey AND a.id <> b.id
), bonds AS (SELECT l_suppkey, id, sqrt(d0 * d0 + d1 * d1 + d2 * d2) AS dist FROM apart WHERE sqrt(d0 * d0 + d1 * d1 + d2 * d2) <= {CUTOFF}::DOUBLE),
points AS (SELECT l_suppkey, count(*)::BIGINT AS points FROM lineitem GROUP BY l_suppkey),
counts AS (SELECT l_suppkey, max(n)::BIGINT AS most FROM (SELECT l_suppkey, count(*) AS n FROM bonds GROUP BY l_suppkey, id) GROUP BY l_suppkey),
lengths AS (SELECT l_suppkey, count(*)::BIGINT AS n, avg(dist) AS mean_length, stddev_pop(dist) AS length_sd, min(dist) AS least FROM bonds GROUP BY l_suppkey)
SELECT l_suppkey, points, coalesce(n, 0)::DOUBLE / 2 AS bonds, coalesce(most, 0)::BIGINT AS most, round(coalesce(n, 0)::DOUBLE / points, 6) AS mean_coordination,
  round(mean_length, 6) AS mean_length, round(length_sd, 6) AS length_sd, round(least, 6) AS least
FROM points LEFT JOIN counts USING (l_suppkey) LEFT JOIN lengths USING (l_suppkey)
"""


# ---- ordered work within keys ----


def polymorphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ordered.without_polymorphs(_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", "p_retailprice"), "p_type", "p_retailprice", 2.0, ["p_size", "p_partkey"])
    return found.select("p_type", "cluster", "members", "p_partkey", "p_size", "p_retailprice")


POLYMORPHS_SQL = """
WITH gaps AS (
  SELECT *, coalesce(p_retailprice - lag(p_retailprice) OVER (PARTITION BY p_type ORDER BY p_retailprice) > 2.0::DOUBLE, true)::INT AS start FROM part
), numbered AS (SELECT *, (sum(start) OVER (PARTITION BY p_type ORDER BY p_retailprice RANGE UNBOUNDED PRECEDING) - 1)::BIGINT AS cluster FROM gaps)
SELECT p_type, cluster, (count(*) OVER c)::BIGINT AS members, p_partkey, p_size, p_retailprice FROM numbered
WINDOW c AS (PARTITION BY p_type, cluster) QUALIFY row_number() OVER (PARTITION BY p_type, cluster ORDER BY p_size, p_partkey) = 1
"""

SHARES = {"train": 8, "validation": 1, "test": 1}


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    rows = orders.join(_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    return ordered.stratified_split(rows, "c_custkey", "c_nationkey", SHARES, seed=3)


STRATIFIED_SPLIT_SQL = """
WITH sized AS (
  SELECT c_custkey, min(c_nationkey) AS c_nationkey, count(*)::BIGINT AS rows FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey
), placed AS (
  SELECT *, coalesce(sum(rows) OVER (PARTITION BY c_nationkey ORDER BY md5('3:' || c_custkey), c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    sum(rows) OVER (PARTITION BY c_nationkey) AS whole
  FROM sized
)
SELECT c_custkey, c_nationkey, rows, CASE WHEN start * 10 < whole * 8 THEN 'train' WHEN start * 10 < whole * 9 THEN 'validation' ELSE 'test' END AS split FROM placed
"""


# ---- metrics from stored states ----


def _scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    return lines.join(part, "l_partkey").withColumn("predicted", F.col("l_quantity") * F.col("p_retailprice"))


SCORED_SQL = "scored AS (SELECT *, l_quantity * p_retailprice AS predicted FROM lineitem JOIN part ON l_partkey = p_partkey)"


def metric_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state a day and flag, merged to years and flags, to years and to all days."""
    lines = _scored_lines(spark, sf_dir).withColumn("day", F.to_date("l_shipdate"))
    days = metrics.metric_states(lines, F.col("l_extendedprice"), F.col("predicted"), "day", "l_returnflag")
    years = metrics.merged_states(days.withColumn("year", F.year("day")), "year", "l_returnflag")
    parts = [years, metrics.merged_states(years, "year"), metrics.merged_states(years)]
    out = None
    for p in parts:
        m = metrics.metrics_of_states(p)
        year, flag = (F.col(c).cast("string") if c in m.columns else F.lit("all") for c in ("year", "l_returnflag"))
        m = m.select(year.alias("year"), flag.alias("l_returnflag"), F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"), F.round("r2", 8).alias("r2"), "n")
        out = m if out is None else out.unionByName(m)
    return out


METRIC_STATES_SQL = f"""
WITH {SCORED_SQL}
SELECT coalesce(year(l_shipdate)::VARCHAR, 'all') AS year, coalesce(l_returnflag, 'all') AS l_returnflag, round(avg(abs(predicted - l_extendedprice)), 3) AS mae,
  round(sqrt(avg((predicted - l_extendedprice) * (predicted - l_extendedprice))), 3) AS rmse,
  round(1 - sum((predicted - l_extendedprice) * (predicted - l_extendedprice)) / (var_pop(l_extendedprice) * count(*)), 8) AS r2, count(*)::BIGINT AS n
FROM scored GROUP BY GROUPING SETS ((year(l_shipdate), l_returnflag), (year(l_shipdate)), ())
"""


def conformal_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands from the lines of even orders, and the share of the others that they hold."""
    lines = _scored_lines(spark, sf_dir)
    bands = calibration.conformal_bands(lines.filter("l_orderkey % 2 = 0"), "l_returnflag", F.col("l_extendedprice"), F.col("predicted"), 0.9)
    fresh = lines.filter("l_orderkey % 2 = 1").join(F.broadcast(bands), "l_returnflag")  # a row for each flag
    held = F.avg((F.abs(F.col("predicted") - F.col("l_extendedprice")) <= F.col("band")).cast("double"))
    return fresh.groupBy("l_returnflag", "n", "rank", "band").agg(F.count(F.lit(1)).alias("rows"), F.round(held, 6).alias("held")).withColumn("band", F.round("band", 6))


CONFORMAL_BANDS_SQL = f"""
WITH {SCORED_SQL}, errors AS (
  SELECT l_returnflag, abs(predicted - l_extendedprice) AS e, row_number() OVER (PARTITION BY l_returnflag ORDER BY abs(predicted - l_extendedprice)) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n
  FROM scored WHERE l_orderkey % 2 = 0
), bands AS (SELECT l_returnflag, n, k AS rank, e AS band FROM errors WHERE k = ceil((n + 1) * 0.9::DOUBLE - 1e-9::DOUBLE))
SELECT l_returnflag, n::BIGINT AS n, rank::BIGINT AS rank, round(band, 6) AS band, count(*)::BIGINT AS rows, round(avg((abs(predicted - l_extendedprice) <= band)::INT), 6) AS held
FROM scored JOIN bands USING (l_returnflag) WHERE l_orderkey % 2 = 1 GROUP BY l_returnflag, n, rank, band
"""


# ---- cleaning ----


def quarantined_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.get_json_object("props", "$.k").try_cast("int")
    rules = {"value_low": F.col("value") >= 1, "value_high": F.col("value") < 200, "known_type": F.col("event_type").isin("click", "view", "purchase"), "props": number.between(10, 89)}
    _, rejected, _ = quality.quarantined(_table(spark, sf_dir, "events").select("event_id", "event_type", "value", "props"), rules)
    return rejected.select("event_id", "event_type", "value", F.array_join("broken", ",").alias("broken"))


QUARANTINED_EVENTS_SQL = """
WITH marked AS (
  SELECT event_id, event_type, value, concat_ws(',',
    CASE WHEN coalesce(value >= 1, false) THEN NULL ELSE 'value_low' END, CASE WHEN coalesce(value < 200, false) THEN NULL ELSE 'value_high' END,
    CASE WHEN coalesce(event_type IN ('click', 'view', 'purchase'), false) THEN NULL ELSE 'known_type' END,
    CASE WHEN coalesce(try_cast(json_extract_string(props, '$.k') AS INTEGER) BETWEEN 10 AND 89, false) THEN NULL ELSE 'props' END) AS broken
  FROM events
)
SELECT * FROM marked WHERE broken <> ''
"""


def quarantine_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted orders by status, with what the one pass counted: all rows and the rows that break each rule."""
    day = F.to_date("o_orderdate")
    rules = {"price": F.col("o_totalprice").between(1000, 300_000), "status": F.col("o_orderstatus").isin("F", "O"), "date": day >= "1993-01-01"}
    accepted, _, counts = quality.quarantined(_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate"), rules)
    found = accepted.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("accepted"), F.sum("o_orderkey").alias("keys"))
    return found.select("*", *(F.lit(counts[n]).cast("long").alias(f"broke_{n}") for n in rules), F.lit(counts["rows"]).cast("long").alias("rows"))


QUARANTINE_COUNTS_SQL = """
WITH marked AS (
  SELECT *, coalesce(o_totalprice BETWEEN 1000 AND 300000, false) AS price, coalesce(o_orderstatus IN ('F', 'O'), false) AS status, coalesce(o_orderdate::DATE >= DATE '1993-01-01', false) AS dated FROM orders
), counts AS (SELECT sum((NOT price)::INT)::BIGINT AS broke_price, sum((NOT status)::INT)::BIGINT AS broke_status, sum((NOT dated)::INT)::BIGINT AS broke_date, count(*)::BIGINT AS rows FROM marked)
SELECT o_orderstatus, count(*)::BIGINT AS accepted, sum(o_orderkey)::BIGINT AS keys, broke_price, broke_status, broke_date, rows
FROM marked, counts WHERE price AND status AND dated GROUP BY ALL
"""


# ---- graph fingerprints ----


def structure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and the parts they order, by two rounds of refinement."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    edges = lines.join(orders, "l_orderkey").select((2 * F.col("o_custkey")).alias("a"), (2 * F.col("l_partkey") + 1).alias("b"))
    return fingerprint.refined_classes(edges, rounds=2)


STRUCTURE_CLASSES_SQL = """
WITH edges AS (SELECT DISTINCT 2 * o_custkey AS a, 2 * l_partkey + 1 AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
sides AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
degrees AS (SELECT a AS node, count(*) AS degree FROM sides GROUP BY a),
second AS (
  SELECT s.a AS node, any_value(own.degree)::VARCHAR || ':' || string_agg(d.degree::VARCHAR, ',' ORDER BY d.degree) AS colour
  FROM sides s JOIN degrees d ON d.node = s.b JOIN degrees own ON own.node = s.a GROUP BY s.a
)
SELECT node, min(node) OVER (PARTITION BY colour) AS class, (count(*) OVER (PARTITION BY colour))::BIGINT AS members FROM second
"""


# ---- a boosted baseline ----


def boosted_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List prices of the ordered parts, learned from the lines of even parts; errors over those of odd parts, beside the
    mean's. No SQL grows trees."""
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice", F.col("p_size").cast("double").alias("p_size"))
    lines = _table(spark, sf_dir, "lineitem").join(part, "l_partkey").select("l_orderkey", F.col("l_partkey").cast("double").alias("l_partkey"), "l_quantity", "l_discount", "p_size", "p_retailprice", "l_returnflag")
    model = boosting.fit_boosted(lines.filter("l_partkey % 2 = 0"), ["l_partkey", "p_size", "l_quantity", "l_discount"], "p_retailprice", trees=8, depth=3)
    held = lines.filter("l_partkey % 2 = 1").select("l_returnflag", "l_orderkey", "p_retailprice", model.predict().alias("boosted"), F.lit(model.base).alias("mean"))
    found = metrics.metrics_report(held, "p_retailprice", {"boosted": "boosted", "mean": "mean"}, "l_returnflag", "l_orderkey")
    return found.select("model", "grp", F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"), F.round("r2", 6).alias("r2"), "n")


QUERIES: dict[str, tuple[Query, str | None]] = {
    "tbl_fixed_texts": (fixed_texts, FIXED_TEXTS_SQL),
    "tbl_nearest_grid": (nearest_grid, NEAREST_GRID_SQL),
    "tbl_bond_statistics": (bond_statistics, BOND_STATISTICS_SQL),
    "tbl_polymorphs": (polymorphs, POLYMORPHS_SQL),
    "tbl_stratified_split": (stratified_split, STRATIFIED_SPLIT_SQL),
    "tbl_metric_states": (metric_states, METRIC_STATES_SQL),
    "tbl_conformal_bands": (conformal_bands, CONFORMAL_BANDS_SQL),
    "tbl_quarantined_events": (quarantined_events, QUARANTINED_EVENTS_SQL),
    "tbl_quarantine_counts": (quarantine_counts, QUARANTINE_COUNTS_SQL),
    "tbl_structure_classes": (structure_classes, STRUCTURE_CLASSES_SQL),
    "tbl_boosted_baseline": (boosted_baseline, None),
}
