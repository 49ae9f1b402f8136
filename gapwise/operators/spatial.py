"""Neighbours in space: pairs at a key's least distance, and coordination under periodic boundaries.

Points are shuffled once, by key, and tasks sweep keys of up to SWEPT points along one axis. The points of larger keys go
to the cells of a grid whose side is the distance that matters, so each point meets those of 27 cells and no others, in
any number of tasks; a key's points are never paired as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from gapwise.sources.store import Scratch

#: Points of a key that one task sweeps, and about how many of all keys it takes.
SWEPT, SWEPT_BY_TASK = 50_000, 250_000

AXES = ("x", "y", "z")
#: Grids by whose finest mixed cell the least distance is bounded: levels halve the side, shifts keep near points from
#: lying on both sides of all borders.
LEVEL_BITS, SHIFTS = 5, 4


def _large_keys(points: DataFrame, good: Column, scratch: Scratch) -> tuple[DataFrame | None, int, int]:
    """(key) of more than SWEPT points that are good, None where no key has as many; how many points there are and are good."""
    counted = points.groupBy("key").agg(F.count(F.lit(1)).alias("points"), F.count_if(good).alias("good"))
    whole = counted.agg(F.sum("points").alias("points"), F.sum("good").alias("good"), F.max("good").alias("most")).first()
    large = scratch.save(counted.filter(F.col("good") > SWEPT).select("key"), "large") if (whole.most or 0) > SWEPT else None
    return large, whole.points or 0, whole.good or 0


def _by_key(points: DataFrame, key: Column, rows: int) -> DataFrame:
    """The points in order of their keys, as many partitions as they need and no fewer than shuffles have."""
    parts = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // SWEPT_BY_TASK))
    return points.repartition(parts, key).sortWithinPartitions(key)


def _cell(v: Column, side: Column) -> Column:
    """The cell's number; where the side is 0 the place itself, so that equal places alone meet."""
    return F.when(side > 0, F.floor(v / F.when(side > 0, side)).cast("double")).otherwise(v)


def _distance(a: str, b: str) -> Column:
    return F.sqrt(sum((F.col(f"{a}{k}") - F.col(f"{b}{k}")) * (F.col(f"{a}{k}") - F.col(f"{b}{k}")) for k in AXES))


def _around(rows: DataFrame, side: Column) -> DataFrame:
    """rows in each of the 27 cells around their own (cx, cy, cz)."""
    steps = F.when(side > 0, F.array(*map(F.lit, (-1.0, 0.0, 1.0)))).otherwise(F.array(F.lit(0.0)))
    for k in AXES:
        rows = rows.withColumn(f"step_{k}", F.explode(steps)).withColumn(f"c{k}", F.col(f"c{k}") + F.col(f"step_{k}")).drop(f"step_{k}")
    return rows


def least_distance_bounds(first: DataFrame, second: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, bound) for tables (key, x, y, z): at least the least distance of a point of the one and one of the other,
    and within a constant factor of it.

    A key's box is cut into cells whose side halves from level to level. The finest level at which a cell of one of
    SHIFTS shifted grids holds points of both tables bounds the distance by that cell's diagonal, and two points that
    are much nearer would share a finer cell in one of the grids. The level is found by bisection, for all keys at once:
    LEVEL_BITS rounds of one aggregate, whose groups are reduced before they are shuffled.
    """
    points = first.select("key", *AXES, F.lit(0).alias("of")).unionByName(second.select("key", *AXES, F.lit(1).alias("of")))
    box = points.groupBy("key").agg(*(F.min(k).alias(f"o{k}") for k in AXES), F.greatest(*(F.max(k) - F.min(k) for k in AXES)).alias("extent"), F.min("of").alias("a"), F.max("of").alias("b"))
    keys = box.filter("a != b").select("key", *(f"o{k}" for k in AXES), (2 * F.col("extent")).alias("whole"), F.lit(0).alias("low"), F.lit(1 << LEVEL_BITS).alias("high"))
    keys = scratch.save(keys, "levels-0")
    for turn in range(LEVEL_BITS):
        level = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        asked = keys.withColumn("level", level).withColumn("side", F.col("whole") / F.pow(F.lit(2.0), F.col("level").cast("double")))
        met = points.join(asked, "key").withColumn("shift", F.explode(F.array(*(F.lit(s / (2.0 * SHIFTS)) for s in range(SHIFTS)))))
        cells = met.select("key", "of", "shift", *(_cell(F.col(k) - F.col(f"o{k}") + F.col("shift") * F.col("whole"), F.col("side")).alias(f"c{k}") for k in AXES))
        mixed = cells.groupBy("key", "shift", *(f"c{k}" for k in AXES)).agg(F.min("of").alias("a"), F.max("of").alias("b")).filter("a != b").select("key").distinct().withColumn("mixed", F.lit(True))
        found = asked.join(mixed, "key", "left").withColumn("mixed", F.coalesce("mixed", F.lit(False)))
        keys = found.select("key", *(f"o{k}" for k in AXES), "whole", F.when(F.col("mixed"), F.col("level")).otherwise(F.col("low")).alias("low"), F.when(F.col("mixed"), F.col("high")).otherwise(F.col("level")).alias("high"))
        keys = scratch.save(keys, f"levels-{turn + 1}")
    # a hair more than the diagonal, against rounding
    return keys.select("key", (F.col("whole") / F.pow(F.lit(2.0), F.col("low").cast("double")) * 1.7320509).alias("bound"))


def _met(first: DataFrame, second: DataFrame, reach: DataFrame) -> DataFrame:
    """Pairs of points up to (key, reach) apart: key, a and b (their structs), dist. first and second: key, x, y, z, row."""

    def placed(points: DataFrame, name: str) -> DataFrame:
        at = points.join(reach, "key")
        return at.select("key", "reach", *(F.col(k).alias(f"{name}{k}") for k in AXES), *(_cell(F.col(k), F.col("reach")).alias(f"c{k}") for k in AXES), F.col("row").alias(name))

    cells = ["key", *(f"c{k}" for k in AXES)]
    pairs = _around(placed(first, "a"), F.col("reach")).join(placed(second, "b").drop("reach"), cells)
    return pairs.withColumn("dist", _distance("a", "b")).filter(F.col("dist") <= F.col("reach")).select("key", "a", "b", "dist")


def nearest_pairs(first: DataFrame, second: DataFrame, key: str, axes: tuple[str, str, str] = AXES, slack: float = 1.06) -> DataFrame:
    """The pairs within a key at up to `slack` times the key's least distance: key, a, b (rows as structs), dist.

    Like crystal.nearest_bonds(), for keys of any size. Up to SWEPT points a key is swept along the axis of its greatest
    extent, within one task. For larger keys a grid bounds the least distance, a join over neighbouring cells of distinct
    places finds it, reduced before it is shuffled, and a second one with cells of slack times that length gives the
    pairs: work grows with the points and with the pairs returned.

    Rows with a null or non-finite place, or a null key, are in no pair. Rows that repeat are rows of their own. A key
    that lacks points of one table gives none. Empty table: no rows.
    """
    scratch = Scratch(first.sparkSession, "nearest")

    def sound(df: DataFrame) -> DataFrame:
        good = F.col(f"`{key}`").isNotNull()
        for c in axes:
            place = F.col(f"`{c}`").cast("double")
            good = good & place.isNotNull() & (F.abs(place) < float("inf"))
        return df.filter(good)

    first, second = sound(first), sound(second)
    keys = first.select(F.col(f"`{key}`").alias("key")).unionByName(second.select(F.col(f"`{key}`").alias("key")))
    large, n_points, _ = _large_keys(keys, F.lit(True), scratch)
    if large is None:
        return _nearest_by_sweep(first, second, key, axes, slack, n_points)
    few, many = ([df.join(large.withColumnRenamed("key", key), key, how).select(*(F.col(f"`{c}`") for c in df.columns)) for df in (first, second)] for how in ("left_anti", "left_semi"))
    return _nearest_by_sweep(*few, key, axes, slack, n_points).unionByName(_nearest_by_grid(*many, key, axes, slack, scratch))


def _nearest_by_sweep(first: DataFrame, second: DataFrame, key: str, axes: tuple[str, str, str], slack: float, rows: int) -> DataFrame:
    """nearest_pairs() of sound rows, by keys of at most SWEPT points."""

    def row(df: DataFrame) -> Column:
        return F.struct(*(F.col(f"`{c}`") for c in df.columns))

    # places and keys are read from the rows behind the shuffle, so that none is moved twice
    a, b = row(first).alias("a"), row(second).alias("b")
    a, b = first.select(a), second.select(b)
    both = a.unionByName(b, allowMissingColumns=True)

    def either(c: str) -> Column:
        return F.coalesce(F.col("a").getField(c), F.col("b").getField(c))

    places = [F.coalesce(*(F.col(of).getField(c).cast("double") for of in "ab")).alias(k) for c, k in zip(axes, AXES, strict=True)]
    dealt = _by_key(both, either(key), rows).select(either(key).alias("key"), *places, "a", "b")

    def swept(batches):
        import pyarrow as pa

        from gapwise.operators import sweep

        for batch, starts in sweep.whole_keys(batches):
            second = batch.column("b").is_valid().to_numpy(zero_copy_only=False)
            for i, j, dist in sweep.nearest(starts, second, [sweep.column(batch, k) for k in AXES], slack):
                columns = [batch.column(c).take(pa.array(at)) for c, at in (("key", i), ("a", i), ("b", j))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(dist)], names=["key", "a", "b", "dist"])

    found = dealt.mapInArrow(swept, StructType([*(dealt.schema[c] for c in ("key", "a", "b")), StructField("dist", DoubleType())]))
    return found.select(F.col("key").alias(key), "a", "b", "dist")


def _nearest_by_grid(first: DataFrame, second: DataFrame, key: str, axes: tuple[str, str, str], slack: float, scratch: Scratch) -> DataFrame:
    """nearest_pairs() of sound rows, for keys of any size."""

    def points(df: DataFrame) -> DataFrame:
        places = [F.col(f"`{c}`").cast("double").alias(k) for c, k in zip(axes, AXES, strict=True)]
        return df.select(F.col(f"`{key}`").alias("key"), *places, F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))

    a, b = points(first), points(second)
    places = [p.select("key", *AXES).distinct().withColumn("row", F.lit(None).cast("int")) for p in (a, b)]
    places = [scratch.save(p, name) for p, name in zip(places, ("first", "second"), strict=True)]
    bounds = least_distance_bounds(*places, scratch)
    least = _met(*places, bounds.withColumnRenamed("bound", "reach")).groupBy("key").agg(F.min("dist").alias("least"))
    reach = scratch.save(least.select("key", (F.col("least") * slack).alias("reach")), "reach")
    return _met(a, b, reach).select(F.col("key").alias(key), "a", "b", "dist")


def coordination(points: DataFrame, key: str, id_col: str, box: tuple[float, float, float], cutoff: float, axes: tuple[str, str, str] = AXES) -> DataFrame:
    """(key, id, neighbours, mean, m2, least): for each point, its neighbours up to `cutoff` away and the moments of
    their distances, where each key's points repeat with the periods `box`. m2 is the sum of squared deviations.

    Up to SWEPT points a key is swept along the box's longest axis, within one task. The points of larger keys go to cells
    of at least the cutoff's side, which are wrapped around the box: a step over its border moves the neighbour by a
    period. A cutoff beyond a period reaches as many images as it needs, the point's own among them. Pairs are counted
    as they meet, in sums that are merged, and never listed.

    Rows that repeat an id are points of their own. Null keys, null or non-finite places: no neighbours, and none of
    another's. A point without neighbours has 0 and nulls. Empty table: no rows.
    """
    scratch = Scratch(points.sparkSession, "coordination")
    places = [F.col(f"`{c}`").cast("double") for c in axes]
    own = points.select(F.col(f"`{key}`").alias("key"), F.col(f"`{id_col}`").alias("id"), *(p.alias(k) for p, k in zip(places, AXES, strict=True)))
    sound = F.col("key").isNotNull()
    for k in AXES:
        sound = sound & F.col(k).isNotNull() & (F.abs(F.col(k)) < float("inf"))
    sound = F.coalesce(sound, F.lit(False))
    large, n_points, n_good = _large_keys(own, sound, scratch)
    good = own.filter(sound)
    found = _coordination_by_sweep(good if large is None else good.join(large, "key", "left_anti"), box, cutoff, n_good)
    if large is not None:
        found = found.unionByName(_coordination_by_grid(good.join(large, "key", "left_semi"), box, cutoff, scratch))
    if n_good < n_points:
        none = F.lit(None).cast("double")
        found = found.unionByName(own.filter(~sound).select("key", "id", F.lit(0).cast("long").alias("neighbours"), none.alias("mean"), none.alias("m2"), none.alias("least")))
    return found.select(F.col("key").alias(key), F.col("id").alias(id_col), "neighbours", "mean", "m2", "least")


def _coordination_by_sweep(points: DataFrame, box: tuple[float, float, float], cutoff: float, rows: int) -> DataFrame:
    """coordination() of sound points, by keys of at most SWEPT."""

    def swept(batches):
        import pyarrow as pa

        from gapwise.operators import sweep

        for batch, starts in sweep.whole_keys(batches):
            count, *moments = sweep.neighbour_moments(starts, [sweep.column(batch, k) for k in AXES], box, cutoff)
            columns = [batch.column("key"), batch.column("id"), pa.array(count), *(pa.array(m, mask=count == 0) for m in moments)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "neighbours", "mean", "m2", "least"])

    fields = [StructField("neighbours", LongType()), *(StructField(c, DoubleType()) for c in ("mean", "m2", "least"))]
    return _by_key(points, F.col("key"), rows).mapInArrow(swept, StructType([points.schema["key"], points.schema["id"], *fields]))


def _coordination_by_grid(points: DataFrame, box: tuple[float, float, float], cutoff: float, scratch: Scratch) -> DataFrame:
    """coordination() of sound points, for keys of any size. Rows are told apart by a stored number.

    Where a period is more than twice the cutoff, a distance is that of the places as given less whole periods, as in a sweep.
    """
    own = scratch.save(points.withColumn("row", F.monotonically_increasing_id()), "points")
    good = own
    single = [2.000001 * cutoff < length for length in box]
    cells = [max(1, int(length // cutoff)) for length in box]
    steps = [max(1, -int(-cutoff // (length / n))) for length, n in zip(box, cells, strict=True)]
    for k, length, n, alone in zip(AXES, box, cells, single, strict=True):
        wrapped = F.col(k) - F.floor(F.col(k) / length) * length
        good = good.withColumn(f"c{k}", F.least(F.floor(wrapped / (length / n)), F.lit(n - 1)))
        good = good if alone else good.withColumn(k, wrapped)
    left = good.select("key", F.col("row").alias("a"), *(F.col(k).alias(f"a{k}") for k in AXES), *(f"c{k}" for k in AXES))
    for k, length, n, far, alone in zip(AXES, box, cells, steps, single, strict=True):
        # a cell meets another once, where one image alone can be near
        around = F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")) if alone and n <= 2 * far else F.sequence(F.col(f"c{k}") - far, F.col(f"c{k}") + far)
        left = left.withColumn("raw", F.explode(around))
        left = left.withColumn(f"s{k}", F.floor(F.col("raw") / n) * length).withColumn(f"c{k}", F.pmod("raw", F.lit(n))).drop("raw")
    right = good.select("key", F.col("row").alias("b"), *(F.col(k).alias(f"b{k}") for k in AXES), *(f"c{k}" for k in AXES))
    met = left.join(right, ["key", *(f"c{k}" for k in AXES)])

    def apart(k: str, length: float, alone: bool) -> Column:
        if not alone:
            return F.col(f"b{k}") + F.col(f"s{k}") - F.col(f"a{k}")
        d = F.col(f"b{k}") - F.col(f"a{k}")
        return d - F.rint(d / length) * length

    itself = (F.col("a") == F.col("b")) & (F.abs(F.col("sx")) + F.abs(F.col("sy")) + F.abs(F.col("sz")) == 0)
    squares = sum(d * d for d in map(apart, AXES, box, single))
    met = met.filter(~itself).withColumn("dist", F.sqrt(squares)).filter(F.col("dist") <= cutoff)
    moments = met.groupBy("a").agg(F.count(F.lit(1)).alias("neighbours"), F.avg("dist").alias("mean"), (F.var_pop("dist") * F.count(F.lit(1))).alias("m2"), F.min("dist").alias("least"))
    out = own.join(moments, F.col("row") == F.col("a"), "left")
    return out.select("key", "id", F.coalesce("neighbours", F.lit(0)).alias("neighbours"), "mean", "m2", "least")


def bond_statistics(found: DataFrame, key: str) -> DataFrame:
    """(key, points, bonds, mean_coordination, most, mean_length, length_sd, least) from the rows of coordination().

    Tasks reduce their rows to a state for each key and batch, which are stored. Moments are merged about the key's mean,
    so nothing cancels. A bond is seen from both its ends and counts once.
    """
    rows = found.select(F.col(f"`{key}`").alias("key"), "neighbours", "mean", "m2", "least")

    def reduced(batches):
        from gapwise.operators import sweep

        for batch in batches:
            if batch.num_rows:
                yield sweep.key_states(batch)

    counts = [StructField(c, LongType()) for c in ("points", "neighbours", "most")]
    states = rows.mapInArrow(reduced, StructType([rows.schema["key"], *counts, *(rows.schema[c] for c in ("mean", "m2", "least"))]))
    states = Scratch(found.sparkSession, "bonds").save(states, "states")
    weight = F.sum("neighbours")
    some = F.when(weight > 0, weight)
    means = states.groupBy("key").agg((F.sum(F.col("neighbours") * F.col("mean")) / some).alias("mean_length")).select(F.col("key").alias("of"), "mean_length")
    met = states.join(means, F.col("key").eqNullSafe(F.col("of")))
    off = F.col("mean") - F.col("mean_length")
    squares = F.sum(F.col("m2") + F.col("neighbours") * off * off)
    return met.groupBy("key").agg(
        F.sum("points").alias("points"), (weight / 2).alias("bonds"), (weight / F.sum("points")).alias("mean_coordination"), F.max("most").alias("most"),
        F.first("mean_length").alias("mean_length"), F.sqrt(squares / some).alias("length_sd"), F.min("least").alias("least"),
    ).withColumnRenamed("key", key)
