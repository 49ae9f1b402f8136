"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

import math

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column_or_null, grouped
from .components import connected_components

#: Bits of the concatenated hashes that order a pass, vectors of a block, and the chance that a pair at the
#: threshold meets in no pass, above which a vector is compared with all others of its label.
CODE_BITS, BLOCK, MISS = 48, 512, 1e-3
#: Passes that are sorted in one exchange, after the first, which alone settles labels of up to two blocks.
PASSES_AT_ONCE = 4
#: Blocks that are taken as one where vectors are compared with all of their label.
BLOCKS_AT_ONCE = 4
#: A sixteenth of a bit of information is the unit in which chances are kept; the largest number stands for none.
UNIT, NEVER = 16, 255


def projections(turn: int, dimension: int) -> np.ndarray:
    """The hyperplanes of a pass."""
    return np.random.default_rng([99, turn, dimension]).standard_normal((dimension, CODE_BITS))


def codes(vectors: np.ndarray, turn: int) -> np.ndarray:
    """The signs' bits, the first highest: order by this number is lexicographic order of the hashes."""
    bits = (vectors @ projections(turn, vectors.shape[1])) > 0
    return bits @ (1 << np.arange(CODE_BITS - 1, -1, -1, dtype=np.int64))


def normal_share(z: np.ndarray) -> np.ndarray:
    """The standard normal distribution function, within 1e-7 (Abramowitz and Stegun 7.1.26)."""
    x = np.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-x * x) / 2
    return np.where(z >= 0, 1 - tail, tail)


def agreements(vectors: np.ndarray, turn: int, least_cosine: float) -> np.ndarray:
    """For each vector and each number of first bits, the chance that a partner at the threshold has the same bits.

    Given the hyperplanes and the vector, over all directions of the partner. As -log2, in units, rounded up.
    """
    planes = projections(turn, vectors.shape[1])
    margin = np.minimum(np.abs(vectors @ planes) / np.sqrt((planes * planes).sum(axis=0)), 1.0)
    spread = math.sqrt(max(0.0, 1 - least_cosine**2)) * np.sqrt((1 - margin * margin) / max(1, vectors.shape[1] - 1))
    share = normal_share(least_cosine * margin / np.maximum(spread, 1e-12))
    return np.minimum(np.ceil(-UNIT * np.cumsum(np.log2(np.maximum(share, 1e-300)), axis=1)), NEVER).astype(np.uint8)


def rows_of(column) -> tuple[np.ndarray, np.ndarray] | None:
    """(positions, matrix) where all lists have one length and no null; None otherwise."""
    if column.null_count or not len(column):
        return None
    values, offsets = column.flatten(), np.diff(column.offsets.to_numpy())
    if values.null_count or offsets.min() != offsets.max() or not offsets[0]:
        return None
    return np.arange(len(column)), values.to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def matrix(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """Unit vectors in double precision, by dimension: (positions, rows). Zero, null and non-finite ones are left out."""
    if (whole := rows_of(column)) is not None:
        parts = [whole]
    else:
        by: dict[int, list[int]] = {}
        lists = column.to_pylist()
        for k, v in enumerate(lists):
            if v and None not in v:
                by.setdefault(len(v), []).append(k)
        parts = [(np.array(at), np.array([lists[k] for k in at], dtype=np.float64)) for at in by.values()]
    out = []
    for at, rows in parts:
        top = np.abs(rows).max(axis=1)
        good = np.isfinite(top) & (top > 0)
        rows = rows[good] / top[good, None]  # keeps the squares in range
        out.append((at[good], rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))))
    return [(at, rows) for at, rows in out if len(at)]


def linked(here: np.ndarray, there: np.ndarray, least_cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of unit rows of the one and of the other whose cosine is at least least_cosine."""
    a, b = np.nonzero(here @ there.T >= least_cosine - 1e-9)
    exact = (here[a] * there[b]).sum(axis=1) >= least_cosine
    return a[exact], b[exact]


def met_before(column) -> np.ndarray:
    """The block numbers of earlier passes, a row for each vector."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), len(values) // len(column))


def forest(row: np.ndarray, copies: np.ndarray, a: np.ndarray, b: np.ndarray):
    """(row, n, head) of the links between the places a and b: how many vectors each place links with, and the least
    row that they lead to."""
    import pyarrow as pa

    n = np.zeros(len(row), np.int64)
    np.add.at(n, a, copies[b])
    np.add.at(n, b, copies[a])
    head = row.copy()
    while True:
        new = head.copy()
        np.minimum.at(new, a, head[b])
        np.minimum.at(new, b, head[a])
        if (new == head).all():
            break
        head = new
    some = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([pa.array(row[some]), pa.array(n[some]), pa.array(head[some])], names=["row", "n", "head"])


def near_vectors(vectors: DataFrame, least_cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """For each vector: id, n_links, component_id, kept.

    Vectors link if their labels are equal and their cosine, in double precision, is at least least_cosine.
    n_links counts other rows linked directly, component_id is the least id that links reach, kept tells the row
    that bears it.

    1. Equal vectors of a label are one, with the number of its copies; they link with each other.
    2. In each pass the vectors are ordered by label and concatenated random hyperplane hashes. A global position
       comes from the rows counted in each partition, and cuts the order into blocks.
    3. A task compares a block with itself and the next one, so each vector meets its neighbours on either side.
       A pair counts in the first pass in which it meets, which the block numbers of earlier passes tell. A task
       returns counts and a spanning forest of its links, not the pairs. The bits that set a vector's two
       neighbouring blocks apart from the rest of its label are measured in each pass, and with them the chance
       that it misses a partner at the threshold.
    4. Passes go on with the labels that have vectors whose chance is still above MISS, until comparing these vectors
       with all others of their label, which is exact, costs no more than the next passes. So it is done. All forests
       are united.
    So each pair that links is found and counted but with chance MISS at the threshold, less above it, in groups of any
    size.

    Null labels, null, empty or zero vectors, or components that are null or not finite: no links. Vectors of
    different dimension don't link. Null ids: such rows take part; a component without any id has none. Repeated
    rows are rows of their own. Empty table: no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    single = vector_col in vectors.columns and vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    vector = column_or_null(vectors, vector_col, "array<float>" if single else "array<double>")
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), column_or_null(vectors, id_col, "long").alias("id"), column_or_null(vectors, label_col, "string").alias("label"), vector.alias("vector"))
    sound = F.col("label").isNotNull() & (F.size("vector") > 0) & F.forall("vector", _finite) & F.exists("vector", lambda x: x != 0)
    # 128 bits tell equal vectors
    rows = rows.select("*", F.coalesce(sound, F.lit(False)).alias("sound"), F.xxhash64("label", "vector").alias("h1"), F.xxhash64(F.lit("second"), "vector", "label").alias("h2"))
    rows = scratch.save(rows, "rows")
    distinct = rows.filter("sound").groupBy("h1", "h2").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("copies"))
    distinct = scratch.save(distinct, "distinct")
    usable = rows.select("row", "label", "vector").join(distinct.select(F.col("first").alias("row"), "copies"), "row").select("row", "label", "vector", "copies")
    usable = scratch.save(usable, "usable")
    sizes = scratch.save(usable.groupBy("label").agg(F.count(F.lit(1)).alias("size")), "sizes")
    number = sizes.agg(F.sum("size")).first()[0] or 0

    placed = usable.select("*", F.array().cast("array<int>").alias("seen"), F.lit(0.0).alias("log_miss"))
    found, tables, turns, rest = _all_compared(placed.limit(0), least_cosine), [], [0], 0
    while number:
        wide = _blocks(placed.select(*usable.columns), turns, least_cosine).groupBy("row").agg(F.sum("log_miss").alias("more"), *(F.max(F.when(F.col("turn") == t, F.col("block"))).cast("int").alias(f"b{t}") for t in turns))
        placed = placed.join(wide, "row").select("row", "label", "vector", "copies", F.concat("seen", F.array(*(f"b{t}" for t in turns))).alias("seen"), (F.col("log_miss") + F.col("more")).alias("log_miss"))
        placed = scratch.save(placed, f"placed-{turns[0]}")
        met = scratch.save(_compared(placed.select("row", "label", "vector", "copies", "seen"), turns, least_cosine), f"met-{turns[0]}")
        tables += [f"placed-{turns[0]}", f"met-{turns[0]}"]
        found = found.unionByName(met)
        unsettled = scratch.save(placed.filter(F.col("log_miss") > math.log(MISS)).groupBy("label").agg(F.count(F.lit(1)).alias("n")), f"unsettled-{turns[0]}")
        number, rest = unsettled.join(sizes, "label").agg(F.sum("size"), F.sum(F.col("n").cast("double") * F.col("size"))).first()
        placed = placed.join(unsettled.select("label"), "label", "left_semi").select(*placed.columns)
        if (rest or 0) <= (number or 0) * 2 * BLOCK * PASSES_AT_ONCE:
            break
        turns = list(range(turns[-1] + 1, turns[-1] + 1 + PASSES_AT_ONCE))
    if rest:
        found = found.unionByName(scratch.save(_all_compared(placed, least_cosine), "met-all"))
    roots = connected_components(found.select(F.col("row").alias("a"), F.col("head").alias("b")), scratch, "roots")
    counts = scratch.save(found.groupBy("row").agg(F.sum("n").alias("n_links")), "counts")
    scratch.drop("usable", "met-all", *tables)
    linked_rows = roots.select(F.col("node").alias("first"), "root").join(counts.withColumnRenamed("row", "first"), "first")

    joined = rows.select("row", "id", F.when(F.col("sound"), F.col("h1")).alias("h1"), "h2").join(distinct, ["h1", "h2"], "left").join(linked_rows, "first", "left")
    others = F.coalesce("n_links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1
    joined = joined.select("id", others.cast("long").alias("n_links"), F.coalesce("root", "first", "row").alias("root"))
    least = joined.groupBy("root").agg(F.min("id").alias("component_id"))
    out = joined.join(least, "root")
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _finite(x):
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def _positioned(ordered: DataFrame, key: str) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """A stored copy of a sorted frame, and for each (partition, key) the rows of that key in earlier partitions.

    The counts are a few numbers for each partition.
    """
    stored = ordered.checkpoint()
    counted = stored.groupBy(F.spark_partition_id().alias("part"), key).agg(F.count(F.lit(1)).alias("n")).collect()
    before, done = {}, {}
    for r in sorted(counted, key=lambda r: r.part):
        before[(r.part, r[key])] = done.get(r[key], 0)
        done[r[key]] = done.get(r[key], 0) + r.n
    return stored, before


def _numbered(stored: DataFrame, before: dict, key: str, size: int, more: tuple[str, ...] = ()) -> DataFrame:
    """(key, row, block) and the columns in `more`: blocks of `size` consecutive rows of each key."""

    def run(batches):
        import pyarrow as pa

        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            keys, rows = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            position = np.empty(len(keys), np.int64)
            for k in np.unique(keys):
                at = np.flatnonzero(keys == k)
                start = seen.get(int(k), before.get((part, int(k)), 0))
                position[at] = start + np.arange(len(at))
                seen[int(k)] = start + len(at)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(position // size), *batch.columns[2:]], names=[key, "row", "block", *more])

    thin = stored.select(key, "row", *more)
    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in thin.schema[2:])
    return thin.mapInArrow(run, f"{key} int, row long, block long{kinds}")


def _blocks(usable: DataFrame, turns: list[int], least_cosine: float) -> DataFrame:
    """(turn, row, block, log_miss): the block of each usable vector in each pass, and the logarithm of the chance
    that a partner at the threshold lies beyond the neighbouring blocks."""

    def coded(batches):
        import pyarrow as pa

        for batch in batches:
            row, label = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            for at, unit in matrix(batch.column(2)):
                for turn in turns:
                    n = len(at)
                    agree = pa.array([a.tobytes() for a in agreements(unit, turn, least_cosine)], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([turn] * n, pa.int32()), label.take(pa.array(at)), pa.array([unit.shape[1]] * n, pa.int32()), pa.array(codes(unit, turn)), pa.array(row[at]), agree], names=["turn", "label", "dimension", "code", "row", "agree"]
                    )

    thin = usable.mapInArrow(coded, "turn int, label string, dimension int, code long, row long, agree binary")
    order = ["turn", "label", "dimension", "code", "row"]
    numbered = _numbered(*_positioned(thin.repartitionByRange(*order).sortWithinPartitions(*order), "turn"), "turn", BLOCK, ("label", "dimension", "code", "agree"))
    place = F.struct("label", "dimension", "code")
    ends = numbered.groupBy("turn", "block").agg(F.min(place).alias("low"), F.max(place).alias("high"))
    below = ends.select("turn", (F.col("block") + 2).alias("block"), F.col("high").alias("below"))
    above = ends.select("turn", (F.col("block") - 2).alias("block"), F.col("low").alias("above"))

    def shared(other: str):
        """First bits that the row has in common with a place out of reach; -1 where there is none in its label."""
        apart = F.col("code").bitwiseXOR(F.col(f"{other}.code"))
        same = (F.col(f"{other}.label") == F.col("label")) & (F.col(f"{other}.dimension") == F.col("dimension"))
        return F.when(same, F.when(apart == 0, CODE_BITS).otherwise(CODE_BITS - F.length(F.bin(apart)))).otherwise(-1)

    met = numbered.join(below, ["turn", "block"], "left").join(above, ["turn", "block"], "left").withColumn("bits", F.greatest(shared("below"), shared("above")) + 1)
    # one byte for each number of bits
    units = F.conv(F.hex(F.expr("substring(agree, bits, 1)")), 16, 10).cast("int")
    met = met.select("turn", "row", "block", F.when(F.col("bits") == 0, 0).when(F.col("bits") > CODE_BITS, NEVER).otherwise(units).alias("units"))
    chance = F.pow(F.lit(2.0), -F.col("units") / UNIT)
    return met.select("turn", "row", "block", F.when(F.col("units") == NEVER, 0.0).when(F.col("units") == 0, -1e9).otherwise(F.log1p(-chance)).alias("log_miss"))


def _compared(placed: DataFrame, turns: list[int], least_cosine: float) -> DataFrame:
    """(row, n, head): in how many links a row newly meets in a group, and the least row that they join it to there.

    Each vector goes to its own block's group and, as a neighbour, to the group of the block before. A group holds
    at most two blocks.
    """
    own = placed.select("*", F.explode(F.array(*map(F.lit, turns))).alias("turn")).withColumn("block", F.get("seen", F.col("turn")))
    spread = own.select("turn", F.explode(F.array(F.struct(F.col("block").alias("group"), F.lit(0).alias("next")), F.struct((F.col("block") - 1).alias("group"), F.lit(1).alias("next")))).alias("g"), "row", "label", "vector", "seen", "copies")
    spread = spread.select("turn", "g.group", "g.next", "row", "label", "vector", "seen", "copies")

    def run(batches):
        for (turn, _), rows in grouped(batches, 2):
            nxt, row, copies = (rows.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 7))
            label = np.array(rows.column(4).to_pylist(), dtype=object)
            seen = met_before(rows.column(6))
            left, right = [], []
            for at, unit in matrix(rows.column(5)):
                mine = np.flatnonzero(nxt[at] == 0)
                if not len(mine):
                    continue
                a, b = linked(unit[mine], unit, least_cosine)
                a, b = at[mine[a]], at[b]
                good = (label[a] == label[b]) & ((nxt[b] == 1) | (a < b))
                for t in range(turn):
                    good &= np.abs(seen[a, t] - seen[b, t]) > 1
                left.append(a[good])
                right.append(b[good])
            if not left or not sum(map(len, left)):
                continue
            yield forest(row, copies, np.concatenate(left), np.concatenate(right))

    return spread.repartition("turn", "group").sortWithinPartitions("turn", "group").mapInArrow(run, "row long, n long, head long")


def _all_compared(placed: DataFrame, least_cosine: float) -> DataFrame:
    """(row, n, head): the links that no pass has met, of the vectors whose passes don't settle them.

    Within a label such vectors come first, and the blocks that hold them are compared with all blocks of the label.
    """
    log_miss = F.col("log_miss") > math.log(MISS)
    rows = placed.select("row", "label", "vector", "copies", "seen", log_miss.alias("open"))
    rows = rows.join(rows.filter("open").select("label").distinct(), "label", "left_semi")
    thin = rows.select(F.lit(0).alias("all"), "label", (~F.col("open")).alias("settled"), "row").repartitionByRange("label", "settled", "row").sortWithinPartitions("label", "settled", "row")
    numbered = _numbered(*_positioned(thin, "all"), "all", BLOCK * BLOCKS_AT_ONCE).select("row", "block")
    rows = rows.join(numbered, "row")
    ranges = rows.groupBy("label").agg(F.min("block").alias("low"), F.max("block").alias("high"), F.max(F.when(F.col("open"), F.col("block"))).alias("last"))
    met = rows.join(ranges, "label").withColumn("other", F.explode(F.sequence("low", "high"))).filter(F.least("block", "other") <= F.col("last"))
    met = met.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.when(F.col("block") <= F.col("other"), 0).otherwise(1).alias("side"), "row", "label", "vector", "seen", "copies")

    def run(batches):
        for (i, j), part in grouped(batches, 2):
            side, row, copies = (part.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 7))
            label = np.array(part.column(4).to_pylist(), dtype=object)
            seen = met_before(part.column(6))
            left, right = [], []
            for at, unit in matrix(part.column(5)):
                mine = np.flatnonzero(side[at] == 0)
                other = mine if i == j else np.flatnonzero(side[at] == 1)
                if not len(mine) or not len(other):
                    continue
                a, b = linked(unit[mine], unit[other], least_cosine)
                a, b = at[mine[a]], at[other[b]]
                good = (label[a] == label[b]) & ((a < b) | (i != j))
                for t in range(seen.shape[1]):
                    good &= np.abs(seen[a, t] - seen[b, t]) > 1
                left.append(a[good])
                right.append(b[good])
            if left and sum(map(len, left)):
                yield forest(row, copies, np.concatenate(left), np.concatenate(right))

    return met.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(run, "row long, n long, head long")
