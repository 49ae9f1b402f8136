"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, column_or_null, fresh

#: Expected copies are counted in units of 2**-30, so that prefix sums are exact.
UNIT_BITS = 30
#: What counts as a word.
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), most_copies: int = 2) -> DataFrame:
    """(source, source_size, target, rate): the words that the mix takes from each source, and the expected copies of
    each of its documents, in units of 2**-UNIT_BITS.

    Sources in the order of their code points, null last, weigh as `weights`, repeating, and share share[0] / share[1]
    of all words. No target passes most_copies times its source's size; what is above is shared again by weight, until
    none is above. That ends at one level: in the order of size / weight, the sources before the first whose part of
    what is left fits are full, and the others take what is left by weight.

    The table has a row for each source, however many documents there are, and is ordered as a whole.
    """
    top, bottom = share
    every = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    out = sources.withColumn("place", place).withColumn("full", most_copies * F.col("source_size"))
    out = out.withColumn("weight", F.element_at(F.array(*(F.lit(int(w)).cast("long") for w in weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    order = Window.orderBy(F.col("full") / F.col("weight"), "place")
    taken = F.coalesce(F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = out.select(
        "*",
        F.row_number().over(order).alias("turn"),
        # words left for this source and those after it, times bottom
        (top * F.sum("source_size").over(every) - bottom * taken).alias("rest"),
        F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("open"),
    )
    fits = F.col("rest") * F.col("weight") < bottom * F.col("full") * F.col("open")
    out = out.withColumn("first", F.min(F.when(fits, F.struct("turn", "rest", "open"))).over(every))
    by_weight = (F.col("first.rest") * F.col("weight")).cast("double") / (bottom * F.col("first.open")).cast("double")
    is_full = F.col("first").isNull() | (F.col("turn") < F.col("first.turn"))
    out = out.withColumn("target", F.when(is_full, F.col("full").cast("double")).otherwise(by_weight))
    rate = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * (1 << UNIT_BITS))).otherwise(0)
    return out.select("source", "source_size", "target", rate.cast("long").alias("rate"))


def mixed_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: tuple[int, int] = (3, 2),
    most_copies: int = 2,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    row_col: str | None = None,
) -> DataFrame:
    """How often the mix takes each document: id, size (words), source_size, target (of its source), taken (words, copies
    counted), source, copies and, if it's named, row_col, a number that tells rows apart.

    All documents of a source have the same expected copies, target / source_size. They are ordered by size, largest
    first; with one random offset for the source (from `seed`), a document is taken once for each integer that the
    prefix sum of expected copies crosses on it. So it's taken the floor or the ceiling of its expected copies, and a
    source's words miss its target by at most its largest document.

    Prefix sums run over a range exchange by (source, size, id): each range counts its rows for each source, the counts
    of earlier ranges are summed for each source, and each range starts with that carry; a hot source is cut into many
    ranges. Counts are integers, so reruns give the same rows whatever the ranges are.

    Null or empty text: size 0, takes no words. A null source is one of its own, after all others. Null ids come last
    within their size. Rows that repeat an id are documents of their own; equal rows are interchangeable. Long texts
    count whole. Empty table: no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    thin = docs.select(
        column_or_null(docs, id_col, "long").alias("id"),
        column_or_null(docs, source_col, "string").alias("source"),
        F.coalesce(F.regexp_count(column_or_null(docs, text_col, "string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        (F.monotonically_increasing_id() if row_col is None else F.col(f"`{row_col}`").cast("long")).alias("row"),
    )
    thin = scratch.save(thin, "thin")
    sources = scratch.save(source_targets(thin.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most_copies), "sources")
    keys = (F.col("source").asc_nulls_last(), F.col("size").desc(), F.col("id").asc_nulls_last(), F.col("row"))
    # row spreads rows that are equal in all else over several ranges
    ordered = scratch.save(thin.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "ordered")
    scratch.drop("thin")

    held = ordered.groupBy("source", "part").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(F.col("source").alias("of"), F.col("part").alias("in_part"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")).cast("string")), 256), 1, 7)
    offset = F.shiftleft(F.conv(digits, 16, 10).cast("long"), UNIT_BITS - 28)
    whole = F.lit(1 << UNIT_BITS)
    carries = held.join(sources, F.col("of").eqNullSafe(F.col("source"))).select(
        "of", "in_part", "source_size", "target", "rate", ((F.col("start") % whole * F.col("rate") + offset) % whole).alias("carry")
    )
    carries = scratch.save(carries, "carries")

    counted = ordered.withColumn("k", F.row_number().over(Window.partitionBy("part", "source").orderBy(*keys[1:])).cast("long"))
    both = counted.join(carries, (F.col("part") == F.col("in_part")) & F.col("source").eqNullSafe(F.col("of")))

    def crossed(k: Column) -> Column:
        """Integers up to the k-th row of the part."""
        return F.shiftright(F.col("carry") + k * F.col("rate"), UNIT_BITS)

    copies = crossed(F.col("k")) - crossed(F.col("k") - 1)
    out = both.select("id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), "source", copies.alias("copies"), "row")
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", F.col("source").alias(source_col), "copies", *([] if row_col is None else [F.col("row").alias(row_col)]))


def mixture(docs: DataFrame, **settings) -> DataFrame:
    """The rows of the mix, with all columns: each document as often as mixed_sources(docs, **settings) takes it.

    Rows are told apart by a stored number, so repeated ids get their own copies; edge cases are as there.
    """
    scratch = Scratch(docs.sparkSession, "mixture")
    row, times = fresh(docs, "row", "times")
    rows = scratch.save(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    copies = mixed_sources(rows, row_col=row, **settings).filter("copies > 0").select(row, F.array_repeat(F.lit(1), F.col("copies").cast("int")).alias(times))
    return rows.join(copies, row).withColumn(times, F.explode(times)).select(*(f"`{c}`" for c in docs.columns))
