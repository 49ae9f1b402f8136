"""Balanced contiguous shards from global byte-size prefix sums."""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column_or_null, fresh, shared_dir


def byte_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Deals all rows, in the order of their id, to contiguous shards of near-equal bytes.

    A row's size is the UTF-8 length of its text plus one. Rows are ordered by (id, checksum, size) with a
    range exchange of these thin columns (texts do not move) and each partition's bytes are totalled; the totals,
    a few numbers for each partition, give every partition its global offset. A row belongs to the shard in
    which the middle of its byte range falls, so a shard misses its target by at most half a row at either end.

    Returns id, size, text_crc32, law ("bytes"), shard, slot (gapless from 0 in each shard), grown_shard (null), and
    the column row_col, if it is named: a number that tells rows apart, by which write_shards() finds them again.

    Long texts count whole; no row is split. Null text: size 1, checksum 0. Null ids come first. Repeated rows: each is placed; equal rows are
    interchangeable. Empty table: no rows. More shards than rows: some shards are empty. Other columns are ignored.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    text = F.coalesce(column_or_null(docs, text_col, "string"), F.lit(""))
    thin = docs.select(
        column_or_null(docs, id_col, "long").alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        (F.monotonically_increasing_id() if row_col is None else F.col(f"`{row_col}`")).cast("long").alias("tie"),
    )
    # tie spreads rows that are equal in all else over several ranges
    ordered = thin.repartitionByRange("id", "crc", "size", "tie").sortWithinPartitions("id", "crc", "size", "tie").checkpoint()

    totals = {
        r.part: (r.bytes, r.rows)
        for r in ordered.groupBy(F.spark_partition_id().alias("part")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
    }
    before, at_byte, at_row = {}, 0, 0
    for part in sorted(totals):
        before[part] = (at_byte, at_row)
        at_byte, at_row = at_byte + totals[part][0], at_row + totals[part][1]
    whole = max(1, at_byte)

    def placed(batches):
        import numpy as np

        base, row = before.get(TaskContext.get().partitionId(), (0, 0))
        for batch in batches:
            size = batch.column("size").to_numpy(zero_copy_only=False).astype(np.int64)
            end = base + np.cumsum(size)
            middle = (end - size).astype(object) * 2 + size if whole > 2**55 // shards else (end - size) * 2 + size
            shard = np.minimum(middle * shards // (2 * whole), shards - 1).astype(np.int32)
            yield batch, shard, row + np.arange(len(size), dtype=np.int64)
            base, row = (int(end[-1]), row + len(size)) if len(size) else (base, row)

    def first_rows(batches):
        import numpy as np
        import pyarrow as pa

        firsts: dict[int, int] = {}
        for _, shard, row in placed(batches):
            for s, k in zip(*np.unique(shard, return_index=True), strict=True):
                firsts.setdefault(int(s), int(row[k]))
        yield pa.RecordBatch.from_pydict({"shard": pa.array(firsts.keys(), pa.int32()), "row": pa.array(firsts.values(), pa.int64())})

    starts = {r.shard: r.row for r in ordered.mapInArrow(first_rows, "shard int, row long").groupBy("shard").agg(F.min("row").alias("row")).collect()}

    def numbered(batches):
        import numpy as np
        import pyarrow as pa

        first = np.array([starts.get(s, 0) for s in range(shards)], dtype=np.int64)
        for batch, shard, row in placed(batches):
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("size"), batch.column("crc"), pa.array(["bytes"] * n, pa.string()), pa.array(shard), pa.array(row - first[shard]), pa.nulls(n, pa.int32()), batch.column("tie")],
                names=["id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "tie"],
            )

    out = ordered.mapInArrow(numbered, "id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int, tie long")
    names = [id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    return out.toDF(*names, "tie").drop("tie") if row_col is None else out.toDF(*names, row_col)


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", files: int = 1) -> None:
    """Writes whole rows as Parquet, a folder shard=K for each shard of byte_shards(), in the order of their slots.

    A shard is cut into `files` runs of slots, each written by a task. All columns are kept, and __slot is added; where
    the table has a column of that name or of the folders', the new one ends in "_". Nulls, ties and repeated rows are as in
    byte_shards(). Rows are told apart by a stored number, so repeated ids get their own places. Long texts stay
    whole. Empty table: no folders.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    row, part, slot, count, run = fresh(docs, "row", "shard", "__slot", "rows", "run")
    rows = scratch.save(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    placed = byte_shards(rows, shards, id_col, text_col, row).toDF("id", "size", "crc", "law", part, slot, "grown", row).select(row, part, slot)
    placed = scratch.save(placed, "placed")
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias(count))
    out = rows.join(placed.join(F.broadcast(sizes), part), row).withColumn(run, F.floor(F.col(slot) * files / F.col(count)).cast("int"))  # a row for each shard
    out = out.repartition(shards * files, part, run).sortWithinPartitions(part, slot)
    out.select(*(f"`{c}`" for c in docs.columns), slot, part).write.mode("overwrite").partitionBy(part).parquet(path)
    scratch.close()
