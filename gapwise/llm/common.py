"""What several operators share: table access and row shapes; stored intermediate tables come from the library."""

from __future__ import annotations

import hashlib
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.sources.store import Scratch, close_all, fresh, shared_dir  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """The column of that exact name, cast, or a typed null where the table lacks it."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """body(value), with value computed once: expressions within lambdas aren't shared otherwise."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before_each(lengths: Column) -> Column:
    """For each k from 0, the sum of the first k lengths; sums over blocks keep this below the square."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def sums(v: Column) -> Column:
        n, block = F.size(v["lengths"]), v["block"]
        blocks = F.transform(F.sequence(F.lit(0), F.floor(n / block).cast("int")), lambda b: total(F.slice(v["lengths"], b * block + 1, block)))
        return let(
            blocks,
            lambda sum_of: F.transform(
                F.sequence(F.lit(0), n),
                lambda k: total(F.slice(sum_of, F.lit(1), F.floor(k / block).cast("int"))) + total(F.slice(v["lengths"], F.floor(k / block).cast("int") * block + 1, k % block)),
            ),
        )

    return let(lengths, lambda own: let(F.struct(own.alias("lengths"), F.greatest(F.lit(1), F.sqrt(F.size(own)).cast("int")).alias("block")), sums))


def grouped(batches, keys: int):
    """Runs of equal values of the first `keys` columns, which the batches are sorted by: (key, table)."""
    import numpy as np
    import pyarrow as pa

    key, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for a, b in zip([0, *change], [*change, batch.num_rows], strict=True):
            now = tuple(int(c[a]) for c in columns)
            if now != key:
                if parts:
                    yield key, pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                key, parts = now, []
            parts.append(batch.slice(a, b - a))
    if parts:
        yield key, pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


class WordCache(dict):
    """A dictionary of bounded size. Frequent words come early, so trim() keeps the earlier half and drops the later."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def trim(self) -> None:
        if len(self) > self.limit:
            self.shrink(self.limit // 2)

    def shrink(self, size: int) -> None:
        """Keeps the first `size` entries, so that a worker that waits for its next task holds little."""
        kept = list(islice(self.items(), size))
        self.clear()
        self.update(kept)


class WordHashes(dict):
    """64 bits of the BLAKE2 hash of each word that is looked up; the first `limit` words are remembered."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        number = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) < self.limit:
            self[word] = number
        return number
