"""Intermediate tables in the folder that all executors share, and names that don't clash with a table's own."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where none is set and Spark runs in one process (tests)."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        base = getattr(sc, "_gapwise_shared", None)
        if base is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = sc._gapwise_shared = "file://" + tempfile.mkdtemp(prefix="gapwise-")
            sc.setCheckpointDir(base)
    return base.rstrip("/")


class Scratch:
    """Intermediate tables as Parquet in the shared folder: they cut the lineage and outlive executors.

    drop() removes a table that no later step reads; the rest live as long as the results that read them. After each
    table the driver collects its garbage, if its heap has grown to more than HEAP_SHARE of what it may take.
    """

    HEAP_SHARE = 0.5
    opened: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        Scratch.opened.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        runtime = self.spark.sparkContext._jvm.Runtime.getRuntime()
        if runtime.totalMemory() > self.HEAP_SHARE * runtime.maxMemory():
            self.sweep()
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes these tables."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def sweep(self) -> None:
        """Has the driver collect its garbage: Spark then deletes shuffle files and broadcasts of steps that are over, which
        it does for references that are gone, and the heap shrinks."""
        self.spark.sparkContext._jvm.System.gc()

    def close(self) -> None:
        """Deletes all tables; results that read them can't be computed any more."""
        self.drop("")


def close_all(spark: SparkSession) -> None:
    """Deletes the intermediate tables of all operators of this session, once their results are stored elsewhere."""
    while Scratch.opened:
        scratch = Scratch.opened.pop()
        if scratch.spark.sparkContext is spark.sparkContext:
            scratch.close()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that the table doesn't have, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
