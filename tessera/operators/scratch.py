"""Tables of one run in the folder that spark.checkpoint.dir names; written and reread, they cut the lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once: rows of files and texts become many times larger as Python objects."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


@contextmanager
def batches_of(spark: SparkSession, longest: int) -> Iterator[None]:
    """Larger batches, and smaller parts of files, for what is run meanwhile on narrow rows of at most ``longest`` bytes, which Python reads by arrays.

    Their bytes are bounded by the number of rows alone: under a limit of bytes
    Spark sizes up all columns of a batch again with each row, which takes
    longer than all else that it does to pass rows to Python.  Files of such
    rows hold so many of them in a MB that a shuffle of a whole part would spill.
    """
    own = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(min(max((32 << 20) // max(longest, 1), 100), 5000)), "spark.sql.execution.arrow.maxBytesPerBatch": str((1 << 31) - 1), "spark.sql.files.maxPartitionBytes": str(16 << 20)}
    before = {name: spark.conf.get(name) for name in own}
    try:
        for name, value in own.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt out over all cores before long work on each: a narrow table may lie in one row group, which is one task's.

    By number, as partitions by key are put together again where they are small.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


class Scratch:
    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="tessera-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.spark, self.path = spark, f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str, append: bool = False, part: int = 128 << 20) -> DataFrame:
        """``part`` bounds the bytes of a row group, the least that a task reads later."""
        at = f"{self.path}/{name}"
        df.write.mode("append" if append else "errorifexists").option("parquet.block.size", part).parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)
