"""Shared helpers: intermediate tables, Arrow iteration, connected components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches of long texts small enough for a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def shared_root(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or a fresh one where it is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Workspace:
    """Intermediate tables of one run, written to the shared folder and reread.

    A written table cuts the lineage, so that a lost executor costs only the
    stage in hand.  ``drop`` removes tables that the result no longer reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def write(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        df.write.option("compression", compression).parquet(self.at(name))
        return self.spark.read.schema(df.schema).parquet(self.at(name))

    def drop(self, *names: str) -> None:
        """Delete tables, and let Spark delete the shuffle files of frames that are no longer held."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.at(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        jvm.System.gc()


def free_names(taken: list[str], *names: str) -> list[str]:
    """Each of ``names``, with underscores before it until no column of ``taken`` has it (in any case)."""
    known, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in known:
            name = "_" + name
        known.add(name.lower())
        out.append(name)
    return out


def text_rows(batches, text: str = "text"):
    """(batch, list of UTF-8 texts as str, None for null) for each Arrow batch that has rows."""
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column(text).to_pylist()


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def id_column(values) -> pa.Array:
    return pa.array(values, pa.int64())


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rooted(edges: DataFrame) -> bool:
    """Whether each node a of the distinct ``edges`` (a, b) has one b, which is no a itself."""
    places = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return places.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def components(ws: Workspace, edges: DataFrame, name: str, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b long): rows (node, component), component the smallest node.

    Alternates large-star and small-star contraction (Kiveris et al. 2014) on
    tables in the shared folder until all edges are from nodes to roots; nothing
    is collected but whether they are.  Nodes without edges do not appear.
    """
    current = ws.write(
        edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        f"{name}_e0",
    )
    for step in range(1, most_rounds + 1):
        if rooted(current):
            break
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = ws.write(large.filter("a != b").distinct(), f"{name}_l{step}")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.filter("a != b").union(low.select("a", F.col("m").alias("b"))).distinct()
        current = ws.write(small, f"{name}_e{step}")
        del both, low, large, small
        ws.drop(f"{name}_e{step - 1}", f"{name}_l{step}")
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
