"""Structured Streaming additions: windows with late data, and the stateless operators on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of (ts, event_type, value) by tumbling window and type; rows later than ``late`` fall away on a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    grouped = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return grouped.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "cents")


def sessions(events: DataFrame, key: str = "user_id", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each key: rows whose times (ts) are at most ``gap`` apart, with the first time, the last plus ``gap``, and the rows.

    The same on a batch and on a stream, where a session is given once the
    watermark has passed its end; rows that come later than ``late`` and would
    open or lengthen a session that is closed fall away.  Rows without a time or
    key take no part.  The state is one row for each open session.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).filter(F.col("ts").isNotNull() & F.col(key).isNotNull())
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    grouped = timed.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("finish"), "n")


def drain(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Take in what a stream's source holds, write what is closed to Parquet at ``out``, and stop; called again, it goes on from ``checkpoint``."""
    stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def run_once(spark: SparkSession, path: str, pattern: str, out: str, checkpoint: str, width: str = "1 hour") -> DataFrame:
    """Drain the files below ``path`` through a stream to Parquet at ``out``; closed windows alone are written."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)
    return drain(windowed_counts(stream, width), out, checkpoint)
