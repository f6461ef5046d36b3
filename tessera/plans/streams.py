"""Queries of the streaming additions, over the table as a batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.scratch import Scratch
from tessera.plans.registry import query, read
from tessera.streaming import events


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL")
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.windowed_counts(read(spark, sf_dir, "events"))


@query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events
WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY ALL
""")
def hourly_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a stream that drains the files there are: windows that the watermark has closed."""
    ws = Scratch(spark, "stream")
    return events.run_once(spark, sf_dir, "events.parquet", f"{ws.path}/out", f"{ws.path}/log")


SESSIONS = """
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS finish, count(*) AS n FROM s GROUP BY user_id, k
"""


@query(SESSIONS)
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.sessions(read(spark, sf_dir, "events"))


@query(f"SELECT * FROM ({SESSIONS}) WHERE finish <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR")
def sessions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through a stream: sessions that the watermark has closed."""
    ws = Scratch(spark, "sessions")
    kinds = read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(kinds).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return events.drain(events.sessions(stream), f"{ws.path}/out", f"{ws.path}/log")
