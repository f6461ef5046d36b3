"""Sessions on a batch, and on a stream of several batches with a restart and late rows."""

from __future__ import annotations

import datetime as dt
import random

from tessera.streaming import events

DAY = dt.datetime(2024, 5, 1)
KIND = "event_id long, ts timestamp_ntz, user_id long"


def by_hand(rows, gap=dt.timedelta(minutes=30)):
    out = []
    for user in {u for _, t, u in rows if t is not None and u is not None}:
        times = sorted(t for _, t, u in rows if u == user and t is not None)
        first, last, n = times[0], times[0], 0
        for t in times:
            if t - last > gap:
                out.append((user, first, last + gap, n))
                first, n = t, 0
            last, n = t, n + 1
        out.append((user, first, last + gap, n))
    return sorted(out)


def made(seed=3):
    r = random.Random(seed)
    rows = [(k, DAY + dt.timedelta(minutes=5 * r.randrange(600)), r.randrange(8)) for k in range(400)]
    return rows + [(900, None, 1), (901, DAY, None), (902, rows[0][1], rows[0][2])]


def test_sessions_of_a_batch(spark):
    rows = made()
    got = events.sessions(spark.createDataFrame(rows, KIND)).collect()
    assert sorted(map(tuple, got)) == by_hand(rows)
    assert events.sessions(spark.createDataFrame([], KIND)).collect() == []


def test_sessions_of_a_stream_with_restarts(spark, tmp_path):
    rows = sorted(made(7), key=lambda x: (x[1] or DAY, x[0]))
    steps = [rows[:150], rows[150:300], rows[300:]]
    held = [steps[0].pop(-k) for k in (5, 11)]
    steps[1] += held  # late by less than the watermark's delay
    steps.append([(990, DAY + dt.timedelta(days=9), 99)])
    steps.append([(991, DAY + dt.timedelta(hours=1), 99), (992, DAY + dt.timedelta(days=9, minutes=1), 99)])  # 991 comes too late
    for k, step in enumerate(steps):
        spark.createDataFrame(step, KIND).coalesce(1).write.parquet(f"{tmp_path}/in/step{k}")
        stream = spark.readStream.schema(KIND).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        got = events.drain(events.sessions(stream), f"{tmp_path}/out", f"{tmp_path}/log")  # a new query each time, from the checkpoint
    assert sorted(map(tuple, got.collect())) == by_hand(rows)
