"""Exact search against all inner products."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest

from tessera.llm import topk
from tessera.llm.queries import op11_topk_search

SF = "/root/testdata/sf0.001"


def best(rows, queries, k=10):
    """(query_id, rank, vec_id, score) by all products, in Python's integers."""
    out = []
    for query_id, q in queries:
        scores = sorted((-max(topk.LEAST, min(topk.MOST, sum(a * b for a, b in zip(q, v)))), vec_id) for vec_id, v in rows if vec_id != query_id)
        out += [(query_id, r, vec_id, -s) for r, (s, vec_id) in enumerate(scores[:k], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_op11_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(con.sql(topk.search_sql()).fetchall())
    assert rows_of(op11_topk_search(spark, SF)) == want and want


@pytest.mark.parametrize("seed", range(3))
def test_many_blocks_ties_and_copies(spark, seed):
    """Vectors of few values, a third of them copies, in small blocks with few queries a chunk."""
    rnd = random.Random(seed)
    hot = [rnd.randint(-3, 3) for _ in range(12)]
    rows = [(i, hot if rnd.random() < 0.3 else [rnd.randint(-3, 3) if seed else rnd.choice([-700, 0, 0, 350]) for _ in range(12)]) for i in range(900)]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>")
    asked = [r for r in rows if r[0] % 30 == 0]
    queries = spark.createDataFrame(asked, "query_id long, v array<long>")
    assert rows_of(topk.top_k(spark, vectors, queries, 10, block_rows=120, chunk_rows=7)) == best(rows, asked)


def test_bounds_hold_and_save_work():
    rng = np.random.default_rng(3)
    x = np.floor(1024 * rng.normal(size=(3000, 16)) * np.linspace(2, 0.05, 16)).astype(np.int64)
    order = np.argsort(x.T, axis=1, kind="stable").astype(np.int32)
    values = np.take_along_axis(x.T, order.astype(np.int64), axis=1)
    starts = np.zeros((16, topk.LEVELS + 1), np.int32)
    for d, own in enumerate(values):
        low, high = int(own[0]), int(own[-1])
        starts[d, 1:-1] = np.searchsorted(own, [low + (high - low + 1) * n // topk.LEVELS for n in range(1, topk.LEVELS)])
        starts[d, -1] = 3000
    block = topk.Block({"size": 3000, "width": 16, "ids": np.arange(3000).tobytes(), "order": order.tobytes(), "values": values.tobytes(), "starts": starts.tobytes()})
    read = 0
    for i in range(0, 3000, 100):
        own = np.arange(3000) == i
        rows, postings = block.possible(x[i], own, 10, None)
        scores = x @ x[i]
        scores[i] = -(1 << 60)
        reach = np.sort(scores)[-10]
        assert set(np.flatnonzero(scores >= reach)) <= set(rows.tolist())
        assert len(rows) <= 3000 // topk.FEW or postings == 3000 * 16
        read += postings
    assert read < 0.9 * 30 * 3000 * 16


def test_odd_rows(spark):
    nan, inf = math.nan, math.inf
    schema = "vec_id long, embedding array<float>, score string, v string"
    rows = [(0, [0.5, -0.25], None, "x"), (100, [0.001, 1.0], "s", None), (1, [0.5, None], None, None), (2, None, None, None), (3, [nan, 1.0], None, None), (4, [inf, 1.0], None, None), (None, [1.0, 1.0], None, None)]
    rows += [(5, [], None, None), (6, [1.0], None, None), (7, [0.5, -0.25, 9.0], None, None), (200, [], None, None), (8, [0.5, -0.25], None, None), (8, [0.5, -0.25], None, None), (8, [0.25, 1.0], None, None), (300, [3e38, -3e38], None, None)]
    table = spark.createDataFrame(rows, schema)
    floors = lambda v: [max(topk.LEAST, min(topk.MOST, math.floor(1024 * np.float64(np.float32(c))))) for c in v]
    kept = [(0, [0.5, -0.25]), (100, [0.001, 1.0]), (5, []), (6, [1.0]), (7, [0.5, -0.25, 9.0]), (200, []), (8, [0.5, -0.25]), (300, [3e38, -3e38])]
    kept = [(i, floors(v)) for i, v in kept]
    want = best(kept, [r for r in kept if r[0] % 100 == 0])
    assert rows_of(topk.every_hundredth(spark, table)) == want
    assert rows_of(topk.every_hundredth(spark, table.limit(0))) == []
    assert rows_of(topk.every_hundredth(spark, table.filter("vec_id = 0"))) == []
