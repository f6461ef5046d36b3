"""Exact top-k by inner product over an impact-ordered index, a score at a time.

The index: rows are dealt to blocks of about ``block_rows`` by a hash of their
id.  In a block every dimension is a posting list, ordered by component and cut
into segments of ``LEVELS`` equal widths; a segment's greatest component is its
quantised impact.  A list is read from its top where a query's component is
positive, from its bottom where it is negative, so that what a segment adds to
a score, over the least that the dimension can add, falls along the list.

A query takes the segments of all lists by falling impact.  A row's sum of
impacts, with the next impact for each list in which it was not yet met, bounds
its score from above.  The segments end as soon as the rows whose bound reaches
the k-th best score known are few enough to be scored exactly from their
components, which decides; all others are proven to be below it.  The best
score known comes from exact scores alone: first those of a query in one block,
chosen by its chunk, then, in each block, of the rows that lead after the first
segments.

Blocks and chunks of queries meet in one task each, so memory does not grow
with the table; every block gives a query at most k rows, and only such as
reach the score known.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Workspace

LEVELS = 32
#: Postings taken between two looks at the bounds, as a part of all of a block.
STEP = 8
#: Rows to be scored exactly, as a part of a block, at which the segments end.
FEW = 32
EXACT = 1 << 52
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def scaled(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v) with v the components as floor(scale * x) in longs.

    Vectors that are null or hold a null or non-finite component, and rows
    without an id, take no part.  Of several rows of one id the greatest vector
    (component by component) counts.
    """
    x = F.col(f"`{embedding}`")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    rows = df.filter(x.isNotNull() & sound & F.col(f"`{vec_id}`").isNotNull())
    rows = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long")).alias("v"))
    return rows.groupBy("vec_id").agg(F.max("v").alias("v"))


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def build_index(vectors: DataFrame, blocks: int) -> DataFrame:
    """One row a block: its ids, and for every dimension the rows by component, the components, and where segments start."""

    def build(key, group):
        group = group.sort_values("vec_id")
        width = max(map(len, group["v"]))
        x = _matrix(group["v"], width).T
        order = np.argsort(x, axis=1, kind="stable").astype(np.int32)
        values = np.take_along_axis(x, order.astype(np.int64), axis=1)
        starts = np.zeros((width, LEVELS + 1), np.int32)
        for d, own in enumerate(values):
            low, high = (int(own[0]), int(own[-1])) if len(own) else (0, 0)
            cuts = [low + (high - low + 1) * level // LEVELS for level in range(LEVELS + 1)]
            starts[d, 1:-1] = np.searchsorted(own, np.array(cuts[1:-1], np.int64))
            starts[d, -1] = len(own)
        row = (int(key[0]), len(group), width, group["vec_id"].to_numpy().astype(np.int64).tobytes(), order.tobytes(), values.tobytes(), starts.tobytes())
        return pd.DataFrame([row], columns=["block", "size", "width", "ids", "order", "values", "starts"])

    keyed = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "v")
    return keyed.groupBy("block").applyInPandas(build, "block int, size int, width int, ids binary, order binary, values binary, starts binary")


class Block:
    """A block's index in a task."""

    def __init__(self, row):
        n, width = int(row["size"]), int(row["width"])
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.order = np.frombuffer(row["order"], np.int32).reshape(width, n)
        values = np.frombuffer(row["values"], np.int64).reshape(width, n)
        self.starts = np.frombuffer(row["starts"], np.int32).reshape(width, LEVELS + 1).astype(np.int64)
        self.rows = np.zeros((n, width), np.int64)
        for d in range(width):
            self.rows[self.order[d], d] = values[d]
        first, last = self.starts[:, :-1], self.starts[:, 1:]
        self.held = last - first
        at = np.arange(width)[:, None]
        self.least = values[at, np.minimum(first, n - 1)]
        self.most = values[at, np.maximum(last - 1, 0)]
        self.low, self.high = (values[:, 0], values[:, -1]) if width else (np.zeros(0, np.int64),) * 2
        self.reach = int(np.abs(np.stack([self.low, self.high]).astype(object)).max()) if width else 0

    def exact(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Inner products with rows; in Python's integers, held within a long, where 64 bits may not do."""
        if self.reach * int(np.abs(q.astype(object)).max(initial=0)) * max(1, len(q)) < MOST:
            return self.rows[rows] @ q
        products = (self.rows[rows].astype(object) * q.astype(object)).sum(axis=1)
        return np.array([min(max(int(p), LEAST), MOST) for p in products], np.int64)

    def possible(self, q: np.ndarray, own: np.ndarray, k: int, known: int | None) -> tuple[np.ndarray, int]:
        """Rows that may be among the k best (all of those that are, and few more), and the share of postings read."""
        n = len(self.ids)
        all_rows = np.arange(n)
        if n <= 4 * k or self.reach * int(np.abs(q.astype(object)).max(initial=0)) * max(1, len(q)) * 2 >= EXACT:
            return all_rows, 0
        up = q > 0
        weight = np.abs(q)
        impact = weight[:, None] * np.where(up[:, None], self.most - self.low[:, None], self.high[:, None] - self.least)
        floor = int((q * np.where(up, self.low, self.high)).sum())
        lists, levels = np.nonzero((self.held > 0) & (weight > 0)[:, None])
        impacts = impact[lists, levels]
        by = np.argsort(-impacts, kind="stable")
        lists, levels, impacts = lists[by], levels[by], impacts[by]
        first, held = self.starts[lists, levels], self.held[lists, levels]
        top = np.zeros(len(q), np.int64)
        np.maximum.at(top, lists, impacts)
        ends = np.cumsum(held)
        sums, met = np.zeros(n), np.zeros(n, np.int64)
        flat, done, opened = self.order.ravel(), 0, np.zeros(len(q), bool)
        total = int(ends[-1]) if len(ends) else 0
        part = max(1, total // STEP)
        while done < len(ends):
            stop = int(np.searchsorted(ends, (ends[done - 1] if done else 0) + part)) + 1
            size = held[done:stop]
            base = np.repeat(lists[done:stop] * n + first[done:stop] - (np.cumsum(size) - size), size)
            rows = flat[base + np.arange(len(base))]
            sums += np.bincount(rows, np.repeat(impacts[done:stop], size), n)
            met += np.bincount(rows, minlength=n)
            opened[lists[done:stop]] = True
            done = min(stop, len(ends))
            following = int(impacts[done]) if done < len(ends) else 0
            bound = sums + (int(opened.sum()) - met) * following + int(top[~opened].sum()) + floor
            leading = np.argpartition(-np.where(own, -np.inf, sums), k)[: k + 1]
            leading = leading[~own[leading]]
            if len(leading) >= k:
                best = int(np.sort(self.exact(q, leading))[-k])
                known = best if known is None else max(known, best)
            if known is not None:
                left = np.flatnonzero(bound >= known)
                if len(left) <= max(4 * k, n // FEW):
                    return left, int(ends[done - 1])
        return (all_rows if known is None else np.flatnonzero(bound >= known)), total


def _meet(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): what a block gives each of its queries; ``queries`` has the block and chunk to go to, and the score known."""

    def search(own, asked):
        out = []
        if len(own) and len(asked):
            block = Block(own.iloc[0])
            for query_id, v, known in zip(asked["query_id"], asked["v"], asked["known"]):
                q = np.zeros(block.rows.shape[1], np.int64)
                part = np.asarray(v, np.int64)[: len(q)]  # beyond a block's longest vector there is nothing to multiply by
                q[: len(part)] = part
                known = None if known is None or pd.isna(known) else int(known)
                self_row = block.ids == query_id
                rows, _ = block.possible(q, self_row, k, known)
                rows = rows[~self_row[rows]]
                scores, ids = block.exact(q, rows), block.ids[rows]
                best = np.lexsort((ids, ~scores))[:k]  # ~s falls as s grows, and stays within 64 bits
                best = best if known is None else best[scores[best] >= known]
                out.append(pd.DataFrame({"query_id": np.int64(query_id), "vec_id": ids[best], "score": scores[best]}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("query_id", "vec_id", "score")})

    keys = ("block", "chunk")
    return index.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = 4096, chunk_rows: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of the greatest inner product for each query, ties to the smaller id.

    ``vectors`` is (vec_id, v), ids distinct, as ``scaled`` gives them;
    ``queries`` (query_id, v).  A query's own id is no candidate for it.  Where
    vectors differ in length, what is missing counts as 0; empty vectors score
    0.  Sums beyond a long are held at its ends.  Empty tables give no rows.
    """
    ws = Workspace(spark, "topk")
    vectors, queries = ws.write(vectors, "vectors"), ws.write(queries, "queries")
    blocks, chunks = max(1, math.ceil(vectors.count() / block_rows)), max(1, math.ceil(queries.count() / chunk_rows))
    index = ws.write(build_index(vectors, blocks), "index")
    queries = queries.withColumn("chunk", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(chunks)).cast("int"))
    lists = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    # one block for each query gives it a score to reach
    one = queries.withColumn("block", F.col("chunk") % blocks).withColumn("known", F.lit(None).cast("long"))
    tried = _meet(lists.filter(F.col("chunk") % blocks == F.col("block")), one, k)
    known = tried.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    known = ws.write(known.select("query_id", F.when(F.col("n") >= k, F.col("least")).alias("known")), "known")
    asked = queries.join(known, "query_id", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = _meet(lists, asked, k)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every_hundredth(spark: SparkSession, embeddings: DataFrame, k: int = 10) -> DataFrame:
    """The contract's search: each row whose vec_id is divisible by 100 as a query against all rows."""
    vectors = Workspace(spark, "topk-rows").write(scaled(embeddings), "vectors")
    queries = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "v")
    return top_k(spark, vectors, queries, k)


def search_sql() -> str:
    return """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
