"""Operator 6: a factorisation machine for document quality."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_rows

BUCKETS = 1 << 14
STATS = (
    "length", "mean_word", "upper", "digits", "symbols", "punctuation", "other_bytes", "lines", "line_words", "repeated_lines",
    "distinct_words", "top_word", "repeated_pairs", "bars", "exclamations", "empty",
)
SYMBOLS = np.frombuffer(b"#*$%&<>|@^~\\{}[]=+_/", np.uint8)
PUNCTUATION = np.frombuffer(b".,;:!?'\"()-", np.uint8)


def structure(text: bytes, words: list[bytes], codes: np.ndarray) -> list[float]:
    """The statistics named in STATS; shares are of bytes, words or lines."""
    n, m = len(text), len(words)
    if not m:
        return [0.0] * (len(STATS) - 1) + [1.0]
    by = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = codes[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + codes[1:]
    _, times = np.unique(codes, return_counts=True)
    return [
        float(np.log1p(n)), (n - m) / m, by[65:91].sum() / n, by[48:58].sum() / n, by[SYMBOLS].sum() / n, by[PUNCTUATION].sum() / n, by[128:].sum() / n,
        float(np.log1p(len(lines))), float(np.log1p(m / len(lines))), 1 - len(set(lines)) / len(lines),
        len(times) / m, times.max() / m, 1 - len(np.unique(pairs)) / max(1, m - 1), by[124] / m, by[33] / m, 0.0,
    ]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(buckets, values, statistics): hashed lower-case words, log counts of unit length, and the structure."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    codes = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    stats = structure(raw, words, codes)
    lower = raw.lower().split()
    counts = np.bincount(np.fromiter(map(zlib.crc32, lower), np.uint32, len(lower)) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    values = np.log1p(counts[at]).astype(np.float32)
    return at.astype(np.int32), values / max(1e-9, float(np.linalg.norm(values))), stats


@dataclass(frozen=True)
class Model:
    """Weights of the machine: bias, one weight and ``rank`` factors for each bucket and then each statistic."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def score(self, text: str | None) -> float:
        at, values, stats = features(text)
        return float(1 / (1 + np.exp(-self.margin(at, values, (np.array(stats, np.float32) - self.mean) / self.scale))))

    def margin(self, at: np.ndarray, values: np.ndarray, stats: np.ndarray) -> float:
        """Sum of squares identity: the pairs' sum is half of (sum v x)^2 less the sum of (v x)^2."""
        i = np.concatenate([at, np.arange(BUCKETS, BUCKETS + len(STATS))])
        x = np.concatenate([values, np.clip(stats, -8, 8) * STAT_SHARE])
        vx = self.factor[i] * x[:, None]
        s = vx.sum(axis=0)
        return float(np.clip(self.bias + self.weight[i] @ x + 0.5 * (s @ s - (vx * vx).sum()), -30, 30))


#: Statistics enter with this factor, so that they and the words have like lengths.
STAT_SHARE = np.float32(0.25)


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], rank: int = 8, epochs: int = 12, batch: int = 256, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> Model:
    """Fit by mini-batch AdaGrad on the logistic loss.  Without rows of both labels the score is the smoothed share of label 1."""
    size, y_all = BUCKETS + len(STATS), np.array([r[3] for r in rows], np.float32)
    prior = (y_all.sum() + 1) / (len(rows) + 2)
    bias, weight = np.float64(np.log(prior / (1 - prior))), np.zeros(size, np.float32)
    random = np.random.default_rng(seed)
    factor = random.normal(0, 0.02, (size, rank)).astype(np.float32)
    if not len(rows) or y_all.min() == y_all.max():
        return Model(float(bias), weight, factor * 0, np.zeros(len(STATS), np.float32), np.ones(len(STATS), np.float32))
    stats = np.array([r[2] for r in rows], np.float32)
    mean, scale = stats.mean(axis=0), stats.std(axis=0) + np.float32(1e-4)
    stats = np.clip((stats - mean) / scale, -8, 8) * STAT_SHARE
    own = np.arange(BUCKETS, size, dtype=np.int64)
    g_bias, g_weight, g_factor = 1e-6, np.full(size, 1e-6, np.float32), np.full((size, rank), 1e-6, np.float32)
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for b in range(0, len(order), batch):
            pick = order[b : b + batch]
            lengths = np.array([len(rows[k][0]) + len(own) for k in pick])
            i = np.concatenate([part for k in pick for part in (rows[k][0], own)])
            x = np.concatenate([part for k in pick for part in (rows[k][1], stats[k])]).astype(np.float32)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            doc = np.repeat(np.arange(len(pick)), lengths)
            vx = factor[i] * x[:, None]
            s = np.add.reduceat(vx, starts, axis=0)
            margin = bias + np.add.reduceat(weight[i] * x, starts) + 0.5 * ((s * s).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), starts))
            error = ((1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y_all[pick]) / len(pick)).astype(np.float32)
            ex = error[doc] * x
            touched, back = np.unique(i, return_inverse=True)
            d_weight = np.bincount(back, ex, len(touched)).astype(np.float32) + decay * weight[touched]
            d_factor = np.stack([np.bincount(back, ex * (s[doc, f] - vx[:, f]), len(touched)) for f in range(rank)], axis=1).astype(np.float32) + decay * factor[touched]
            g_bias += float(error.sum()) ** 2
            bias -= rate * float(error.sum()) / np.sqrt(g_bias)
            g_weight[touched] += d_weight**2
            weight[touched] -= rate * d_weight / np.sqrt(g_weight[touched])
            g_factor[touched] += d_factor**2
            factor[touched] -= 0.3 * rate * d_factor / np.sqrt(g_factor[touched])
    return Model(float(bias), weight, factor, mean, scale)


def remainder(column: str = "doc_id"):
    """crc32 of the id as text, modulo 5; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = 6000) -> Model:
    """Learn ``label`` (0 or 1) from labelled rows outside the held-out fifth.

    A bounded sample of about ``most_rows`` labelled rows, picked by a hash of
    the id, is fitted on the driver; its features, not its texts, go there.
    Null labels and ids are left out.  Labels of one id that disagree count as
    the smallest, and of several texts under one id the smallest is learnt
    from, so a repeated id is one row of the sample.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder() != 0)).select("doc_id", F.col(label).cast("int").alias("label"))
    every = max(1, -(-known.count() // most_rows))
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).groupBy("doc_id").agg(F.min("label").alias("label"))
    sample = docs.select("doc_id", "text").join(known, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_rows(batches):
            got = [features(x) for x in texts]
            yield pa.record_batch([batch.column("doc_id"), pa.array([g[0].tobytes() for g in got], pa.binary()), pa.array([g[1].astype("<f4").tobytes() for g in got], pa.binary()), pa.array([g[2] for g in got], pa.list_(pa.float64())), batch.column("label")], names=["doc_id", "at", "value", "stats", "label"])

    rows = sample.mapInArrow(run, "doc_id long, at binary, value binary, stats array<double>, label int").toLocalIterator()
    kept = sorted(((r.doc_id, bytes(r.at), bytes(r.value), r.stats, r.label) for r in rows), key=lambda r: r[0])
    return fit([(np.frombuffer(at, np.int32), np.frombuffer(value, "<f4"), np.array(stats), y) for _, at, value, stats, y in kept])


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (double), predicted (1 if score >= threshold) and held_out.

    Only the text enters the score; null counts as empty.  Columns pass
    through, but for those of the results' names.
    """
    new = ("score", "predicted", "held_out")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_rows(batches):
            yield pa.record_batch([*batch.columns, pa.array([model.score(x) for x in texts], pa.float64())], names=[*batch.schema.names, "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "score double"])
    return docs.mapInArrow(run, schema).withColumns({"predicted": (F.col("score") >= threshold).cast("int"), "held_out": remainder() == 0})
