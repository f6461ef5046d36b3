"""Operator 7: shortest-pack-first packing of token pieces over the length histogram."""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Workspace, text_rows
from tessera.llm.tokens import END_ID, encoder_for

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, local_rank long"
PIECE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("local_rank", pa.int64())])


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns [(count, [(length, times), ...])] that hold ``counts`` pieces of each length.

    Lengths go longest first; each joins the shortest pack that has room, a
    whole group of equal packs at a time, and opens new packs where none has.
    The work depends on the number of lengths, not on the number of pieces.
    """
    groups: dict[int, dict[tuple, int]] = defaultdict(dict)  # tokens in a pack -> pattern -> packs
    totals: list[int] = []

    def put(total: int, pattern: tuple, n: int) -> None:
        if not groups[total]:
            heapq.heappush(totals, total)
        groups[total][pattern] = groups[total].get(pattern, 0) + n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            while totals and not groups[totals[0]]:
                heapq.heappop(totals)
            if not totals or totals[0] + length > size:
                each = size // length
                if left >= each:
                    put(length * each, ((length, each),), left // each)
                if left % each:
                    put(length * (left % each), ((length, left % each),), 1)
                break
            total = totals[0]
            pattern, n = groups[total].popitem()
            room = (size - total) // length
            packs = min(n, -(-left // room))
            if packs < n:
                groups[total][pattern] = n - packs
            full, rest = divmod(left, room)
            full = min(full, packs)
            if full:
                put(total + room * length, (*pattern, (length, room)), full)
            if full < packs and rest:
                put(total + rest * length, (*pattern, (length, rest)), 1)
            left -= full * room + (rest if full < packs else 0)
    return [(n, list(pattern)) for total in sorted(groups, reverse=True) for pattern, n in sorted(groups[total].items(), reverse=True)]


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """length -> [(first rank, first sequence, offset, times)], ranks ascending, for all patterns."""
    used: dict[int, int] = defaultdict(int)
    out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    sequence = 0
    for n, pattern in patterns:
        offset = 0
        for length, times in pattern:
            out[length].append((used[length], sequence, offset, times))
            used[length] += n * times
            offset += length * times
        sequence += n
    return out


def cut_pieces(docs: DataFrame, path: str, size: int, end_id: int | None = END_ID) -> DataFrame:
    """Pieces of at most ``size`` ids of each document, with their rank among those of a length in their partition."""

    def run(batches):
        encoder, part, ranks = encoder_for(path, end_id), TaskContext.get().partitionId(), defaultdict(int)
        for batch, texts in text_rows(batches):
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                raw = encoder.encode(text)
                n = len(raw) // 4
                for start in range(0, n, size):
                    length = min(size, n - start)
                    out.append((doc, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), n, part, ranks[length]))
                    ranks[length] += 1
            if out:
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), PIECE_SCHEMA, strict=True)], schema=PIECE_SCHEMA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def pack(spark: SparkSession, docs: DataFrame, path: str, size: int = 2048, end_id: int | None = END_ID) -> DataFrame:
    """Pack the ids of ``docs`` (doc_id, text) into sequences of at most ``size`` ids.

    A document is cut into full sequences and a remainder; remainders share
    sequences by the patterns of ``pack_histogram``.  A piece's rank among the
    pieces of its length is its rank in its partition plus the counts of the
    partitions before, and the rank picks its pattern, sequence and offset.
    Only the histogram (one row for each length) reaches the driver.  Null
    texts are empty documents (the end id alone), repeated rows are documents
    of their own, other columns are not read, an empty table gives no rows.
    Rows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    ws = Workspace(spark, "packing")
    pieces = ws.write(cut_pieces(docs, path, size, end_id), "pieces")
    by_part = ws.write(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed = {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in slots(pack_histogram(counts, size)).items()}
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(x).to_numpy() for x in ("length", "rank"))
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, base, begin, times = placed[int(n)]
                k = np.searchsorted(first, rank[at], "right") - 1
                q = rank[at] - first[k]
                sequence[at], offset[at] = base[k] + q // times[k], begin[k] + q % times[k] * n
            yield pa.record_batch([*(batch.column(x) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("local_rank") + F.col("before"))
    return ranked.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
