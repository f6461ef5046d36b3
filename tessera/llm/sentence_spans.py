"""Operator 10: removal of repeated runs of consecutive sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Workspace, free_names, partitions_for, text_rows

#: A sentence ends at closing punctuation before white space, or at a line end; it keeps what follows it up to the next.
SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+(?![\s.!?])[^.!?\n]*)*(?:[.!?]+[^\S\n]*\n?|\n|$)\s*")
LETTERS = re.compile(r"\w", re.UNICODE)


def sentences(text: str | None) -> list[str]:
    """The sentences of a text; joined they are the text."""
    return [x for x in SENTENCE.findall(text or "") if x]


def normal(sentence: str) -> bytes:
    """A sentence in lower case with white space as single blanks."""
    return " ".join(sentence.lower().split()).encode("utf-8", "surrogatepass")


def span_hashes(parts: list[str], run: int, long_words: int) -> tuple[list[int], list[int], list[bytes]]:
    """(first sentence, sentences, 128-bit hash) of each run of ``run`` sentences.

    Sentences without a word character belong to the run around them without
    counting.  A shorter run that has ``long_words`` words counts too, so that
    a passage of a few long sentences is seen.
    """
    kept = [k for k, x in enumerate(parts) if LETTERS.search(x)]
    one = [normal(parts[k]) for k in kept]
    words = [x.count(b" ") + 1 for x in one]
    starts, sizes, hashes = [], [], []
    for k in range(len(kept)):
        total = 0
        for m in range(1, min(run, len(kept) - k) + 1):
            total += words[k + m - 1]
            if m == run or total >= long_words:
                starts.append(kept[k])
                sizes.append(kept[k + m - 1] - kept[k] + 1)
                hashes.append(xxhash.xxh3_128_digest(b"\n".join(one[k : k + m])))
    return starts, sizes, hashes


def spans(docs: DataFrame, run: int, long_words: int) -> DataFrame:
    """(doc, body, first, size, span, more) of each run; span and more are the halves of its hash."""

    def each(batches) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_rows(batches):
            rows, starts, sizes, hashes = [], [], [], []
            for row, text in enumerate(texts):
                got = span_hashes(sentences(text), run, long_words)
                rows += [row] * len(got[0])
                starts += got[0]
                sizes += got[1]
                hashes += got[2]
            halves = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            own = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("doc", "body")]
            yield pa.record_batch([*own, pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), *(pa.array(np.ascontiguousarray(halves[:, k])) for k in range(2))], names=["doc", "body", "first", "size", "span", "more"])

    return docs.mapInArrow(each, "doc long, body long, first int, size int, span long, more long")


LATER = "edge int, part int, span long, more long, doc long, body long, first int, size int"
PLAIN, UNSURE, FIRST, LAST = range(4)


def later_runs(ws: Workspace, found: DataFrame) -> DataFrame:
    """(doc, body, first, size) of the runs that are not the first of their hash in the order of (doc, body, first).

    Runs are sorted by hash and place over range partitions, which cut a run
    that a third of the rows share into many; in each, a run is later if it
    stands elsewhere than the first one of its hash.  Where a partition begins
    within a hash, that first one lies before it: each partition tells the
    groups at its ends (two rows), and from these the driver sees which of the
    runs at the beginnings are later too.
    """
    order = ("span", "more", "doc", "body", "first")

    def run(batches) -> Iterator[pa.RecordBatch]:
        part, carried, began, groups = TaskContext.get().partitionId(), None, None, 0

        def rows(edge: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int32(), *(pa.int64(),) * 4, pa.int32(), pa.int32())
            return pa.record_batch([pa.array(c, t) for c, t in zip([edge, np.full(len(edge), part), *columns], kinds, strict=True)], names=["edge", "part", *order, "size"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [batch.column(c).to_numpy().astype(np.int64) for c in order]
            new = np.ones(n, bool)
            new[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
            if carried is not None:
                new[0] = (columns[0][0], columns[1][0]) != tuple(carried[:2])
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            kept = [np.where(start >= 0, c[np.maximum(start, 0)], carried[k] if carried else 0) for k, c in enumerate(columns)]
            elsewhere = np.logical_or.reduce([c != x for c, x in zip(columns[2:], kept[2:], strict=True)])
            unsure = ~elsewhere & (groups + np.cumsum(new) == 1)
            at = np.flatnonzero(elsewhere | unsure)
            yield rows(np.where(elsewhere[at], PLAIN, UNSURE), [*(c[at] for c in columns), batch.column("size").to_numpy()[at]])
            began = began or [int(c[0]) for c in columns]
            carried, groups = [int(x[-1]) for x in kept], groups + int(new.sum())
        if began:
            yield rows(np.array([FIRST, LAST]), [np.array(c) for c in zip(began, carried, strict=True)] + [np.zeros(2)])

    dealt = found.repartitionByRange(partitions_for(ws.spark), *order).sortWithinPartitions(*order)
    marked = ws.write(dealt.mapInArrow(run, LATER), "later")
    ends: dict[int, dict[int, tuple]] = {}
    for r in marked.filter(F.col("edge") >= FIRST).toLocalIterator():  # two rows for each partition
        ends.setdefault(r.part, {})[r.edge] = (r.span, r.more, (r.doc, r.body, r["first"]))
    open_, held = [], None
    for part in sorted(ends):
        first, last = ends[part][FIRST], ends[part][LAST]
        goes_on = held is not None and held[:2] == first[:2]
        if goes_on and held[2] != first[2]:
            open_.append(part)
        if not goes_on or last[:2] != first[:2]:
            held = last
    sure = F.col("edge") == PLAIN
    return marked.filter(sure | ((F.col("edge") == UNSURE) & F.col("part").isin(open_)) if open_ else sure).select("doc", "body", "first", "size")


def dedup_spans(spark: SparkSession, docs: DataFrame, run: int = 3, long_words: int = 24) -> DataFrame:
    """``docs`` (doc_id, text, ...) with repeated sentence runs removed from text.

    Every run of ``run`` consecutive sentences (of fewer, if they have
    ``long_words`` words) is hashed; of equal runs the first by (doc_id, place)
    stays, and each sentence that any later one covers goes.  Adds n_sentences and n_removed (long) and original_chars, in place of
    columns with these names; a document that loses nothing keeps its text as it
    was.  Null text stays null with no sentences.  A null doc_id comes before
    all others; different texts under one doc_id, or under none, follow each
    other in the order of a hash.  Equal rows count as one document, so they
    lose the same.  Other columns pass through.
    """
    ws = Workspace(spark, "spans")
    doc, body = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.xxhash64(F.col("text").cast("string"))
    keyed = docs.select(doc.alias("doc"), body.alias("body"), F.col("text").cast("string").alias("text"))
    found = ws.write(spans(keyed, run, long_words), "spans")
    lost = later_runs(ws, found).groupBy("doc", "body").agg(F.sort_array(F.collect_set(F.struct("first", "size"))).alias("lost"))
    lost = ws.write(lost, "lost")
    rest = [c for c in docs.columns if c not in ("text", "n_sentences", "n_removed", "original_chars")]
    of_doc, of_body, first, size = free_names([*docs.columns, "text"], "doc", "body", "lost_first", "lost_size")
    lost = lost.select(F.col("doc").alias(of_doc), F.col("body").alias(of_body), F.transform("lost", lambda x: x["first"]).alias(first), F.transform("lost", lambda x: x["size"]).alias(size))
    joined = docs.join(lost, (doc == F.col(of_doc)) & (body == F.col(of_body)), "left")
    joined = joined.select(*[F.col(f"`{c}`") for c in rest], F.col("text").cast("string").alias("text"), first, size)

    def each(batches) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_rows(batches):
            out, n_all, n_lost, chars = [], [], [], []
            for text, firsts, sizes in zip(texts, batch.column(first).to_pylist(), batch.column(size).to_pylist(), strict=True):
                parts = sentences(text)
                gone = np.zeros(len(parts), bool)
                for k, n in zip(firsts or (), sizes or (), strict=True):
                    gone[k : k + n] = True
                out.append("".join(x for x, g in zip(parts, gone, strict=True) if not g) if gone.any() else text)
                n_all.append(len(parts))
                n_lost.append(int(gone.sum()))
                chars.append(len(text or ""))
            yield pa.record_batch([*(batch.column(c) for c in rest), pa.array(out, pa.string()), pa.array(n_all, pa.int64()), pa.array(n_lost, pa.int64()), pa.array(chars, pa.int64())], names=[*rest, "text", "n_sentences", "n_removed", "original_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "text string, n_sentences long, n_removed long, original_chars long"])
    return joined.mapInArrow(each, schema)
