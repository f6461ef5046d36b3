"""Periodic runs of words, by the Lyndon arrays of both orders of the alphabet (Ellert and Fischer 2021).

A run is a maximal stretch of words of which those ``period`` apart are the
same, ``period`` being the smallest such number.  Every run has a Lyndon word
as its root for one of the two orders of the alphabet, and that word ends where
the next smaller suffix starts; so next smaller suffixes, found from right to
left with the lengths that they share, give all runs.  What two suffixes share
is never compared twice: the chain of next smaller suffixes passes it on, and a
match at some distance is taken over where it meets the last one at that
distance.  Words are only compared for equality and order (the order is that of
the batch's dictionary); there are no suffix arrays and no hashes of stretches.

A document is one row's work, so there is no shuffle: words are cut and coded
for a slice of a batch at once, and only stretches in which every word has
come up lately can hold a run (``stretches``), so the rest stays in NumPy.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_names, prepare

LEAST_LENGTH, LEAST_EXPONENT = 24, 3
RUNS = "array<struct<start:long,length:long,period:long>>"
#: Bytes of text whose words are held at once (a longer text is held alone).
SLICE = 16 << 20


def next_smaller(x: list[int]) -> tuple[list[int], list[int]]:
    """For each suffix the start of the next smaller one (the end of ``x`` is smaller than all), and how many symbols the two share."""
    n = len(x)
    smaller, shared = [n] * n, [0] * n
    last: dict[int, tuple[int, int]] = {}  # distance: the last place matched at it, and how far
    for i in range(n - 1, -1, -1):
        j, m, exact = i + 1, 0, False
        while j < n:
            if not exact and j + m < n and x[i + m] == x[j + m]:
                place, reach = last.get(j - i, (n, 0))
                stop = min(n - j, place - i)
                while m < stop and x[i + m] == x[j + m]:
                    m += 1
                if i + m >= place:
                    m = place - i + reach
                last[j - i] = i, m
            if j + m == n or x[i + m] > x[j + m]:
                break
            follow, known = smaller[j], shared[j]
            if m > known:  # the suffix at ``follow`` falls below both where it leaves that at j
                j, m = follow, known
                break
            j, exact = follow, m < known
        smaller[i] = j
        shared[i] = m if j < n else 0
    return smaller, shared


def runs(x: list[int], least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``x`` that are long enough, by start, then period; exponents from 2."""
    found, n = set(), len(x)
    for symbols in (x, [-s for s in x]):
        smaller, shared = next_smaller(symbols)
        for i, (j, right) in enumerate(zip(smaller, shared)):
            period = j - i
            if right <= (least_exponent - 2) * period:
                continue
            left = 0
            while left < min(i, period) and x[i - 1 - left] == x[j - 1 - left]:
                left += 1
            if left < period and left + period + right >= max(least_length, least_exponent * period):
                found.add((i - left, left + period + right, period))
    return sorted(found)


def stretches(codes: np.ndarray, doc: np.ndarray, first: np.ndarray, least_length: int, least_exponent: int) -> list[tuple[int, int]]:
    """Disjoint stretches of ``codes`` that hold all long runs whole, each within one document.

    In a run of period q every word from the second period on was last seen at
    most q words before.  For q from half of a power of two to below it, this
    asks for a stretch of recent words of a certain length; it and as many
    words before it as a period may have are kept.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    a, b = order[:-1], order[1:]
    same = (codes[a] == codes[b]) & (doc[a] == doc[b])
    gap = np.full(n, n + 1, np.int64)
    gap[b[same]] = (b - a)[same]
    spans, power, longest = [], 2, int(np.bincount(doc).max()) if n else 0
    while power // 2 * least_exponent <= longest:
        recent = np.flatnonzero(np.diff(np.concatenate([[False], gap < power, [False]]).view(np.int8)))
        starts, ends = recent[::2], recent[1::2]
        enough = ends - starts >= max(least_length - power + 1, (least_exponent - 1) * power // 2)
        spans += zip(np.maximum(starts[enough] - power + 1, first[doc[starts[enough]]]).tolist(), ends[enough].tolist())
        power *= 2
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((start, end))
    return out


def made_periodic(doc_id: int, n: int) -> tuple[int, int] | None:
    """Where the test pattern makes the words of a document periodic, and with which period: (place, period) of a tenth of the documents."""
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return None
    place = g % n
    return place, 1 + (n - place) // (3 + g % 8)


def _slices(sizes: list[int]):
    """Ranges of rows of at most ``SLICE`` bytes together, or of one row."""
    start = held = 0
    for k, size in enumerate(sizes):
        if k > start and held + size > SLICE:
            yield start, k
            start, held = k, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def _judged(ids: list, texts: pa.Array, pattern: bool, least_length: int, least_exponent: int) -> tuple[list, pa.Array]:
    """The runs of each text, and each text without their repetitions."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words, rows = split.flatten(), np.repeat(np.arange(len(ids)), np.diff(split.offsets.to_numpy()))
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    words, doc = words.filter(pa.array(real)), rows[real]
    counts = np.bincount(doc, minlength=len(ids))
    first = np.cumsum(counts) - counts
    source = np.arange(len(words))
    if pattern:
        for k, doc_id in enumerate(ids):
            if doc_id is not None and (made := made_periodic(doc_id, int(counts[k]))):
                place, period = made
                tail = source[first[k] + place : first[k] + counts[k]]
                tail[:] = first[k] + place + np.arange(len(tail)) % period
    codes = words.dictionary_encode().indices.to_numpy()[source] if len(words) else np.zeros(0, np.int32)
    found: list[list] = [[] for _ in ids]
    keep = np.ones(len(words), bool)
    for start, end in stretches(codes, doc, first, least_length, least_exponent):
        k = int(doc[start])
        for at, length, period in runs(codes[start:end].tolist(), least_length, least_exponent):
            found[k].append((start + at - int(first[k]), length, period))
            keep[start + at + period : start + at + length] = False
    kept = words.take(pa.array(source[keep]))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=len(ids)))]).astype(np.int32)
    return found, pc.binary_join(pa.ListArray.from_arrays(offsets, kept), " ")


def find_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", pattern: bool = False, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """All columns of ``docs``, with ``runs`` (by start, then period) and ``collapsed``.

    Words are what lies between ASCII white space, counted from 0; a run counts
    from ``least_length`` words and ``least_exponent`` periods on (2 at least).
    ``collapsed`` has the words joined by one space, without those that a run
    holds after its first period.  ``pattern`` first applies the contract's
    periodic change to a tenth of the documents, by their integer ids; rows
    without an id are not changed.  A null text has no words, no runs and an
    empty ``collapsed``; repeated rows are judged each alone; an empty table
    stays empty.  Columns of ``docs`` named like the new ones are replaced.
    """
    prepare(docs.sparkSession)
    own = [c for c in docs.columns if c.lower() not in ("runs", "collapsed")]
    [key, body] = free_names(own, "run_key", "run_text")

    def judge(batches):
        for batch in batches:
            table = pa.table(batch.columns, schema=batch.schema)
            sizes = pc.fill_null(pc.binary_length(table[body]), 0).to_pylist()
            for start, end in _slices(sizes):
                part = table.slice(start, end - start).combine_chunks()
                ids, texts = part[key].to_pylist(), part[body].combine_chunks()
                found, collapsed = _judged(ids, texts, pattern, least_length, least_exponent)
                part = part.drop([key, body])
                structs = [[{"start": s, "length": n, "period": p} for s, n, p in rows] for rows in found]
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
                part = part.append_column("runs", pa.array(structs, kind)).append_column("collapsed", collapsed)
                yield from part.to_batches()

    rest = docs.select(*[F.col(f"`{c}`") for c in own], F.col(f"`{doc_id}`").cast("long").alias(key), F.col(f"`{text}`").alias(body))
    schema = docs.select(*[F.col(f"`{c}`") for c in own]).schema
    out = rest.mapInArrow(judge, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + f", runs {RUNS}, collapsed string")
    return out


def strongest(found: str = "runs") -> Column:
    """The run of the greatest exact length over period; of equal ones that of the smallest start, then period; null without runs."""
    ahead = lambda a, b: F.when(a.length * b.period != b.length * a.period, F.when(a.length * b.period > b.length * a.period, -1).otherwise(1)).when(a.start != b.start, F.when(a.start < b.start, -1).otherwise(1)).otherwise(F.when(a.period < b.period, -1).when(a.period > b.period, 1).otherwise(0))
    return F.try_element_at(F.array_sort(found, ahead), F.lit(1))


def listed(found: str = "runs") -> Column:
    """The runs as lines ``start,length,period``."""
    return F.array_join(F.transform(found, lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
