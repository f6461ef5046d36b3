"""Hashes of all words of many texts at once, on the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from tessera.llm.common import mix64

#: ASCII white space, which parts words.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LONGEST = 64


def _table() -> np.ndarray:
    """A random number for each byte at each place of a word, none for blanks; A-Z as a-z."""
    out = mix64(np.arange(1, LONGEST * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(LONGEST, 256)
    out[:, 65:91] = out[:, 97:123]
    out[:, BLANK] = 0
    return out.ravel()


TABLE = _table()


def raw_chunks(column: pa.Array, rows: int = 64, most: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, where each row's bytes begin, and the end) of up to ``rows`` texts; nulls are empty."""
    whole = column.cast(pa.large_binary())
    n = len(whole)
    ends = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)
    k = 0
    while k < n:
        to = max(k + 1, min(k + rows, n, int(np.searchsorted(ends, ends[k] + most))))
        yield k, data[ends[k] : ends[to]], ends[k : to + 1] - ends[k]
        k = to


def word_hashes(raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, where its bytes begin, number of the first word of each text, and the end).

    Words are what lies between ASCII white space and ends of texts, A-Z as
    a-z.  A word's hash sums random numbers, one for each byte at its place;
    that of words of over 64 bytes is xxh3.
    """
    n = len(raw)
    inside = ~BLANK[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = begins[:-1][begins[:-1] < n]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    bounds = np.searchsorted(starts, begins)
    if not len(starts):
        return np.empty(0, np.uint64), starts, bounds
    low = int(starts[0])
    reach = np.diff(np.append(starts, n))
    place = np.arange(low, n) - np.repeat(starts, reach)
    long = np.flatnonzero((place == LONGEST) & inside[low:]) + low
    np.minimum(place, LONGEST - 1, out=place)
    place <<= 8
    place += raw[low:]
    hashes = np.add.reduceat(TABLE[place], starts - low)
    for at in long.tolist():
        w = int(np.searchsorted(starts, at, "right")) - 1
        piece = raw[starts[w] : starts[w] + reach[w]]
        # the stretch up to the next word holds one word, and blanks behind it
        hashes[w] = xxhash.xxh3_64_intdigest(piece.tobytes().lower().split()[0])
    return hashes, starts, bounds
