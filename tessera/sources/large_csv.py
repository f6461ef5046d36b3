"""CSV files of any size, cut into splits, with line ends inside quotes.

A line begins either a row or within a quoted cell, and a split cannot tell
which for its first one.  So each split is gone through for both beginnings and
tells the two states that it ends in; composed in order, these give every
split its beginning.  Rows within a split are then read there, and what a split
leaves open at its end is put together with the beginnings of those after it.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Cells have no limit of their own here; what Spark holds in a cell is the limit.
CELL = (1 << 31) - 1


def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Whether a line ends within a quoted cell, given whether it begins in one; a quote within a bare cell is a character."""
    at = 0
    while True:
        if not inside:
            if line[at : at + 1] != '"':
                if (cut := line.find(sep, at)) < 0:
                    return False
                at = cut + 1
                continue
            at += 1
        close = line.find('"', at)
        while close >= 0 and line[close + 1 : close + 2] == '"':
            close = line.find('"', close + 2)
        if close < 0:
            return True
        inside = False
        if (cut := line.find(sep, close + 1)) < 0:
            return False
        at = cut + 1


def _lines(batches) -> Iterator[tuple[tuple[str, int], str]]:
    """((path, split), line) in the order of the file."""
    for batch in batches:
        for path, split, line in zip(*(batch.column(c).to_pylist() for c in ("path", "split", "value")), strict=True):
            yield (path, split), line.removeprefix("﻿") if split == 0 else line


def _cells(lines: list[str], sep: str) -> Iterator[list[str]]:
    csv.field_size_limit(CELL)
    return csv.reader((x + "\n" for x in lines), delimiter=sep)


def read_large_csv(spark: SparkSession, path: str, columns: int = 0, sep: str = ",") -> DataFrame:
    """(path, split, row, cells) of UTF-8 CSV files, by splits: cells as Python's csv reads them, rows without any text left out.

    Rows end with LF or CRLF, ``split`` is the byte at which the split begins
    and ``row`` counts in it, so (path, split, row) is the order of the rows.
    Short rows are filled up to ``columns`` cells.  A cell that is never closed
    goes on to the end of its file.  A mark of byte order is left out, and a
    file without text has no rows.
    """
    csv.field_size_limit(CELL)
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"))

    def states(batches):
        own, ends = None, [False, True]
        for key, line in _lines(batches):
            if key != own:
                if own:
                    yield pa.record_batch([[own[0]], [own[1]], [ends[0]], [ends[1]]], ["path", "split", "bare", "quoted"])
                own, ends = key, [False, True]
            if '"' in line:
                ends = [ends_inside(line, e, sep) for e in ends]
        if own:
            yield pa.record_batch([[own[0]], [own[1]], [ends[0]], [ends[1]]], ["path", "split", "bare", "quoted"])

    # two flags for each split of some MB reach the driver, no text
    begins, last, inside = {}, None, False
    for r in lines.mapInArrow(states, "path string, split long, bare boolean, quoted boolean").orderBy("path", "split").toLocalIterator():
        inside = inside if r.path == last else False
        begins[r.path, r.split] = inside
        last, inside = r.path, r.quoted if inside else r.bare
    known = spark.sparkContext.broadcast({k for k, v in begins.items() if v})

    def parse(batches):
        kind = pa.list_(pa.string())

        def batch(key, first, rows):
            return pa.record_batch([[key[0]] * len(rows), pa.array([key[1]] * len(rows), pa.int64()), pa.array(range(first, first + len(rows)), pa.int32()), pa.array([c for c, _, _ in rows], kind), pa.array([p for _, p, _ in rows], pa.string()), pa.array([o for _, _, o in rows], pa.string())], ["path", "split", "row", "cells", "part", "how"])

        def done(key, first, held, open_):
            """The rows of lines of whole rows; ``open_`` is what comes before or after them."""
            rows = [(c, None, None) for c in _cells(held, sep)]
            return batch(key, first, rows + open_) if rows or open_ else None

        own, held, part, count, head, inside = None, [], [], 0, False, False
        for key, line in _lines(batches):
            if key != own:
                if own and (out := done(own, count, held, [(None, "\n".join(part), "middle" if head else "tail")] if part else [])):
                    yield out
                own, held, part, count = key, [], [], 0
                inside = head = key in known.value
            inside = ends_inside(line, inside, sep) if '"' in line else inside
            part.append(line)
            if inside:
                continue
            if head:
                yield batch(own, -1, [(None, "\n".join(part), "head")])
                head = False
            else:
                held += part
            part = []
            if len(held) >= 5000:
                out = done(own, count, held, [])
                count, held = count + out.num_rows, []
                yield out
        if own and (out := done(own, count, held, [(None, "\n".join(part), "middle" if head else "tail")] if part else [])):
            yield out

    read = lines.mapInArrow(parse, "path string, split long, row int, cells array<string>, part string, how string")
    # a row over several splits: from a tail, over the middles after it, to a head
    start = F.max(F.when(F.col("how") == "tail", F.col("split"))).over(Window.partitionBy("path").orderBy("split", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    pieces = read.filter("how IS NOT NULL").withColumn("start", start)
    joined = pieces.groupBy("path", F.col("start").alias("split")).agg(F.max(F.when(F.col("how") == "tail", F.col("row"))).alias("row"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "row", "part"))), lambda x: x["part"]), "\n").alias("part"))

    def close(batches):
        for b in batches:
            cells = [next(csv.reader(io.StringIO(t, newline=""), delimiter=sep), []) for t in b.column("part").to_pylist()]
            yield pa.record_batch([b.column("path"), b.column("split"), b.column("row"), pa.array(cells, pa.list_(pa.string()))], ["path", "split", "row", "cells"])

    rows = read.filter("how IS NULL").select("path", "split", "row", "cells").union(joined.mapInArrow(close, "path string, split long, row int, cells array<string>"))
    filled = F.concat("cells", F.array_repeat(F.lit(""), F.greatest(F.lit(0), F.lit(columns) - F.size("cells"))))
    return rows.filter(F.exists("cells", lambda c: F.trim(c) != "")).withColumn("cells", filled)
