"""Tables: merging by header, splitting, blank rows, guarded text, page ranges."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.scratch import Scratch


def occurrence_keys(header: Sequence[str]) -> list[tuple[str, int]]:
    """(trimmed name, how many equal ones stood before) of each column."""
    seen: dict[str, int] = {}
    out = []
    for name in (h.strip() for h in header):
        out.append((name, seen.get(name, 0)))
        seen[name] = out[-1][1] + 1
    return out


def merge_tables(tables: Sequence[tuple[str, Sequence[str], DataFrame]], source: str | None = None) -> tuple[DataFrame, list[str]]:
    """UNION ALL by header name of (label, header, frame), and the header of the result.

    A header may name columns twice: the k-th of a name meets the k-th of the
    other tables.  The first table's order is the base; new names follow.  The
    result's columns are c0, c1, ... (strings), after ``source`` if given.
    """
    keys: list[tuple[str, int]] = []
    for _, header, _ in tables:
        keys += [k for k in occurrence_keys(header) if k not in keys]
    frames = []
    for label, header, df in tables:
        own = dict(zip(occurrence_keys(header), df.columns, strict=True))
        columns = [(F.col(f"`{own[k]}`") if k in own else F.lit(None)).cast("string").alias(f"c{n}") for n, k in enumerate(keys)]
        frames.append(df.select(*([F.lit(label).alias(source)] if source else []), *columns))
    return reduce(DataFrame.unionAll, frames), [k[0] for k in keys]


def is_blank(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c.cast("string"), r"(?U)[\s﻿]+", "") == "", F.lit(True))


def drop_blank_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = columns or df.columns
    return df.filter(reduce(lambda a, b: a | b, [~is_blank(F.col(f"`{c}`")) for c in names]))


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with the place of each row in ``order``, from 1, as ``name``.

    Places come from range partitions: each numbers its rows, and the counts of
    those before are added, so no task sees all rows.  The sorted rows are
    written once, so both reads of them see the same partitions; the counts are
    one row for each partition.
    """
    ws = Scratch(df.sparkSession, "numbered")
    parted = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()})
    parted = ws.write(parted, "rows")
    local = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    before = parted.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return parted.join(before.select("_p", "_before"), "_p").withColumn(name, (F.col("_before") + local + 1).cast("long")).drop("_p", "_m", "_before")


def split_by_rows(df: DataFrame, order: Sequence[Column], size: int) -> DataFrame:
    """``df`` with part, from 1: the row's place in ``order`` by ``size``."""
    return numbered(df, order, "_place").withColumn("part", (F.floor((F.col("_place") - 1) / size) + 1).cast("long")).drop("_place")


def split_by_column(df: DataFrame, column: str, order: Column) -> DataFrame:
    """(key, first, rows) of the groups of a column in order of first appearance; blanks are the null key."""
    key = F.when(~is_blank(F.col(column)), F.col(column))
    return df.groupBy(key.alias("key")).agg(F.min(order).alias("first"), F.count("*").alias("rows"))


def cell_text(c: Column, kind: str) -> Column:
    """A cell as text: null empty, booleans in capitals, times only where they are not midnight."""
    if kind == "boolean":
        out = F.upper(c.cast("string"))
    elif kind == "timestamp":
        midnight = F.date_format(c, "HH:mm:ss") == "00:00:00"
        out = F.when(midnight, F.date_format(c, "yyyy-MM-dd")).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    else:
        out = c.cast("string")
    return F.coalesce(out, F.lit(""))


def guard(c: Column, numbers_pass: bool = True) -> Column:
    """Text that a spreadsheet would run as a formula gets a ' in front; numbers, with commas or not, may pass."""
    risky = c.rlike(r"^[=+\-@\t\r]")
    if numbers_pass:
        risky = risky & ~c.rlike(r"^[+-]?([0-9]+(,[0-9]{3})*\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?%?$")
    return F.when(risky, F.concat(F.lit("'"), c)).otherwise(c)


def csv_line(df: DataFrame, columns: Sequence[str], sep: str = ",", numbers_pass: bool = True) -> Column:
    """A row as a guarded, minimally quoted line."""
    def cell(c: str) -> Column:
        text = guard(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), numbers_pass)
        return F.when(text.rlike(f'["\r\n{re.escape(sep)}]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)
    return F.concat_ws(sep, *[cell(c) for c in columns])


def json_row(columns: Sequence[str]) -> Column:
    """A row as a JSON array of strings, nulls kept."""
    return F.to_json(F.array(*[F.col(f"`{c}`").cast("string") for c in columns]), {"ignoreNullFields": "false"})


def html_row(columns: Sequence[str], tag: str = "td") -> Column:
    from tessera.functions.texts import escape_xml

    return F.concat(F.lit("<tr>"), *[F.concat(F.lit(f"<{tag}>"), escape_xml(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))), F.lit(f"</{tag}>")) for c in columns], F.lit("</tr>"))


def markdown_row(columns: Sequence[str]) -> Column:
    cell = lambda c: F.regexp_replace(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\s*[\r\n]+\s*", "<br>")
    return F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |"))


def table_labels(tables: DataFrame) -> DataFrame:
    """``tables`` (file, sheet) with label: the file's name, and its sheet's where several of a file are used."""
    several = F.count("*").over(Window.partitionBy("file")) > 1
    return tables.withColumn("label", F.when(several, F.concat_ws(" - ", "file", "sheet")).otherwise(F.col("file")))


def inspect_sheets(cells: DataFrame, names: int = 100, columns: int = 200, header_rows: int = 21) -> DataFrame:
    """(path, sheet, headers, rows) of a table of cells (path, sheet, row, cells): the first ``names`` sheets of each file.

    headers is the first row that is not blank among the first ``header_rows``,
    rows the last row's place, so that blank rows between count.
    """
    filled = F.exists("cells", lambda c: ~is_blank(c))
    head = F.min(F.when(filled & (F.col("row") < header_rows), F.struct("row", F.slice("cells", 1, columns).alias("cells"))))
    found = cells.groupBy("path", "sheet").agg(head["cells"].alias("headers"), (F.max("row") + 1).cast("long").alias("rows"))
    place = F.row_number().over(Window.partitionBy("path").orderBy("sheet"))
    return found.withColumn("_place", place).filter(F.col("_place") <= names).drop("_place")


def pick_sheets(cells: DataFrame, choice: str | None = None) -> DataFrame:
    """The cells of the first sheet of each file, of a named one, or of all (*)."""
    if choice == "*":
        return cells
    if choice is not None:
        return cells.filter(F.col("sheet") == choice)
    first = cells.groupBy("path").agg(F.min(F.struct("position", "sheet"))["sheet"].alias("_first"))
    return cells.join(first, "path").filter("sheet = _first").drop("_first")


def write_csv(df: DataFrame, columns: Sequence[str], header: Sequence[str], path: str, sep: str = ",", numbers_pass: bool = True, mark: bool = True) -> None:
    """``df`` as guarded, minimally quoted text files with CRLF: each with its byte order mark and header.

    A file for each partition, so any number of rows; an empty table gives one
    file with the header.
    """
    title = sep.join(f'"{h.replace(chr(34), chr(34) * 2)}"' if any(c in h for c in f'"\r\n{sep}') else h for h in header)
    start = ("\ufeff" if mark else "") + title

    def run(batches):
        first = True
        for batch in batches:
            lines = batch.column("value").to_pylist()
            if first:
                lines, first = [start, *lines], False
            yield pa.record_batch([pa.array(lines, pa.string())], names=["value"])
        if first:
            yield pa.record_batch([pa.array([start], pa.string())], names=["value"])

    lines = df.select(csv_line(df, columns, sep, numbers_pass).alias("value"))
    lines.mapInArrow(run, "value string").write.option("lineSep", "\r\n").text(path)


def write_parts(df: DataFrame, part: str, path: str, form: str = "csv") -> None:
    """A folder for each value of ``part``, as ``split_by_rows`` and the groups of a column give it."""
    df.write.partitionBy(part).format(form).option("header", "true").save(path)


def page_ranges(text: str, count: int) -> list[int]:
    """The pages of "1-3, 5, 8-" in ascending order, each once."""
    pages: set[int] = set()
    for part in (p.strip() for p in text.split(",")):
        m = re.fullmatch(r"([0-9]*)\s*(-?)\s*([0-9]*)", part)
        if not m or not (m[1] or m[3]):
            raise ValueError(f"not a page range: {part!r}")
        low, high = int(m[1] or 1), int(m[3] or count) if m[2] else int(m[1])
        if not 1 <= low <= high <= count:
            raise ValueError(f"not within 1 to {count}: {part!r}")
        pages.update(range(low, high + 1))
    return sorted(pages)


def in_pages(page: Column, text: str, count: int) -> Column:
    """True for the pages of a range list, as conditions on the page number."""
    runs: list[list[int]] = []
    for p in page_ranges(text, count):
        if runs and runs[-1][1] == p - 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return reduce(lambda a, b: a | b, [page.between(a, b) for a, b in runs])


def split_ranges(text: str, count: int) -> list[list[int]]:
    """Ordered groups of "1-3; 4,6"; a page in two groups raises."""
    groups = [page_ranges(g, count) for g in text.split(";")]
    flat = [p for g in groups for p in g]
    if len(flat) != len(set(flat)):
        raise ValueError("a page is in two groups")
    return groups
