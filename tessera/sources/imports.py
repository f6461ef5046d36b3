"""Files of many formats read as one: the ending of a path says which parser it gets."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import partial
from xml.etree import ElementTree

from pyspark.sql import DataFrame

from tessera.operators.blocks import html_blocks, markdown_blocks, paragraph
from tessera.operators.textdiff import split_lines
from tessera.sources.files import _cells, _json_rows, _office, _xlsx, decode_text, each_file, local, parse_xml

#: Endings of the formats that are read.
OFFICE_ENDINGS = {"docm", "docx", "dotx", "epub", "fb2", "fodt", "hwpx", "odp", "odt", "ott", "potx", "ppsx", "pptx"}
WORKBOOK_ENDINGS = {"fods", "ods", "xlsm", "xlsx", "xltm", "xltx"}
#: Types of cells in XML spreadsheets and their kinds.
XML_KINDS = {"Number": "num", "String": "str", "Boolean": "bool", "DateTime": "date", "Error": "err"}
DOCUMENT = "title string, pos long, kind string, text string, rows array<array<string>>"
SHEET = "sheet string, position int, row long, cells array<string>, kinds array<string>, formulas array<string>"


def ending(path: str) -> str:
    file = re.split(r"[/\\]", path)[-1]
    return file.rpartition(".")[2].lower() if "." in file else ""


def stem(path: str) -> str:
    file = re.split(r"[/\\]", path)[-1]
    return file.rpartition(".")[0] or file


def _blocks(path: str, content: bytes) -> Iterator[dict]:
    kind = ending(path)
    if kind in OFFICE_ENDINGS:
        found = list(_office(path, content))
    elif kind in ("md", "markdown"):
        found = markdown_blocks(decode_text(content)[0])
    elif kind == "txt":
        found = [paragraph(line) for line in split_lines(decode_text(content)[0])]
    elif kind in ("html", "htm"):
        found = html_blocks(decode_text(content)[0])
    else:
        raise ValueError(f"no reader of documents for .{kind}")
    for k, block in enumerate(found):
        yield {**block, "title": stem(path), "pos": k}


def read_documents(files: DataFrame) -> DataFrame:
    """(path, title, pos, kind, text, rows, error): the blocks of text, Markdown, HTML and office files (path, content).

    The title is the file's name without its ending.  Each line of a text is a
    paragraph, blank ones too.  Files of other endings
    and damaged ones give one row with an error, empty ones none.
    """
    return each_file(files, _blocks, DOCUMENT)


def attribute(node: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if local(k) == name), None)


def _xml_sheets(content: bytes) -> Iterator[dict]:
    """The sheets of an XML spreadsheet of 2003: rows and cells may say their place, else they follow each other."""
    tree = parse_xml(content)
    if local(tree.tag) != "Workbook":
        raise ValueError("no XML spreadsheet")
    for position, sheet in enumerate(x for x in tree if local(x.tag) == "Worksheet"):
        at = 0
        for row in (x for t in sheet if local(t.tag) == "Table" for x in t if local(x.tag) == "Row"):
            at = int(attribute(row, "Index") or at + 1)
            cells: dict[int, tuple] = {}
            k = 0
            for c in (x for x in row if local(x.tag) == "Cell"):
                k = int(attribute(c, "Index") or k + 1)
                data = next((x for x in c if local(x.tag) == "Data"), None)
                if data is not None:
                    text, kind = "".join(data.itertext()), XML_KINDS.get(attribute(data, "Type") or "String", "str")
                    text = {"bool": "TRUE" if text.strip() in ("1", "true") else "FALSE", "date": text.replace("T", " ").removesuffix(".000")}.get(kind, text)
                    cells[k] = (text, kind, attribute(c, "Formula"))
                k += int(attribute(c, "MergeAcross") or 0)
            if max(cells, default=0) > 1 << 14:
                raise ValueError("a row has too many cells")
            own = [cells.get(k, (None, "blank", None)) for k in range(1, max(cells, default=0) + 1)]
            if own:
                yield {"sheet": attribute(sheet, "Name"), "position": position, "row": at - 1, "cells": [c[0] for c in own], "kinds": [c[1] for c in own], "formulas": [c[2] for c in own]}


def _json_kinds(content: bytes) -> dict[tuple[int, int], str]:
    """The kinds of values in a file of rows, by row and column as ``_json_rows`` gives them."""
    rows = json.loads(decode_text(content)[0])
    header = list(dict.fromkeys(k for r in rows for k in r)) if isinstance(rows[0], dict) else None
    table = rows if header is None else [header, *([r.get(k) for k in header] for r in rows)]
    kind = lambda v: "blank" if v is None else "bool" if isinstance(v, bool) else "str" if isinstance(v, str) else "num"
    return {(r, c): kind(v) for r, row in enumerate(table) for c, v in enumerate(row)}


def _sheets(path: str, content: bytes, strict: bool) -> Iterator[dict]:
    kind = ending(path)
    if kind in WORKBOOK_ENDINGS:
        yield from _xlsx(path, content)
    elif kind == "xml":
        yield from _xml_sheets(content)
    elif kind in ("csv", "tsv"):
        for r in _cells(path, content, strict):
            yield {**r, "sheet": "Sheet1", "position": 0, "kinds": ["str"] * len(r["cells"]), "formulas": [None] * len(r["cells"])}
    elif kind == "json":
        rows = list(_json_rows(path, content))
        kinds = _json_kinds(content)
        for r in rows:
            yield {**r, "sheet": "Sheet1", "position": 0, "kinds": [kinds[r["row"], c] for c in range(len(r["cells"]))], "formulas": [None] * len(r["cells"])}
    else:
        raise ValueError(f"no reader of spreadsheets for .{kind}")


def read_sheets(files: DataFrame, strict: bool = True) -> DataFrame:
    """The rows of ``files.read_xlsx`` for workbooks, XML spreadsheets, CSV, TSV and JSON files (path, content).

    Text files have one sheet, Sheet1; cells of CSV and TSV are text, and with
    ``strict`` these must be UTF-8.  Files of other endings and damaged ones
    give one row with an error.
    """
    return each_file(files, partial(_sheets, strict=strict), SHEET)
