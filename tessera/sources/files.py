"""Files read whole by path: decoding, ragged CSV, ZIP archives, spreadsheets and office documents.

Each file is one row of Spark's binaryFile source, so files are read in
parallel and from any file system; a file is parsed by a small helper.
"""

from __future__ import annotations

import csv
import functools
import datetime
import io
import json
import lzma
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import partial
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.scratch import small_batches

MOST_ENTRIES, MOST_BYTES = 5000, 64 << 20
#: What damaged files raise in the parsers; parts that are missing show as lookups that fail, and so do methods of compression unknown here.
UNREADABLE = (ValueError, LookupError, ArithmeticError, TypeError, AttributeError, RuntimeError, EOFError, csv.Error, lzma.LZMAError, zipfile.BadZipFile, ElementTree.ParseError, zlib.error, struct.error)


def decode_text(content: bytes) -> tuple[str, str, bool, bool]:
    """(text, encoding, certain, had a mark): by byte order mark, else strict UTF-8, else CP949."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if content.startswith(mark):
            return content[len(mark) :].decode(name, "replace"), name, True, True
    try:
        return content.decode("utf-8"), "utf-8", True, False
    except UnicodeDecodeError:
        return content.decode("cp949", "replace"), "cp949", False, False


def decoded(content: Column | str) -> Column:
    """STRUCT<text, encoding, certain, mark> of a column of bytes."""

    @F.pandas_udf("struct<text string, encoding string, certain boolean, mark boolean>")
    def run(part: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode_text(bytes(x) if x is not None else b"") for x in part], columns=["text", "encoding", "certain", "mark"])

    return run(content)


def encoded_cp949(text: Column | str) -> Column:
    """STRUCT<content, missing>: CP949 bytes with ? for characters that it lacks, and those characters."""

    @F.pandas_udf("struct<content binary, missing array<string>>")
    def run(part: pd.Series) -> pd.DataFrame:
        rows = [(x.encode("cp949", "replace"), sorted({c for c in x if c.encode("cp949", "ignore") == b""})) for x in part.fillna("")]
        return pd.DataFrame(rows, columns=["content", "missing"])

    return run(text)


def encode_like(text: str, encoding: str, mark: bool) -> tuple[bytes, str, bool]:
    """(bytes, encoding, lost): the text in the encoding and with the mark that ``decode_text`` told, in UTF-8 where that lacks a character."""
    try:
        own, lost = text.encode(encoding), False
    except UnicodeEncodeError:
        own, encoding, lost = text.encode("utf-8"), "utf-8", True
    marks = {"utf-8": b"\xef\xbb\xbf", "utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff"}
    return (marks.get(encoding, b"") if mark else b"") + own, encoding, lost


def redacted_files(files: DataFrame, kinds: tuple[str, ...] | None = None, mode: str = "partial") -> DataFrame:
    """(path, content, encoding, lost, found) of files with their personal data masked, in the encoding they came in where that can be."""
    from tessera.functions import private

    kinds = kinds or private.DEFAULT_KINDS
    read = files.withColumn("d", decoded("content"))
    found = read.select("path", "d.*", private.redact(F.col("d.text"), kinds, mode).alias("masked"), F.size(private.find_private(F.col("d.text"), kinds)).alias("found"))

    def encoded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(path, *encode_like(*own), n) for path, *own, n in zip(*(part[c] for c in ("path", "masked", "encoding", "mark", "found")), strict=True)]
            yield pd.DataFrame(rows, columns=["path", "content", "encoding", "lost", "found"])

    return found.mapInPandas(encoded, "path string, content binary, encoding string, lost boolean, found int")


def utf8_bytes(text: Column, mark: bool = False) -> Column:
    body = F.encode(text, "UTF-8")
    return F.concat(F.unhex(F.lit("EFBBBF")), body) if mark else body


def image_kind(content: Column) -> Column:
    """png, jpeg, gif or webp by the first bytes."""
    start = lambda h: F.startswith(F.hex(F.substring(content, 1, 12)), F.lit(h))
    webp = start("52494646") & (F.substring(F.hex(content), 17, 8) == "57454250")
    return F.when(start("89504E470D0A1A0A"), "png").when(start("FFD8FF"), "jpeg").when(start("47494638"), "gif").when(webp, "webp")


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def each_file(files: DataFrame, parse: Callable[[str, bytes], Iterator[dict]], schema: str) -> DataFrame:
    """Rows of ``parse(path, content)`` for each file; a file that cannot be read gives a row with its error."""
    names = [x.split()[0] for x in re.split(r",\s*(?![^<]*>)", schema)]

    def frame(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in ("path", *names, "error")})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            held: list[dict] = []
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    rows = [{"path": path, **r} for r in parse(path, bytes(content))]
                except UNREADABLE as error:
                    rows = [{"path": path, "error": str(error) or type(error).__name__}]
                held += rows
                if len(held) > 1000:
                    yield frame(held)
                    held = []
            if held:
                yield frame(held)

    small_batches(files.sparkSession)
    return files.mapInPandas(run, f"path string, {schema}, error string")


def _cells(path: str, content: bytes, strict: bool = False) -> Iterator[dict]:
    text = content.removeprefix(b"\xef\xbb\xbf").decode("utf-8") if strict else decode_text(content)[0]
    csv.field_size_limit(max(len(text), csv.field_size_limit()))
    reader = csv.reader(io.StringIO(text, newline=""), delimiter="\t" if path.lower().endswith((".tsv", ".tab")) else ",")
    rows = [r for r in reader]
    width = max(map(len, rows), default=0)
    for k, row in enumerate(rows):
        if any(c.strip("﻿ \t\r\n\xa0") for c in row):
            yield {"row": k, "cells": row + [""] * (width - len(row))}


def read_csv(files: DataFrame, strict: bool = False) -> DataFrame:
    """(path, row, cells) of CSV and TSV files: never typed, short rows filled up, long ones kept, blank ones left out.

    A file is a task's work here, for widths and encodings are a file's own;
    ``large_csv`` splits files.  ``strict`` refuses what is not UTF-8.
    """
    return each_file(files, partial(_cells, strict=strict), "row long, cells array<string>")


def _json_rows(path: str, content: bytes) -> Iterator[dict]:
    rows = json.loads(decode_text(content)[0])
    if not isinstance(rows, list) or not rows:
        raise ValueError("not a list of rows")
    flat = lambda v: not isinstance(v, (list, dict))
    text = lambda v: None if v is None else ("TRUE" if v else "FALSE") if isinstance(v, bool) else str(v)
    if all(isinstance(r, list) for r in rows):
        table = rows
    elif all(isinstance(r, dict) for r in rows):
        header = list(dict.fromkeys(k for r in rows for k in r))
        table = [header, *([r.get(k) for k in header] for r in rows)]
    else:
        raise ValueError("rows of different kinds")
    if not all(flat(v) for r in table for v in r):
        raise ValueError("nested values")
    for k, r in enumerate(table):
        yield {"row": k, "cells": [text(v) for v in r]}


def read_json(files: DataFrame) -> DataFrame:
    """(path, row, cells) of files with a list of lists or of flat objects, whose names are the first row."""
    return each_file(files, _json_rows, "row long, cells array<string>")


def safe_path(name: str) -> bool:
    parts = re.split(r"[/\\]", name)
    return bool(name) and not name.startswith(("/", "\\")) and ".." not in parts and not re.match("[A-Za-z]:", name) and "\0" not in name


def zip_entries(content: bytes, most_entries: int = MOST_ENTRIES, most_bytes: int = MOST_BYTES) -> Iterator[tuple[str, bytes]]:
    """(name, bytes) of the files of an archive.  Encrypted entries, too many or too large ones raise; unsafe paths are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        entries = archive.infolist()
        if len(entries) > most_entries:
            raise ValueError("too many entries")
        left = most_bytes
        for e in entries:
            name = e.filename
            if not e.flag_bits & 0x800:
                raw = name.encode("cp437", "replace")
                try:
                    name = raw.decode("utf-8")
                except UnicodeDecodeError:
                    name = raw.decode("cp949", "replace")
            if e.is_dir() or not safe_path(name):
                continue
            if e.flag_bits & 1:
                raise ValueError(f"{name} is encrypted")
            with archive.open(e) as f:
                data = f.read(left + 1)
            left -= len(data)
            if left < 0:
                raise ValueError("too large when unpacked")
            if len(data) != e.file_size:
                raise ValueError(f"{name} has another size than stated")
            yield name, data


def read_zip(files: DataFrame) -> DataFrame:
    """(path, pos, name, size, data) of the entries of ZIP files."""

    def parse(path: str, content: bytes) -> Iterator[dict]:
        for k, (name, data) in enumerate(zip_entries(content)):
            yield {"pos": k, "name": name, "size": len(data), "data": data}

    return each_file(files, parse, "pos long, name string, size long, data binary")


class _Refusing(ElementTree.TreeBuilder):
    """A tree of a document without declarations: the parser itself says where one stands, in any encoding."""

    def doctype(self, name, pubid, system):
        raise ValueError("document type declarations are refused")


def parse_xml(data: bytes) -> ElementTree.Element:
    return ElementTree.fromstring(data, ElementTree.XMLParser(target=_Refusing()))


@functools.lru_cache(4096)
def local(tag: str) -> str:
    """The name of an element or attribute without its namespace; few differ in a file, and each is asked for many times."""
    return tag.rpartition("}")[2]


def texts_of(node: ElementTree.Element, name: str) -> str:
    return "".join(x.text or "" for x in node.iter() if local(x.tag) == name)


def column_number(address: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", address.upper())[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


#: Fixed values of the file format: the built-in number formats that are dates or times.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def _date_styles(parts: dict[str, bytes]) -> set[int]:
    """The cell styles whose number format is a date: built in, or with day, month, year or time letters outside quotes and brackets."""
    if "xl/styles.xml" not in parts:
        return set()
    tree = parse_xml(parts["xl/styles.xml"])
    own = {int(x.get("numFmtId")) for x in tree.iter() if local(x.tag) == "numFmt" and re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", x.get("formatCode", "")), re.I)}
    cells = next((x for x in tree if local(x.tag) == "cellXfs"), ())
    return {k for k, x in enumerate(cells) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}


def serial_date(serial: float, from_1904: bool) -> str:
    """A serial day number as a date, with the time where it is not midnight; day 60 of the 1900 system never was."""
    day = datetime.datetime(1904, 1, 1) if from_1904 else datetime.datetime(1899, 12, 30) if serial >= 60 else datetime.datetime(1899, 12, 31)
    at = day + datetime.timedelta(seconds=round(serial * 86400))
    return at.strftime("%Y-%m-%d") if at.time() == datetime.time() else at.strftime("%Y-%m-%d %H:%M:%S")


def _xlsx(path: str, content: bytes) -> Iterator[dict]:
    if not content.startswith(b"PK"):
        yield from _ods(parse_xml(content))
        return
    parts = dict(zip_entries(content))
    if "content.xml" in parts:
        yield from _ods(parse_xml(parts["content.xml"]))
        return
    shared = [texts_of(s, "t") for s in parse_xml(parts["xl/sharedStrings.xml"])] if "xl/sharedStrings.xml" in parts else []
    links = {r.get("Id"): r.get("Target") for r in parse_xml(parts["xl/_rels/workbook.xml.rels"])}
    book, dated = parse_xml(parts["xl/workbook.xml"]), _date_styles(parts)
    from_1904 = any(local(x.tag) == "workbookPr" and x.get("date1904") in ("1", "true") for x in book.iter())
    for position, sheet in enumerate(s for s in book.iter() if local(s.tag) == "sheet"):
        target = links[next(v for k, v in sheet.attrib.items() if local(k) == "id")].lstrip("/")
        tree = parse_xml(parts[target if target.startswith("xl/") else f"xl/{target}"])
        for row in (r for r in tree.iter() if local(r.tag) == "row"):
            cells: dict[int, dict] = {}
            for c in row:
                value = next((v.text for v in c if local(v.tag) == "v"), None)
                kind = {"s": "str", "inlineStr": "str", "str": "str", "b": "bool", "e": "err", "d": "date"}.get(c.get("t"), "num")
                if c.get("t") == "s" and value is not None:
                    value = shared[int(value)]
                elif c.get("t") == "inlineStr":
                    value = texts_of(c, "t")
                elif kind == "bool":
                    value = "TRUE" if value == "1" else "FALSE"
                elif kind == "num" and value is not None and int(c.get("s", 0)) in dated:
                    value, kind = serial_date(float(value), from_1904), "date"
                formula = next((v.text for v in c if local(v.tag) == "f" and v.text), None)
                at = column_number(c.get("r")) if c.get("r") else len(cells)
                cells[at] = {"text": value, "kind": kind if value is not None else "blank", "formula": formula}
            own = [cells.get(k, {"text": None, "kind": "blank", "formula": None}) for k in range(max(cells, default=-1) + 1)]
            yield {"sheet": sheet.get("name"), "position": position, "row": int(row.get("r", 0)) - 1, "cells": [c["text"] for c in own], "kinds": [c["kind"] for c in own], "formulas": [c["formula"] for c in own]}


def _ods(tree: ElementTree.Element) -> Iterator[dict]:
    """The tables of an OpenDocument spreadsheet; repeated cells are repeated, rows that repeat an empty one are not."""
    names = {"float": "num", "percentage": "num", "currency": "num", "string": "str", "boolean": "bool", "date": "date", "time": "date"}
    for position, table in enumerate(t for t in tree.iter() if local(t.tag) == "table"):
        get = lambda x, name: next((v for k, v in x.attrib.items() if local(k) == name), None)
        at = 0
        for row in (r for r in table.iter() if local(r.tag) == "table-row"):
            cells: list[tuple[str | None, str]] = []
            for c in row:
                if local(c.tag) not in ("table-cell", "covered-table-cell"):
                    continue
                kind = names.get(get(c, "value-type") or "", "blank")
                text = "\n".join(_all_text(p) for p in c if local(p.tag) == "p")
                value = {"num": get(c, "value"), "bool": (get(c, "boolean-value") or "").upper(), "date": (get(c, "date-value") or text).replace("T", " ")}.get(kind, text or None)
                kind = "str" if kind == "blank" and value else kind
                cells += [(value, kind)] * min(int(get(c, "number-columns-repeated") or 1), 1 << 14)
            while cells and cells[-1][0] in (None, ""):
                cells.pop()
            times = int(get(row, "number-rows-repeated") or 1)
            for k in range(times if cells else 0):
                yield {"sheet": get(table, "name"), "position": position, "row": at + k, "cells": [c for c, _ in cells], "kinds": [k for _, k in cells], "formulas": [None] * len(cells)}
            at += times


def read_xlsx(files: DataFrame) -> DataFrame:
    """(path, sheet, position, row, cells, kinds, formulas) of the stored values of XLSX, ODS and FODS workbooks.

    kinds says what each cell is (num, str, bool, date, err, blank); dates come as ISO texts.
    """
    return each_file(files, _xlsx, "sheet string, position int, row long, cells array<string>, kinds array<string>, formulas array<string>")


def workbook_cells(sheets: DataFrame) -> DataFrame:
    """The cell model of ``read_xlsx``: a row (book, sheet, row, col, kind, num, str, bool, err, formula) for each cell."""
    each = sheets.filter("sheet IS NOT NULL").select(F.col("path").alias("book"), "sheet", F.col("row").cast("int").alias("row"), F.posexplode(F.arrays_zip("cells", "kinds", "formulas")).alias("col", "c"))
    kind, text = F.when(F.col("c.kinds") == "date", "str").otherwise(F.col("c.kinds")), F.col("c.cells")
    value = lambda name, v: F.when(kind == name, v).alias(name)
    cells = each.select("book", "sheet", "row", "col", kind.alias("kind"), value("num", text.try_cast("double")), value("str", text), value("bool", text == "TRUE"), value("err", text), F.col("c.formulas").alias("formula"))
    return cells.filter("kind <> 'blank' OR formula IS NOT NULL")


def xlsx_bytes(sheets: list[tuple[str, list[list]]]) -> bytes:
    """A workbook of values: numbers as numbers, all else as text."""
    from xml.sax.saxutils import escape, quoteattr

    def letters(n: int) -> str:
        out = ""
        while n >= 0:
            out, n = chr(65 + n % 26) + out, n // 26 - 1
        return out

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="rId{k}"/>' for k, (n, _) in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pack}/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        for k, (_, rows) in enumerate(sheets, 1):
            body = []
            for r, row in enumerate(rows, 1):
                cells = []
                for c, v in enumerate(row):
                    if isinstance(v, (int, float)) and not isinstance(v, bool):
                        cells.append(f'<c r="{letters(c)}{r}"><v>{v}</v></c>')
                    elif v is not None:
                        cells.append(f'<c r="{letters(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>')
                body.append(f'<row r="{r}">{"".join(cells)}</row>')
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(body)}</sheetData></worksheet>')
    return buffer.getvalue()


def _grid(table: ElementTree.Element, row: str, cell: str, text: Callable[[ElementTree.Element], str]) -> list[list[str]]:
    """The texts of a table's cells by rows; spanned columns are filled up with empty ones."""
    out = []
    for r in (x for x in table.iter() if local(x.tag) == row):
        cells: list[str] = []
        for c in (x for x in r if local(x.tag) in cell.split()):
            spans = [int(v) for x in c.iter() if x.attrib for k, v in x.attrib.items() if (local(x.tag), local(k)) in (("gridSpan", "val"), ("cellSpan", "colSpan"))]
            cells += [" ".join(text(c).split())] + [""] * (max([1, *spans]) - 1)
        out.append(cells)
    width = max(map(len, out), default=0)
    return [r + [""] * (width - len(r)) for r in out if r]


def _blocks_of(tree: ElementTree.Element, table: str, row: str, cell: str, paragraphs: tuple[str, ...], text: Callable[[ElementTree.Element], str]) -> Iterator[dict]:
    """Paragraphs and tables in the order of the document; what lies in a table is its own."""
    def walk(node: ElementTree.Element) -> Iterator[dict]:
        for x in node:
            if local(x.tag) == table:
                yield {"kind": "table", "text": None, "rows": _grid(x, row, cell, text)}
            elif local(x.tag) in paragraphs and not any(local(y.tag) == table for y in x.iter()):
                yield {"kind": "paragraph", "text": text(x), "rows": None}
            else:
                yield from walk(x)

    return walk(tree)


#: Elements of text documents that stand for a character.
SIGNS = {"tab": "\t", "br": "\n", "cr": "\n", "line-break": "\n", "lineBreak": "\n", "noBreakHyphen": "-"}


def _all_text(node: ElementTree.Element) -> str:
    """All text of a node, with its tabs, line ends and counted blanks."""
    out = [node.text or ""]
    for x in node:
        if local(x.tag) == "s":
            out.append(" " * min(int(next((v for k, v in x.attrib.items() if local(k) == "c"), 1)), 1 << 14))
        else:
            out.append(SIGNS.get(local(x.tag)) or _all_text(x))
        out.append(x.tail or "")
    return "".join(out)


def _runs(node: ElementTree.Element) -> str:
    """The texts of a paragraph's runs; a tab of the paragraph's settings is no character."""
    if local(node.tag) in ("pPr", "rPr"):
        return ""
    if local(node.tag) == "t":
        return _all_text(node)
    return "".join(SIGNS.get(local(x.tag)) or _runs(x) for x in node)


def _office(path: str, content: bytes) -> Iterator[dict]:
    """Blocks of DOCX, ODT, PPTX, EPUB and HWPX archives, and of FB2 and flat ODT files, in reading order."""
    from tessera.operators.blocks import html_blocks

    odf = ("table", "table-row", "table-cell covered-table-cell", ("p", "h"), _all_text)
    natural = lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)]
    if not content.startswith(b"PK"):
        tree = parse_xml(content)
        if local(tree.tag) == "document":
            found = list(_blocks_of(tree, *odf))
        else:
            bodies = [x for x in tree if local(x.tag) == "body"]
            if not bodies:
                raise ValueError("no known document inside")
            found = [b for x in bodies for b in _blocks_of(x, "table", "tr", "td th", ("p", "v", "subtitle", "text-author"), _all_text)]
    elif "word/document.xml" in (parts := dict(zip_entries(content))):
        found = list(_blocks_of(parse_xml(parts["word/document.xml"]), "tbl", "tr", "tc", ("p",), _runs))
    elif "content.xml" in parts:
        found = list(_blocks_of(parse_xml(parts["content.xml"]), *odf))
    elif "ppt/presentation.xml" in parts:
        links = {r.get("Id"): r.get("Target") for r in parse_xml(parts["ppt/_rels/presentation.xml.rels"])}
        order = [next(v for k, v in s.attrib.items() if local(k) == "id" and "}" in k) for s in parse_xml(parts["ppt/presentation.xml"]).iter() if local(s.tag) == "sldId"]
        found = [b for i in order for b in _blocks_of(parse_xml(parts[f"ppt/{links[i]}"]), "tbl", "tr", "tc", ("p",), _runs)]
    elif "META-INF/container.xml" in parts:
        if "META-INF/encryption.xml" in parts:
            raise ValueError("the book is encrypted")
        opf = next(x.get("full-path") for x in parse_xml(parts["META-INF/container.xml"]).iter() if local(x.tag) == "rootfile")
        tree, base = parse_xml(parts[opf]), opf.rpartition("/")[0]
        items = {x.get("id"): x.get("href") for x in tree.iter() if local(x.tag) == "item"}
        pages = [items[x.get("idref")] for x in tree.iter() if local(x.tag) == "itemref"]
        if not all(safe_path(p) and "://" not in p for p in pages):
            raise ValueError("a page lies outside the book")
        found = [b for p in pages for b in html_blocks(decode_text(parts[f"{base}/{p}" if base else p])[0])]
    else:
        sections = sorted((n for n in parts if re.fullmatch(r"Contents/section\d+\.xml", n)), key=natural)
        if not sections:
            raise ValueError("no known document inside")
        found = [b for s in sections for b in _blocks_of(parse_xml(parts[s]), "tbl", "tr", "tc", ("p",), _runs)]
    for k, block in enumerate(b for b in found if b["rows"] or (b["text"] or "").strip()):
        yield {"pos": k, **block}


def read_office(files: DataFrame) -> DataFrame:
    """(path, pos, kind, text, rows) of the paragraphs and tables of documents."""
    return each_file(files, _office, "pos long, kind string, text string, rows array<array<string>>")


def document_stats(blocks: DataFrame) -> DataFrame:
    """(path, paragraphs, tables, rows, cells, bullets) of what ``read_office`` gives."""
    rows = F.sum(F.when(F.col("kind") == "table", F.size("rows")).otherwise(0))
    cells = F.sum(F.when(F.col("kind") == "table", F.aggregate("rows", F.lit(0), lambda n, r: n + F.size(r))).otherwise(0))
    bullets = F.count_if(F.coalesce(F.col("text").rlike(r"^\s*[-*•·◦▪]\s"), F.lit(False)))
    return blocks.groupBy("path").agg(F.count_if(F.col("kind") == "paragraph").alias("paragraphs"), F.count_if(F.col("kind") == "table").alias("tables"), rows.alias("rows"), cells.alias("cells"), bullets.alias("bullets"))
