"""Values of cells set in XLSX files whose styles, pictures and other sheets stay as they are.

The XML parser says at which bytes the wanted cells of a sheet begin and end;
only these bytes are written anew, all others are copied.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.scratch import small_batches
from tessera.operators.workbook import VALUE_FIELDS, address
from tessera.sources.files import UNREADABLE, local, parse_xml, zip_entries
from tessera.sources.writers import zipped

#: Types of cells in the file format that hold text, and the type that each kind of value asks for.
#: Kinds of values by the type attribute of a cell, and the attribute that a formula's result of a kind has.
KIND_OF = {"n": "num", "s": "str", "str": "str", "inlineStr": "str", "b": "bool", "e": "err"}
RESULT_TYPE = {"str": "str", "bool": "b", "err": "e"}
#: Parts of a workbook that stand before its settings of calculation.
BEFORE_CALCULATION = {"sheets", "functionGroups", "externalReferences", "definedNames"}


class Spans:
    """Elements of an XML part by the bytes they take: (name, attributes, depth, first, last, inner first, inner last)."""

    def __init__(self, data: bytes):
        self.data, self.open, self.parser = data, [], expat.ParserCreate()
        self.parser.ordered_attributes = False
        self.parser.XmlDeclHandler, self.parser.StartDoctypeDeclHandler = self._declared, self._refused
        self.parser.StartElementHandler, self.parser.EndElementHandler = self._start, self._stop

    def _declared(self, version, encoding, standalone):
        if encoding and encoding.lower() not in ("utf-8", "us-ascii"):
            raise ValueError(f"a part is not UTF-8 but {encoding}")

    def _refused(self, *_):
        raise ValueError("document type declarations are refused")

    def _start(self, name, attributes):
        self.open.append((name, attributes, self.parser.CurrentByteIndex))

    def _stop(self, name):
        name, attributes, first = self.open.pop()
        at = self.parser.CurrentByteIndex
        tag = f"</{name}".encode()
        last = self.data.index(b">", at) + 1 if self.data.startswith(tag, at) and self.data[at + len(tag) : at + len(tag) + 1] in (b">", b" ", b"\t", b"\r", b"\n") else at
        self.found(name.rpartition(":")[2], name, attributes, len(self.open), first, last)

    def found(self, bare: str, name: str, attributes: dict, depth: int, first: int, last: int) -> None:
        raise NotImplementedError

    def run(self):
        if self.data[:2] in (b"\xff\xfe", b"\xfe\xff"):
            raise ValueError("a part is not UTF-8")
        try:
            self.parser.Parse(self.data, True)
        except expat.ExpatError as error:
            raise ValueError(f"a part cannot be read: {error}") from error
        return self


class _Cells(Spans):
    """The wanted cells of a sheet, with the bytes of their formulas and whether they hold a value."""

    def __init__(self, data: bytes, wanted: set[str]):
        super().__init__(data)
        self.wanted, self.cells, self.formula, self.valued = wanted, {}, None, False

    def found(self, bare, name, attributes, depth, first, last):
        if bare == "f":
            self.formula = self.data[first:last]
        elif bare in ("v", "is"):
            self.valued = True
        elif bare == "c":
            if attributes.get("r") in self.wanted:
                self.cells[attributes["r"]] = (name, attributes, first, last, self.formula, self.valued)
            self.formula, self.valued = None, False


class _Workbook(Spans):
    """Where the settings of calculation stand, or would have to stand."""

    settings, place = None, None

    def found(self, bare, name, attributes, depth, first, last):
        if bare == "calcPr":
            self.settings = (name, attributes, first, last)
        elif depth == 1 and bare in BEFORE_CALCULATION:
            self.place = (name.replace(bare, "calcPr"), {}, last, last)


def tag(name: str, attributes: dict, inside: str = "") -> str:
    return f"<{name}{''.join(f' {k}={quoteattr(v)}' for k, v in attributes.items())}{f'>{inside}</{name}>' if inside else '/>'}"


def shown(kind: str, edit: dict) -> str:
    if kind == "num":
        return repr(int(edit["num"])) if float(edit["num"]).is_integer() and abs(edit["num"]) < 1e15 else repr(float(edit["num"]))
    return {"str": edit["str"], "bool": "1" if edit["bool"] else "0", "err": edit["err"], "blank": ""}[kind] or ""


def new_cell(cell: tuple, edit: dict) -> tuple[bytes | None, str | None]:
    """(the bytes of a cell with another value, null), or (null, why it cannot have it).

    A formula may result in any kind, an empty one being no value at all; a
    cell without a formula keeps its kind.  Texts are written in place, as the
    table of shared ones stays as it is.
    """
    name, attributes, _, _, formula, valued = cell
    kind = edit["kind"]
    holds = KIND_OF.get(attributes.get("t", "n")) if valued else "blank"
    if formula is None and (kind != holds or kind == "blank"):
        return None, f"the cell holds {holds or 'a value of another type'}, not {kind}"
    own = lambda part: f"{name.rpartition(':')[0]}:{part}".lstrip(":")
    in_place = formula is None and kind == "str"
    stored = "inlineStr" if in_place else RESULT_TYPE.get(kind)
    rest = {k: v for k, v in attributes.items() if k != "t"} | ({"t": stored} if stored else {})
    value = escape(shown(kind, edit))
    if in_place:
        value = f'<{own("is")}><{own("t")} xml:space="preserve">{value}</{own("t")}></{own("is")}>'
    elif kind != "blank":
        value = f"<{own('v')}>{value}</{own('v')}>"
    return tag(name, rest, (formula or b"").decode() + value).encode(), None


def spliced(data: bytes, pieces: list[tuple[int, int, bytes]]) -> bytes:
    out, at = [], 0
    for first, last, new in sorted(pieces):
        out += [data[at:first], new]
        at = last
    return b"".join([*out, data[at:]])


def calculated_when_opened(data: bytes) -> bytes:
    """A workbook part that asks for all formulas to be computed anew."""
    book = _Workbook(data).run()
    if not (book.settings or book.place):
        return data
    name, attributes, first, last = book.settings or book.place
    return spliced(data, [(first, last, tag(name, attributes | {"fullCalcOnLoad": "1"}).encode())])


def patch_xlsx(content: bytes, edits: list[dict]) -> tuple[bytes, list[dict]]:
    """(file, problems) after ``edits`` (sheet, address, kind, num, str, bool, err); a file that nothing changes stays the same bytes."""
    parts = dict(zip_entries(content))
    if "xl/workbook.xml" not in parts:
        raise ValueError("no XLSX workbook")
    links = {r.get("Id"): r.get("Target") for r in parse_xml(parts["xl/_rels/workbook.xml.rels"])}
    targets = {s.get("name"): links.get(next((v for k, v in s.attrib.items() if local(k) == "id"), None)) for s in parse_xml(parts["xl/workbook.xml"]).iter() if local(s.tag) == "sheet"}
    paths = {n: t.lstrip("/") if t.startswith("/") else f"xl/{t}" for n, t in targets.items() if t}
    problems, changed = [], False
    for sheet in dict.fromkeys(e["sheet"] for e in edits):
        own = {e["address"]: e for e in edits if e["sheet"] == sheet}
        path, pieces = paths.get(sheet), []
        cells = _Cells(parts[path], set(own)).run().cells if path in parts else {}
        for at, edit in own.items():
            if path not in parts:
                new, why = None, "no such sheet"
            else:
                new, why = new_cell(cells[at], edit) if at in cells else (None, "the cell is empty")
            if new is None:
                problems.append({"sheet": sheet, "address": at, "problem": why})
            else:
                pieces.append((*cells[at][2:4], new))
        if pieces:
            parts[path], changed = spliced(parts[path], pieces), True
    if not changed:
        return content, problems
    parts["xl/workbook.xml"] = calculated_when_opened(parts["xl/workbook.xml"])
    return zipped(list(parts.items())), problems


def patched_workbooks(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, content, problems, error) of XLSX files (path, content) after edits (path, sheet, row, col and a value's fields).

    Values are those of ``operators.workbook``: ``recalculate``'s changes can be
    written with ``changes.select(F.col("book").alias("path"), "sheet", "row",
    "col", "after.*")``.  Cells with a formula keep it and get the value as its
    stored result; cells of numbers take numbers, cells of text take text, and
    what cannot be written is among the problems.  Of several edits of one cell
    the greatest counts; edits without a file are ignored, a file without edits
    or one that cannot be read (with its error) stays as it is.  Repeated paths
    are patched each.  A file's edits are no more than its cells, for those of
    one cell are brought together first.
    """
    place = ["path", "sheet", "row", "col"]
    single = edits.filter("sheet IS NOT NULL AND row IS NOT NULL AND col IS NOT NULL").groupBy(*place).agg(F.max(F.struct(*VALUE_FIELDS)).alias("v"))
    flat = single.select("path", "sheet", address(F.col("row"), F.col("col")).alias("address"), "v.*")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = lambda values: pd.Series(values, dtype=object)
        for part in parts:
            made = [one(content, [] if wanted is None else list(wanted)) for content, wanted in zip(part["content"], part["wanted"], strict=True)]
            yield pd.DataFrame({"path": part["path"], "content": each([m[0] for m in made]), "problems": each([m[1] for m in made]), "error": each([m[2] for m in made])})

    def one(content: bytes | None, wanted: list[dict]) -> tuple:
        if content is None or not wanted:
            return content, [], None
        try:
            return *patch_xlsx(bytes(content), wanted), None
        except UNREADABLE as error:
            return content, [], str(error) or type(error).__name__

    schema = "path string, content binary, problems array<struct<sheet string, address string, problem string>>, error string"
    lists = flat.groupBy(F.col("path").alias("own")).agg(F.array_sort(F.collect_list(F.struct(*[c for c in flat.columns if c != "path"]))).alias("wanted"))
    small_batches(files.sparkSession)
    return files.select("path", "content").join(lists, F.col("path").eqNullSafe(F.col("own")), "left").select("path", "content", "wanted").mapInPandas(run, schema)


def edit(kind: str, value: Column) -> list[Column]:
    """The fields of a value of ``kind``, the others null."""
    of = {"num": "num", "str": "str", "bool": "bool", "err": "err"}
    types = {"num": "double", "str": "string", "bool": "boolean", "err": "string"}
    return [F.lit(kind).alias("kind"), *[(value if of.get(kind) == n else F.lit(None)).cast(t).alias(n) for n, t in types.items()]]
