"""Workbooks as long tables of cells: references of formulas, and recalculation after edits.

A cell is a row (book, sheet, row, col, kind, num, str, bool, err, formula) with
zero-based places; kind is num, str, bool, err or blank.  Which formulas an edit
reaches, in which order they can be computed and what their ranges add up to are
joins and aggregations; only the last step, one formula over values and sums
that are at hand, is done row by row.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.formula import DIV, NUM, VALUE, UnsupportedFormula, column_letters
from tessera.operators import ranges
from tessera.operators.scratch import Scratch, batches_of

VALUE_FIELDS = ("kind", "num", "str", "bool", "err")
PLACE = ("book", "sheet", "row", "col")
LAST_ROW, LAST_COLUMN, BLOCK = (1 << 20) - 1, (1 << 14) - 1, 1024
SHEET = r"(?:(?P<sheet>'(?:[^']|'')+'|[^\W\d][\w.]*)!)?"
TOKEN = re.compile(
    rf"""\s*(?:(?P<text>"(?:[^"]|"")*")|(?P<error>\#(?:DIV/0!|VALUE!|NUM!|REF!|NAME\?|N/A|NULL!))
    |{SHEET}(?P<area>\$?[A-Za-z]{{1,3}}\$?[0-9]+(?:\s*:\s*\$?[A-Za-z]{{1,3}}\$?[0-9]+)?(?![\w(.])|\$?[A-Za-z]{{1,3}}\s*:\s*\$?[A-Za-z]{{1,3}}(?![\w(.]))
    |(?P<number>(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)|(?P<name>(?:_xlfn\.)?[^\W\d][\w.]*)|(?P<op><=|>=|<>|[-+*/^&=<>%(),;]))""",
    re.VERBOSE,
)
BINDS = {"=": 1, "<>": 1, "<": 1, "<=": 1, ">": 1, ">=": 1, "&": 2, "+": 3, "-": 3, "*": 4, "/": 4, "^": 5}
OVER_RANGES = ("SUM", "PRODUCT", "MIN", "MAX", "AVERAGE", "COUNT", "COUNTA", "AND", "OR")
OTHERS = ("ROUND", "ROUNDUP", "ROUNDDOWN", "TRUNC", "INT", "ABS", "MOD", "IF", "IFERROR", "NOT", "CONCAT", "CONCATENATE", "VALUE", "SUMPRODUCT")


class Err(str):
    """An error code as a value."""


def corner(text: str) -> tuple[int | None, int]:
    """(row, column) of an address, zero-based; no row for a bare column."""
    letters, digits = re.fullmatch(r"([A-Za-z]+)([0-9]*)", text.replace("$", "").strip()).groups()
    col = 0
    for c in letters.upper():
        col = 26 * col + ord(c) - 64
    return (int(digits) - 1 if digits else None), col - 1


class Formula:
    """A formula as a tree, and the areas that it reads: (number, part, parts, kind, sheet, r0, c0, r1, c1).

    kind is cell for one cell, range for several, zip for those that SUMPRODUCT
    reads side by side, which share a number.
    """

    def __init__(self, text: str, sheet: str):
        body = text.strip().removeprefix("=")
        self.sheet, self.areas, self.tokens, at = sheet, [], [], 0
        while body[at:].strip():
            if not (m := TOKEN.match(body, at)):
                raise UnsupportedFormula(f"cannot read {body[at:]!r}")
            kind = m.lastgroup
            self.tokens.append((kind, m[kind], m["sheet"]))
            at = m.end()
        self.tokens.append(("end", "", None))
        self.at = 0
        self.tree = self.expression(1)
        if self.tokens[self.at][0] != "end":
            raise UnsupportedFormula(f"unexpected {self.tokens[self.at][1]!r}")

    def take(self, *values: str) -> bool:
        kind, value, _ = self.tokens[self.at]
        found = kind == "op" and value in values
        self.at += found
        return found

    def expression(self, least: int):
        left = self.prefix()
        while (op := self.tokens[self.at])[0] == "op" and BINDS.get(op[1], 0) >= least:
            self.at += 1
            left = ("binary", op[1], left, self.expression(BINDS[op[1]] + 1))
        return left

    def prefix(self):
        if self.take("+"):
            return ("sign", 1, self.prefix())
        if self.take("-"):
            return ("sign", -1, self.prefix())
        out = self.operand()
        while self.take("%"):
            out = ("percent", out)
        return out

    def operand(self):
        kind, value, sheet = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return ("value", float(value))
        if kind == "text":
            return ("value", value[1:-1].replace('""', '"'))
        if kind == "error":
            return ("value", Err(value))
        if kind == "area":
            return self.area(value, sheet)
        if kind == "name" and self.take("("):
            return self.call(value.upper().removeprefix("_XLFN."))
        if kind == "name" and value.upper() in ("TRUE", "FALSE"):
            return ("value", value.upper() == "TRUE")
        if kind == "op" and value == "(":
            out = self.expression(1)
            if self.take(")"):
                return out
        raise UnsupportedFormula(f"unexpected {value or 'end'!r}")

    def area(self, text: str, sheet: str | None):
        one, _, other = text.partition(":")
        (r0, c0), (r1, c1) = corner(one), corner(other or one)
        r0, r1 = sorted((0 if r0 is None else r0, LAST_ROW if r1 is None else r1))
        c0, c1 = sorted((c0, c1))
        name = self.sheet if sheet is None else sheet.strip("'").replace("''", "'") if sheet.startswith("'") else sheet
        self.areas.append([len(self.areas), 0, 1, "cell" if (r0, c0) == (r1, c1) else "range", name, r0, c0, r1, c1])
        return (self.areas[-1][3], len(self.areas) - 1)

    def call(self, name: str):
        args = []
        while not self.take(")"):
            if self.tokens[self.at][:2] in (("op", ","), ("op", ";"), ("op", ")")):
                args.append(("value", None))
            else:
                args.append(self.expression(1))
            if not self.take(",", ";") and self.tokens[self.at][:2] != ("op", ")"):
                raise UnsupportedFormula("a comma or bracket is missing")
        if name == "SUMPRODUCT" and args and all(a[0] in ("cell", "range") for a in args):
            own = [self.areas[a[1]] for a in args]
            sizes = {(a[7] - a[5], a[8] - a[6]) for a in own}
            if len(sizes) > 1:
                return ("value", Err(VALUE))
            for part, a in enumerate(own):
                a[:4] = [own[0][0], part, len(own), "zip"]
            return ("zip", own[0][0])
        return ("call", name, args)


@lru_cache(50_000)
def read(text: str, sheet: str) -> Formula:
    return Formula(text, sheet)


class _Failed(Exception):
    """An error value on its way up."""


def as_number(v) -> float:
    if isinstance(v, Err):
        raise _Failed(v)
    if v is None or isinstance(v, (bool, float)):
        return float(v or 0)
    bare = v.replace(",", "").strip()
    if bare and not re.fullmatch(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", bare) or not bare and v:
        raise _Failed(Err(VALUE))
    return float(bare or 0)


def as_text(v) -> str:
    if isinstance(v, Err):
        raise _Failed(v)
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, float):
        v = float(f"{v:.14e}")
        return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)
    return v or ""


def as_truth(v) -> bool:
    if isinstance(v, str) and not isinstance(v, Err):
        if v.lower() in ("true", "false", ""):
            return v.lower() == "true"
        raise _Failed(Err(VALUE))
    return as_number(v) != 0


def rounded(x: float, digits: float, how: str) -> float:
    scale = 10.0 ** math.floor(digits)
    m = float(f"{abs(x) * scale:.14e}")
    return math.copysign({"ROUND": math.floor(m + 0.5), "ROUNDUP": math.ceil(m)}.get(how, math.floor(m)) / scale, x)


class Evaluation:
    """The value of a formula's tree, given what its areas hold (see ``gathered``)."""

    def __init__(self, held: dict[int, dict]):
        self.held = held

    def value(self, node):
        """Of a node; errors are values."""
        try:
            v = self.of(node)
        except _Failed as error:
            return error.args[0]
        return Err(NUM) if isinstance(v, float) and not math.isfinite(v) else v

    def of(self, node):
        kind = node[0]
        if kind == "value":
            return node[1]
        if kind == "cell":
            return cell_value(self.held.get(node[1]))
        if kind == "zip":
            own = self.held.get(node[1]) or {}
            return Err(own["error"]) if own.get("error") else own.get("total") or 0.0
        if kind == "range":
            return Err(VALUE)
        if kind == "sign":
            return node[1] * as_number(self.of(node[2]))
        if kind == "percent":
            return as_number(self.of(node[1])) / 100
        if kind == "binary":
            return self.binary(node[1], self.of(node[2]), self.of(node[3]))
        return self.call(node[1], node[2])

    def binary(self, op: str, a, b):
        if op == "&":
            return as_text(a) + as_text(b)
        if BINDS[op] == 1:
            for v in (a, b):
                if isinstance(v, Err):
                    raise _Failed(v)
            empty = {float: 0.0, str: "", bool: False}
            a, b = (empty.get(type(y), 0.0) if x is None else x for x, y in ((a, b), (b, a)))
            rank = lambda v: (1, v) if type(v) is float else (2, v.lower()) if isinstance(v, str) else (3, v)
            x, y = rank(a), rank(b)
            return {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        a, b = as_number(a), as_number(b)
        if op == "/":
            if b == 0:
                raise _Failed(Err(DIV))
            return a / b
        if op == "^":
            try:
                v = a**b
            except (OverflowError, ZeroDivisionError):
                v = math.inf
            if isinstance(v, complex):
                raise _Failed(Err(NUM))
            return float(v)
        return a + b if op == "+" else a - b if op == "-" else a * b

    def over_ranges(self, name: str, args: list):
        """SUM and its like: ranges bring sums of their own, in which text and blanks do not count; other arguments are coerced."""
        n, total, product, low, high, filled, truths = 0, 0.0, 1.0, [], [], 0, []
        for arg in args:
            if arg[0] == "range":
                own = self.held.get(arg[1])
                if not own:
                    continue
                if own["error"] and name not in ("COUNT", "COUNTA"):
                    raise _Failed(Err(own["error"]))
                n += own["n"]
                if name == "COUNTA":
                    filled += own["filled"]
                elif name in ("AND", "OR"):
                    truths += [t for t in (own["every" if name == "AND" else "some"],) if t is not None]
                elif own["n"] and name in ("SUM", "AVERAGE"):
                    total += own["total"]
                elif own["n"] and name == "PRODUCT":
                    product *= own["product"]
                elif own["n"] and name == "MIN":
                    low.append(own["low"])
                elif own["n"] and name == "MAX":
                    high.append(own["high"])
                continue
            v = self.value(arg)
            filled += 1
            if name == "COUNT":
                try:
                    n += v is not None and as_number(v) is not None
                except _Failed:
                    pass
            elif name in ("AND", "OR"):
                truths.append(as_truth(v))
            elif name != "COUNTA":
                x = as_number(v)
                n, total, product = n + 1, total + x, product * x
                low.append(x)
                high.append(x)
        if name == "AVERAGE" and not n:
            raise _Failed(Err(DIV))
        return {"SUM": total, "PRODUCT": product, "MIN": min(low, default=0.0), "MAX": max(high, default=0.0), "AVERAGE": total / max(n, 1), "COUNT": float(n), "COUNTA": float(filled), "AND": all(truths), "OR": any(truths)}[name]

    def call(self, name: str, args: list):
        if name in OVER_RANGES:
            return self.over_ranges(name, args)
        if name == "SUMPRODUCT":
            if any(a[0] == "range" for a in args):
                raise _Failed(Err(VALUE))
            values = [self.of(a) for a in args]
            return math.prod(v if type(v) is float else 0.0 for v in values) if not any(isinstance(v, Err) for v in values) else next(v for v in values if isinstance(v, Err))
        if name == "IF" and 2 <= len(args) <= 3:
            return self.of(args[1]) if as_truth(self.of(args[0])) else self.of(args[2]) if len(args) == 3 else False
        if name == "IFERROR" and len(args) == 2:
            v = self.value(args[0])
            return self.of(args[1]) if isinstance(v, Err) else v
        if name in ("CONCAT", "CONCATENATE") and args:
            return "".join(as_text(self.of(a)) for a in args)
        if name == "NOT" and len(args) == 1:
            return not as_truth(self.of(args[0]))
        if name in OTHERS:
            x = [as_number(self.of(a)) for a in args]
            if name in ("ROUND", "ROUNDUP", "ROUNDDOWN", "TRUNC") and 1 <= len(x) <= 2:
                return rounded(x[0], x[1] if len(x) == 2 else 0.0, name)
            if name == "MOD" and len(x) == 2:
                if not x[1]:
                    raise _Failed(Err(DIV))
                return x[0] - x[1] * math.floor(x[0] / x[1])
            if name in ("INT", "ABS", "VALUE") and len(x) == 1:
                return float(math.floor(float(f"{x[0]:.14e}"))) if name == "INT" else abs(x[0]) if name == "ABS" else x[0]
        raise UnsupportedFormula(f"no function {name} of {len(args)} arguments")


def cell_value(own: dict | None):
    if not own or own["kind"] in (None, "blank"):
        return None
    return Err(own["err"]) if own["kind"] == "err" else own[own["kind"]]


AREAS = "array<struct<need int, part int, parts int, kind string, sheet string, r0 int, c0 int, r1 int, c1 int>>"


def with_areas(formulas: DataFrame) -> DataFrame:
    """``formulas`` (sheet, formula, ...) with areas, the references of each, and unreadable, why it has none."""
    names = [x.split()[0] for x in AREAS[len("array<struct<") : -2].split(", ")]
    kind = pa.list_(pa.struct([(n, pa.string() if n in ("kind", "sheet") else pa.int32()) for n in names]))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            areas, errors = [], []
            for text, sheet in zip(batch.column("formula").to_pylist(), batch.column("sheet").to_pylist(), strict=True):
                try:
                    areas.append([dict(zip(names, a, strict=True)) for a in read(text, sheet).areas])
                    errors.append(None)
                except UnsupportedFormula as error:
                    areas.append([])
                    errors.append(str(error))
            yield pa.record_batch([*batch.columns, pa.array(areas, kind), pa.array(errors, pa.string())], names=[*batch.schema.names, "areas", "unreadable"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in formulas.schema)
    return formulas.mapInArrow(run, f"{own}, areas {AREAS}, unreadable string")


def tiles(areas: DataFrame, sheets: DataFrame) -> DataFrame:
    """A row for each column and each ``BLOCK`` rows of an area that its sheet reaches, the keys of a range join."""
    bounded = areas.join(sheets, ["book", "sheet"]).withColumns({"to_row": F.least("r1", "rows"), "to_col": F.least("c1", "cols")}).filter("r0 <= to_row AND c0 <= to_col")
    across = bounded.withColumn("col", F.explode(F.sequence("c0", "to_col")))
    return across.withColumn("block", F.explode(F.sequence(F.floor(F.col("r0") / BLOCK).cast("int"), F.floor(F.col("to_row") / BLOCK).cast("int")))).drop("rows", "cols", "to_row", "to_col")


def within(tiled: DataFrame, cells: DataFrame) -> DataFrame:
    """The cells that lie in areas: an equi-join on tiles, and the rows between."""
    placed = cells.withColumn("block", F.floor(F.col("row") / BLOCK).cast("int"))
    return tiled.join(placed, ["book", "sheet", "col", "block"]).filter("row BETWEEN r0 AND r1")


def range_aggregates() -> tuple[dict[str, Column], dict[str, Column]]:
    """What a range makes of its cells, running and merged; the ends of ranges lie among the cells with no kind."""
    num = F.when(F.col("kind_v") == "num", F.col("num"))
    truth = F.when(F.col("kind_v") == "bool", F.col("bool")).otherwise(num != 0)
    running = {
        "n": F.count(num), "total": F.sum(num), "product": F.product(num), "low": F.min(num), "high": F.max(num), "filled": F.count_if((F.col("kind_v") != "blank") & (F.coalesce("str", F.lit("x")) != "")),
        "every": F.bool_and(truth), "some": F.bool_or(truth), "first_error": F.min(F.when(F.col("kind_v") == "err", F.struct("row", "col", "err"))), "problem": F.max("problem"),
    }
    how = {"n": F.sum, "total": F.sum, "product": F.product, "low": F.min, "high": F.max, "filled": F.sum, "every": F.bool_and, "some": F.bool_or, "first_error": F.min, "problem": F.max}
    return running, {name: merge(name) for name, merge in how.items()}


def gathered(areas: DataFrame, cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """(id, held): what each formula's areas hold, a struct for each area, whatever its size.

    Single cells are met by their place, ranges by look-ups of running
    aggregates (``ranges``), and those that stand side by side by tiles.
    """
    one = areas.filter("kind = 'cell'").select("id", "need", "book", "sheet", F.col("r0").alias("row"), F.col("c0").alias("col")).join(cells, list(PLACE))
    one = one.select("id", "need", F.col("kind_v").alias("kind"), *VALUE_FIELDS[1:], "problem")
    wide = ranges.over_ranges(areas.filter("kind = 'range'"), cells, sheets, *range_aggregates()).withColumn("error", F.col("first_error.err"))
    is_num = F.col("kind_v") == "num"
    met = within(tiles(areas.filter("kind = 'zip'"), sheets), cells)
    sides = met.withColumns({"r": F.col("row") - F.col("r0"), "c": F.col("col") - F.col("c0")})
    items = sides.groupBy("id", "need", "parts", "r", "c").agg(F.product(F.when(is_num, F.col("num")).otherwise(0.0)).alias("x"), F.count("*").alias("k"), F.max("err").alias("error"), F.max("problem").alias("problem"))
    zipped = items.groupBy("id", "need").agg(F.sum(F.when(F.col("k") == F.col("parts"), F.col("x")).otherwise(0.0)).alias("total"), F.max("error").alias("error"), F.max("problem").alias("problem"))
    both = one.unionByName(wide, allowMissingColumns=True).unionByName(zipped, allowMissingColumns=True)
    return both.groupBy("id").agg(F.collect_list(F.struct(*[c for c in both.columns if c != "id"])).alias("held"))


RESULT = ["id", *PLACE, *VALUE_FIELDS, "problem"]
RESULT_KINDS = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.bool_(), pa.string(), pa.string()]
RESULT_SCHEMA = "id long, book string, sheet string, row int, col int, kind string, num double, str string, bool boolean, err string, problem string"


def value_of(text: str, sheet: str, held: dict[int, dict]) -> tuple:
    """(kind, num, str, bool, err, problem) of a formula, given what its areas hold."""
    blocked = next((h["problem"] for h in held.values() if h["problem"]), None)
    if blocked:
        return (None,) * 5 + (blocked if blocked.startswith("reads ") else f"reads a cell that fails: {blocked}",)
    try:
        v = Evaluation(held).value(read(text, sheet).tree)
    except UnsupportedFormula as error:
        return (None,) * 5 + (str(error),)
    kind = "blank" if v is None else "err" if isinstance(v, Err) else "bool" if isinstance(v, bool) else "num" if isinstance(v, float) else "str"
    return (kind, *(v if kind == k else None for k in ("num", "str", "bool", "err")), None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RESULT_KINDS, strict=True)], names=RESULT)


def evaluated(ready: DataFrame) -> DataFrame:
    """``ready`` (id, place, formula, held) as values (id, place, kind ..., problem)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*(r[c] for c in ("id", *PLACE)), *value_of(r["formula"], r["sheet"], {h["need"]: h for h in r["held"] or ()})) for r in batch.to_pylist()]
            if rows:
                yield _batch(rows)

    return ready.select("id", *PLACE, "formula", "held").mapInArrow(run, RESULT_SCHEMA)


class TooLarge(Exception):
    """More than a task should take on."""


def by_columns(places) -> dict[tuple, tuple[list[int], list]]:
    """(sheet, column): its rows in order and what stands there, of (sheet, row, column, what)."""
    columns: dict[tuple, list[tuple]] = {}
    for sheet, row, col, what in places:
        columns.setdefault((sheet, col), []).append((row, what))
    for own in columns.values():
        own.sort(key=itemgetter(0))
    return {c: ([r for r, _ in own], [x for _, x in own]) for c, own in columns.items()}


def stretches(columns: dict[tuple, tuple], sheet: str, r0: int, c0: int, r1: int, c1: int) -> Iterator[tuple[tuple, int, int]]:
    """(column, from, to): the part of each of ``columns`` that lies in an area."""
    wanted = ((sheet, c) for c in range(c0, c1 + 1)) if c1 - c0 < len(columns) else (c for c in columns if c[0] == sheet and c0 <= c[1] <= c1)
    for key in wanted:
        if key in columns:
            rows = columns[key][0]
            first, last = bisect_left(rows, r0), bisect_right(rows, r1)
            if first < last:
                yield key, first, last


class Together:
    """Formulas that hang together, computed in their order: those that an edit reaches, each once all that it reads are known.

    A member has id, place, formula, seed (reads an edited cell), the value
    stored, and held, what its areas hold besides other members.
    """

    def __init__(self, members: list[dict], most_reads: float = math.inf):
        self.members = members
        self.columns = by_columns((m["sheet"], m["row"], m["col"], k) for k, m in enumerate(members))
        self.areas, self.reads = [], []
        for m in members:
            self.areas.append([(*a, self.inside(*a[4:])) for a in read(m["formula"], m["sheet"]).areas])
            self.reads.append(sorted({k for a in self.areas[-1] for k in a[-1]}))
            most_reads -= len(self.reads[-1])
            if most_reads < 0:
                raise TooLarge
        self.values = [tuple(m[c] for c in (*VALUE_FIELDS, "problem")) for m in members]

    def inside(self, *area) -> list[int]:
        """The members in an area."""
        return [k for key, first, last in stretches(self.columns, *area) for k in self.columns[key][1][first:last]]

    def plain(self, k: int) -> dict[int, dict]:
        """What the areas of a member hold besides members."""
        return {h["need"]: dict(h) for h in self.members[k]["held"] or ()}

    def held(self, k: int) -> dict[int, dict]:
        out = self.plain(k)
        for need, _, _, kind, *_, inside in self.areas[k]:
            for m in inside:
                v = dict(zip((*VALUE_FIELDS, "problem"), self.values[m], strict=True))
                if kind == "cell":
                    out[need] = v
                    continue
                own = out.setdefault(need, {"n": 0, "total": None, "product": None, "low": None, "high": None, "filled": 0, "every": None, "some": None, "first_error": None, "error": None, "problem": None})
                own["problem"] = own["problem"] or v["problem"]
                if v["kind"] == "err":
                    at = {"row": self.members[m]["row"], "col": self.members[m]["col"], "err": v["err"]}
                    if own["first_error"] is None or (at["row"], at["col"]) < (own["first_error"]["row"], own["first_error"]["col"]):
                        own["first_error"], own["error"] = at, v["err"]
                own["filled"] += v["kind"] not in (None, "blank") and v["str"] != ""
                truth = v["bool"] if v["kind"] == "bool" else v["num"] != 0 if v["kind"] == "num" else None
                if truth is not None:
                    own["every"], own["some"] = truth and own["every"] is not False, truth or bool(own["some"])
                if v["kind"] == "num":
                    x = v["num"]
                    first = not own["n"]
                    own["n"] += 1
                    own["total"], own["product"] = (x, x) if first else (own["total"] + x, own["product"] * x)
                    own["low"], own["high"] = (x, x) if first else (min(own["low"], x), max(own["high"], x))
        return out

    def names(self, group: list[int]) -> str:
        """The members of a group by place, with their sheets where they are on several."""
        own = sorted((self.members[k]["sheet"], self.members[k]["row"], self.members[k]["col"]) for k in group)
        several = own[0][0] != own[-1][0]
        return ", ".join(f"{sheet}!" * several + f"{letters(col)}{row + 1}" for sheet, row, col in own)

    def results(self) -> list[tuple]:
        readers: list[list[int]] = [[] for _ in self.members]
        for k, own in enumerate(self.reads):
            for m in own:
                readers[m].append(k)
        todo = [k for k, m in enumerate(self.members) if m["seed"]]
        reached = set(todo)
        while todo:
            for k in readers[todo.pop()]:
                if k not in reached:
                    reached.add(k)
                    todo.append(k)
        waits = {k: sum(m in reached for m in self.reads[k]) for k in reached}
        todo = [k for k in reached if not waits[k]]
        while todo:
            k = todo.pop()
            self.values[k] = value_of(self.members[k]["formula"], self.members[k]["sheet"], self.held(k))
            del waits[k]
            for m in readers[k]:
                if m in waits:
                    waits[m] -= 1
                    if not waits[m]:
                        todo.append(m)
        circle = {k: "reads a cycle" for k in waits}
        for group in cycles(waits, self.reads):
            circle.update(dict.fromkeys(group, f"part of a cycle: {self.names(group)}"))
        for k, text in circle.items():
            self.values[k] = (None,) * 5 + (text,)
        return [(*(self.members[k].get(c) for c in ("id", *PLACE)), *self.values[k]) for k in sorted(reached)]


def cycles(nodes, reads: list[list[int]]) -> list[list[int]]:
    """The sets of ``nodes`` that read each other in a circle (strongly connected, or reading themselves)."""
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    stack: list[int] = []
    open_: set[int] = set()
    found = []
    for root in nodes:
        if root in index:
            continue
        path = [(root, iter(reads[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        open_.add(root)
        while path:
            k, rest = path[-1]
            for m in rest:
                if m not in nodes:
                    continue
                if m not in index:
                    index[m] = low[m] = len(index)
                    stack.append(m)
                    open_.add(m)
                    path.append((m, iter(reads[m])))
                    break
                if m in open_:
                    low[k] = min(low[k], index[m])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[k])
                if low[k] == index[k]:
                    group = []
                    while not group or group[-1] != k:
                        group.append(stack.pop())
                    open_.difference_update(group)
                    if len(group) > 1 or k in reads[k]:
                        found.append(group)
    return found


def letters(col: int) -> str:
    out, col = "", col + 1
    while col:
        col, k = divmod(col - 1, 26)
        out = chr(65 + k) + out
    return out


def computed_together(members: DataFrame) -> DataFrame:
    """``members`` (component, id, place, formula, seed, value, problem, held) as the values of those that an edit reaches."""
    dealt = members.repartition("component").sortWithinPartitions("component", "id")

    def run(batches) -> Iterator[pa.RecordBatch]:
        own: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if own and own[-1]["component"] != row["component"]:
                    if rows := Together(own).results():
                        yield _batch(rows)
                    own = []
                own.append(row)
        if own and (rows := Together(own).results()):
            yield _batch(rows)

    return dealt.mapInArrow(run, RESULT_SCHEMA)


class PlainColumn:
    """The values of a column's plain cells in the order of their rows, for aggregates over stretches of them."""

    def __init__(self, values: list[tuple]):
        counts = lambda which: [0, *accumulate(which)]
        self.values, self.errors = values, [k for k, v in enumerate(values) if v[0] == "err"]
        truths = [v[3] if v[0] == "bool" else None if v[1] is None or v[0] != "num" else v[1] != 0 for v in values]
        self.n = counts(v[0] == "num" and v[1] is not None for v in values)
        self.filled = counts(v[0] not in (None, "blank") and v[2] != "" for v in values)
        self.told = counts(t is not None for t in truths)
        self.numbers = np.array([v[1] for v in values if v[0] == "num" and v[1] is not None], np.float64)
        self.truths = np.array([t for t in truths if t is not None], bool)


class Stretches(dict):
    """What a range holds of plain cells, each aggregate found when it is first asked for."""

    def __init__(self, parts: list[tuple[int, list[int], PlainColumn, int, int]]):
        super().__init__(problem=None)
        self.parts = parts

    def __missing__(self, name: str):
        self[name] = found = self.find(name)
        return found

    def find(self, name: str):
        if name in ("n", "filled"):
            return sum(getattr(c, name)[last] - getattr(c, name)[first] for _, _, c, first, last in self.parts)
        if name == "error":
            return self["first_error"] and self["first_error"]["err"]
        if name == "first_error":
            at = [(rows[c.errors[k]], col, c.values[c.errors[k]][4]) for col, rows, c, first, last in self.parts if (k := bisect_left(c.errors, first)) < len(c.errors) and c.errors[k] < last]
            return dict(zip(("row", "col", "err"), min(at), strict=True)) if at else None
        if name in ("every", "some"):
            own = [c.truths[c.told[first] : c.told[last]] for _, _, c, first, last in self.parts]
            one = np.all if name == "every" else np.any
            return bool(one([one(x) for x in own if len(x)])) if any(map(len, own)) else None
        over = {"total": np.add, "product": np.multiply, "low": np.minimum, "high": np.maximum}[name]
        own = [over.reduce(x) for _, _, c, first, last in self.parts if len(x := c.numbers[c.n[first] : c.n[last]])]
        return float(over.reduce(own)) if own else None


class Book(Together):
    """A whole workbook: of its plain cells is looked up only what the formulas that an edit reaches ask for.

    ``rows`` are (book, place, value, formula, edit), those with edit being the edited ones.
    """

    def __init__(self, rows: list[tuple], most_formulas: int, most_reads: int):
        edited = {row[1:4]: row[4:9] for row in rows if row[10]}
        plain, members, self.unreadable = dict(edited), [], []
        for row in rows:
            at = row[1:4]
            if row[10] or at in edited:
                continue
            if row[9] is not None:
                try:
                    read(row[9], row[1])
                    members.append(dict(zip(("sheet", "row", "col", *VALUE_FIELDS, "formula"), row[1:10], strict=True), problem=None))
                    continue
                except UnsupportedFormula as error:
                    self.unreadable.append((*at, str(error)))
            plain[at] = row[4:9]
        if len(members) > most_formulas:
            raise TooLarge
        super().__init__(members if edited else [], most_reads)
        changed = by_columns((*at, None) for at in edited)
        for m, own in zip(self.members, self.areas, strict=True):
            m["seed"] = any(a[3] == "cell" and (a[4], a[5], a[6]) in edited or a[3] != "cell" and any(stretches(changed, *a[4:9])) for a in own)
        if any(a[3] == "zip" and a[-1] for own in self.areas for a in own):
            raise TooLarge
        self.by_place, self.by_column, self.known = plain, None, {}

    def part(self, key: tuple, first: int, last: int) -> tuple:
        rows, values = self.by_column[key]
        if key not in self.known:
            self.known[key] = PlainColumn(values)
        return key[1], rows, self.known[key], first, last

    def plain(self, k: int) -> dict[int, dict]:
        out, zips = {}, {}
        for need, _, parts, kind, sheet, r0, c0, r1, c1, _ in self.areas[k]:
            if kind == "cell":
                if v := self.by_place.get((sheet, r0, c0)):
                    out[need] = dict(zip(VALUE_FIELDS, v, strict=True), problem=None)
                continue
            if self.by_column is None:
                self.by_column = by_columns((*at, v) for at, v in self.by_place.items())
            found = list(stretches(self.by_column, sheet, r0, c0, r1, c1))
            if kind == "range" and found:
                out[need] = Stretches([self.part(*x) for x in found])
            elif kind == "zip":
                sides = zips.setdefault(need, (parts, {}))[1]
                for key, first, last in found:
                    for row, v in zip(*(x[first:last] for x in self.by_column[key]), strict=True):
                        sides.setdefault((row - r0, key[1] - c0), []).append(v)
        for need, (parts, sides) in zips.items():
            products = (math.prod(v[1] if v[0] == "num" and v[1] is not None else 0.0 for v in own) for own in sides.values() if len(own) == parts)
            out[need] = {"total": math.fsum(products), "error": max((v[4] for own in sides.values() for v in own if v[4]), default=None), "problem": None}
        return out


FOUND = "book string, sheet string, row int, col int, before struct<kind string, num double, str string, bool boolean, err string>, after struct<kind string, num double, str string, bool boolean, err string>, problem string, large boolean"


CHUNK, CHUNK_BYTES = 200_000, 64 << 20


def chunks(batches) -> Iterator[pa.RecordBatch]:
    """Batches of about ``CHUNK`` rows, fewer if these are long, that hold whole workbooks, of such in which the rows of each follow each other."""
    kept, n, size = [], 0, 0
    for batch in batches:
        kept.append(batch)
        n, size = n + batch.num_rows, size + batch.nbytes
        if n < CHUNK and size < CHUNK_BYTES:
            continue
        whole = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
        book = whole.column("book").dictionary_encode(null_encoding="encode").indices.to_numpy()
        end = int(np.searchsorted(book, book[-1]))
        if end:
            yield whole.slice(0, end)
        kept, n, size = [whole.slice(end)], whole.num_rows - end, 0
    if n:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


def computed_by_book(rows: DataFrame, n_rows: int, empty: list[str], most_formulas: int, most_reads: int) -> DataFrame:
    """Changes and problems of workbooks of moderate size, each computed in one task; one that proves too large gives a row that says so.

    Formulas that are built alike are computed together over many workbooks
    (``alike``), those of workbooks that this leaves apart one by one.  Columns
    that are ``empty`` in all rows are not passed on.
    """
    value = pa.struct([("kind", pa.string()), ("num", pa.float64()), ("str", pa.string()), ("bool", pa.bool_()), ("err", pa.string())])
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), value, value, pa.string(), pa.bool_()]
    names = ["book", "sheet", "row", "col", "before", "after", "problem", "large"]
    columns = [*PLACE, *VALUE_FIELDS, "formula", "edit"]

    def of(name: str, own: list[tuple]) -> Iterator[tuple]:
        try:
            book = Book(own, most_formulas, most_reads)
        except TooLarge:
            yield name, None, None, None, None, None, None, True
            return
        stored = list(book.values)
        at = {(m["sheet"], m["row"], m["col"]): k for k, m in enumerate(book.members)}
        fields = lambda v: dict(zip(VALUE_FIELDS, v, strict=False))
        for _, _, *place, kind, num, text, truth, err, problem in book.results():
            before, after = stored[at[tuple(place)]][:5], (kind, num, text, truth, err)
            if problem is not None or before != after:
                yield name, *place, fields(before), None if problem is not None else fields(after), problem, False
        for *place, problem in book.unreadable:
            yield name, *place, None, None, problem, False

    def one_by_one(apart: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        make = lambda: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=names)
        pieces = (apart.slice(k, 500) for k in range(0, apart.num_rows, 500))
        for name, own in groupby(chain.from_iterable(zip(*(c.to_pylist() for c in piece.columns), strict=True) for piece in pieces), itemgetter(0)):
            found += of(name, list(own))
            if len(found) > 2000:
                yield make()
                found = []
        if found:
            yield make()

    def run(batches) -> Iterator[pa.RecordBatch]:
        from tessera.operators import alike  # it reads formulas by this module

        with np.errstate(all="ignore"):
            for whole in chunks(batches):
                none = {c: pa.nulls(whole.num_rows, pa.bool_() if c == "bool" else pa.string()) for c in empty}
                whole = pa.record_batch([none[c] if c in none else whole.column(c) for c in columns], names=columns)
                chunk = alike.Chunk(whole)
                found = chunk.computed()
                if found is not None and found.num_rows:
                    n = found.num_rows
                    yield pa.record_batch([*found.columns, pa.nulls(n, pa.string()), pa.repeat(False, n)], names=names)
                if chunk.apart.any():
                    yield from one_by_one(whole.filter(pa.array(chunk.apart[chunk.book])))

    # a number of partitions keeps Spark from putting many small ones together, for the work is in Python
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_rows / 500_000))
    dealt = rows.select(*[c for c in columns if c not in empty]).repartition(tasks, "book").sortWithinPartitions("book")
    return dealt.mapInArrow(run, FOUND)


def address(row, col):
    return F.concat(column_letters(col), (row + 1).cast("string"))


def in_rounds(ws: Scratch, formulas: DataFrame, areas: DataFrame, seeds: DataFrame, now: DataFrame, sheets: DataFrame, most_rounds: int) -> tuple[DataFrame, DataFrame]:
    """(values, pending) of ``formulas`` that an edit reaches, each round computing those whose areas hold none that is still to come."""
    dirty = new = seeds
    for k in range(1, most_rounds + 1):
        new = ws.write(ranges.holding(areas, formulas.join(new, "id", "left_semi"), sheets).join(dirty, "id", "left_anti"), f"dirty{k}")
        if new.isEmpty():
            break
        dirty = dirty.union(new)
    else:
        raise RuntimeError(f"chains of over {most_rounds} formulas in a component that is too large for a task")
    pending = ws.write(formulas.join(dirty, "id", "left_semi").select("id", *PLACE, "formula"), "pending0")
    still = now.select(*PLACE, *VALUE_FIELDS).join(pending.select(*PLACE), list(PLACE), "left_anti").withColumn("problem", F.lit(None).cast("string"))
    still = ws.write(still, "still")
    values = (*PLACE, *VALUE_FIELDS, "problem")
    done = ws.write(evaluated(pending.limit(0).withColumn("held", F.lit(None).cast("array<struct<need int, problem string>>"))), "done", append=True)
    for k in range(1, most_rounds + 1):
        own = areas.join(pending, "id", "left_semi")
        ready = ws.write(pending.join(ranges.holding(own, pending, sheets), "id", "left_anti"), f"ready{k}")
        if ready.isEmpty():
            break
        cells_now = still.select(*values).unionByName(done.select(*values)).withColumnRenamed("kind", "kind_v")
        held = gathered(areas.join(ready, "id", "left_semi"), cells_now, sheets)
        done = ws.write(evaluated(ready.join(held, "id", "left")), "done", append=True)
        pending = ws.write(pending.join(ready.select("id"), "id", "left_anti"), f"pending{k}")
    else:
        raise RuntimeError(f"chains of over {most_rounds} formulas in a component that is too large for a task")
    return done, pending


def recalculate(cells: DataFrame, edits: DataFrame | None = None, together: int = 200_000, most_reads: int = 20_000_000, most_rounds: int = 500, most_cells: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(changes, problems) after ``edits`` (place and value) to ``cells`` (place, value, formula).

    Without ``edits`` these are the rows of ``cells`` whose column edit is true.

    A workbook of at most ``most_cells`` cells is computed in one task, after
    one shuffle of the cells by workbook: formulas that are built alike
    together, by arrays over many workbooks, and where those do not hold, one
    by one, up to ``together`` formulas and ``most_reads`` places where they
    read each other.  Others, and those in which SUMPRODUCT reads formulas, are
    spread over tasks as follows.

    Formulas hang together where one holds another in its areas; which do is
    found by joins, in rounds that grow with the logarithm of the longest chain.
    What areas hold of plain cells is looked up for all formulas at once
    (``ranges``), so running totals over long columns cost two look-ups each.
    A component of at most ``together`` formulas that read each other
    ``most_reads`` times at most is then computed in one task, in the order of
    its formulas, however long its chains are.  Larger ones, and those in which
    SUMPRODUCT reads formulas, are computed in rounds over all of them; there a
    chain of over ``most_rounds`` raises.

    changes: place, address, before, after (structs), of formulas whose value is
    another now; problems: place, address, problem, of formulas that cannot be
    read or computed, of those in a cycle (with its members, where one task saw
    it) and of those that read such cells, whose stored values stay.  An edit of
    a cell with a formula replaces it.  Order both by place.
    """
    ws = Scratch(cells.sparkSession, "workbook")
    columns = (*PLACE, *VALUE_FIELDS)
    if edits is None:
        rows = cells.select(*columns, "formula", "edit")
    else:
        rows = cells.select(*columns, "formula", F.lit(False).alias("edit")).unionByName(edits.select(*columns, F.lit(None).cast("string").alias("formula"), F.lit(True).alias("edit")))
    rows = ws.write(rows, "rows", part=16 << 20)
    # a workbook is large only where its part of 65,536 is, so workbooks are counted only in such parts
    part = F.pmod(F.xxhash64("book"), F.lit(1 << 16)).alias("part")
    longest = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("str", "formula")), F.lit(200))
    seldom = ("str", "bool", "err")
    parts = rows.groupBy(part).agg(F.count("*").alias("n"), F.max(longest).alias("longest"), *[F.count(c).alias(c) for c in seldom])
    n_rows, fullest, longest, *filled = (x or 0 for x in parts.agg(F.sum("n"), F.max("n"), F.max("longest"), *[F.max(c) for c in seldom]).first())
    empty = [c for c, n in zip(seldom, filled, strict=True) if not n]
    large, moderate = rows.select("book").limit(0), rows
    if fullest > most_cells:
        among = rows.select("book").join(F.broadcast(parts.filter(F.col("n") > most_cells).select("part")), F.pmod(F.xxhash64("book"), F.lit(1 << 16)) == F.col("part"), "left_semi")
        large = ws.write(among.groupBy("book").agg(F.count("*").alias("n")).filter(F.col("n") > most_cells).select("book"), "large")
        moderate = rows if large.isEmpty() else rows.join(large, "book", "left_anti")
    with batches_of(ws.spark, longest):
        found = ws.write(computed_by_book(moderate, n_rows, empty, together, most_reads), "books")
    shown = address(F.col("row"), F.col("col")).alias("address")
    changes = found.filter("NOT large AND problem IS NULL").select(*PLACE, shown, "before", "after")
    problems = found.filter("problem IS NOT NULL").select(*PLACE, shown, "problem")
    large = large.union(found.filter("large").select("book"))
    if large.isEmpty():
        return changes, problems
    large = ws.write(large, "spread")
    own = rows.join(large, "book", "left_semi")
    more, failed = recalculated_apart(ws, own.filter("NOT edit").drop("edit"), own.filter("edit").drop("edit", "formula"), together, most_reads, most_rounds)
    return changes.unionByName(more), problems.unionByName(failed)


def recalculated_apart(ws: Scratch, cells: DataFrame, edits: DataFrame, together: int, most_reads: int, most_rounds: int) -> tuple[DataFrame, DataFrame]:
    """The same for workbooks of any size, whose formulas are looked up and ordered by joins."""
    own = ws.write(edits.select(*PLACE, *VALUE_FIELDS), "edits")
    kept = cells.join(own.select(*PLACE), list(PLACE), "left_anti").select(*PLACE, *VALUE_FIELDS, "formula")
    now = ws.write(kept.unionByName(own, allowMissingColumns=True), "cells")
    formulas = ws.write(with_areas(now.filter("formula IS NOT NULL")).withColumn("id", F.monotonically_increasing_id()), "formulas")
    sheets = ws.write(now.groupBy("book", "sheet").agg(F.max("row").alias("rows"), F.max("col").alias("cols")), "sheets")
    areas = ws.write(formulas.select("id", "book", F.inline("areas")), "areas")
    readable = formulas.filter("unreadable IS NULL").drop("areas", "unreadable")
    seeds = ws.write(ranges.holding(areas, own, sheets), "seeds")
    edges, counts = ranges.links(areas, readable.select("id", *PLACE), sheets)
    parts = ranges.components(ws, ws.write(edges, "edges")).withColumnRenamed("node", "id")
    placed = readable.select("id").join(parts, "id", "left").join(counts, "id", "left").join(seeds.withColumn("seed", F.lit(True)), "id", "left")
    placed = ws.write(placed.select("id", F.coalesce("component", "id").alias("component"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("side_by_side", F.lit(False)).alias("side_by_side"), F.coalesce("seed", F.lit(False)).alias("seed")), "placed")
    sizes = placed.groupBy("component").agg(F.bool_or("seed").alias("live"), ((F.count("*") <= together) & (F.sum("n") <= most_reads) & ~F.bool_or("side_by_side")).alias("in_task"))
    live = ws.write(placed.select("id", "component", "seed").join(sizes.filter("live").select("component", "in_task"), "component"), "live")

    some = live.filter("in_task").select("id", "component", "seed")
    plain = now.filter("formula IS NULL").unionByName(now.join(formulas.filter("unreadable IS NOT NULL"), list(PLACE), "left_semi")).select(*PLACE, F.col("kind").alias("kind_v"), *VALUE_FIELDS[1:]).withColumn("problem", F.lit(None).cast("string"))
    held = gathered(areas.join(some, "id", "left_semi"), plain, sheets)
    members = readable.join(some, "id").withColumn("problem", F.lit(None).cast("string")).join(held, "id", "left")
    done = ws.write(computed_together(members), "together")
    rest = live.filter("NOT in_task")
    circles = done.limit(0).select(*PLACE)
    if not rest.isEmpty():
        rest = ws.write(rest, "rest")
        more, pending = in_rounds(ws, readable.join(rest, "id", "left_semi"), areas.join(rest, "id", "left_semi"), ws.write(rest.filter("seed").select("id"), "dirty0"), now, sheets, most_rounds)
        done, circles = done.unionByName(more), pending.select(*PLACE)

    value = lambda df, name: df.select(*PLACE, F.struct(*VALUE_FIELDS).alias(name))
    after = value(done.filter("problem IS NULL"), "after")
    changes = after.join(value(cells, "before"), list(PLACE)).filter(~F.col("before").eqNullSafe(F.col("after")))
    failed = done.filter("problem IS NOT NULL").select(*PLACE, "problem")
    failed = failed.union(circles.select(*PLACE, F.lit("part of a cycle, or reads one").alias("problem"))).union(formulas.filter("unreadable IS NOT NULL").select(*PLACE, F.col("unreadable")))
    shown = address(F.col("row"), F.col("col")).alias("address")
    return changes.select(*PLACE, shown, "before", "after"), failed.select(*PLACE, shown, "problem")
