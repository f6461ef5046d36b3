"""Spreadsheet formulas over DataFrame columns, translated to Column expressions.

A formula names columns; the whole expression runs in the JVM.  Errors are
values: next to a value of null stands a code such as ``#DIV/0!``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIV, VALUE, NUM = "#DIV/0!", "#VALUE!", "#NUM!"
TOKEN = re.compile(
    r"""\s*(?:(?P<num>(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)|(?P<str>"(?:[^"]|"")*")|(?P<err>\#(?:DIV/0!|VALUE!|NUM!|REF!|NAME\?|N/A|NULL!))
    |(?P<col>\[[^\]]+\])|(?P<name>(?:_xlfn\.)?[^\W\d][\w.]*)|(?P<op><=|>=|<>|[-+*/^&=<>%(),;]))""",
    re.VERBOSE,
)


class UnsupportedFormula(ValueError):
    """The formula uses something this library does not have."""


@dataclass(frozen=True)
class Cell:
    """A value of a known kind (num, text, bool or blank) and the error that takes its place."""

    kind: str
    value: Column
    err: Column




def _none() -> Column:
    return F.lit(None).cast("string")


def fifteen(x: Column) -> Column:
    """A double rounded to 15 significant digits, as spreadsheets hold numbers."""
    return F.format_string("%.14e", x).cast("double")


POWERS = 10.0 ** np.arange(23)  # all of them exact as doubles


def snapped(x: Column) -> Column:
    """``fifteen`` by arithmetic, for rounding: scaled to 15 digits, rounded there and scaled back by an exact power of ten.

    A last digit that is a tie may go the other way, which no rounding to fewer
    digits sees.
    """
    k = (14 - F.floor(F.log10(F.abs(x)))).cast("int")
    p = F.get(F.lit(POWERS), F.abs(k))
    scaled = F.when(k >= 0, F.rint(x * p) / p).otherwise(F.rint(x / p) * p)
    return F.when(x == 0, x).when(F.abs(k) < len(POWERS), scaled).otherwise(fifteen(x))


def number(c: Cell) -> Cell:
    """Coerced to a number: blank 0, booleans 1 and 0, text without its commas or #VALUE!."""
    if c.kind == "num":
        return Cell("num", F.coalesce(c.value, F.lit(0.0)), c.err)
    if c.kind == "bool":
        return Cell("num", F.coalesce(c.value.cast("double"), F.lit(0.0)), c.err)
    if c.kind == "blank":
        return Cell("num", F.lit(0.0), c.err)
    bare = F.trim(F.replace(c.value, F.lit(","), F.lit("")))
    parsed = F.when(bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), bare.try_cast("double"))
    value = F.when(c.value.isNull(), F.lit(0.0)).otherwise(parsed)
    return Cell("num", value, F.coalesce(c.err, F.when(value.isNull(), F.lit(VALUE))))


def text(c: Cell) -> Cell:
    """Coerced to text: whole numbers without a point, booleans in capitals, blank empty."""
    if c.kind == "num":
        n = fifteen(c.value)
        whole = n == F.floor(n)
        plain = F.when(whole & (F.abs(n) < 1e15), F.format_string("%d", n.cast("long"))).otherwise(n.cast("string"))
        return Cell("text", F.coalesce(plain, F.lit("")), c.err)
    if c.kind == "bool":
        return Cell("text", F.coalesce(F.upper(c.value.cast("string")), F.lit("")), c.err)
    return Cell("text", F.coalesce(c.value.cast("string"), F.lit("")), c.err)


def boolean(c: Cell) -> Cell:
    if c.kind == "bool":
        return Cell("bool", F.coalesce(c.value, F.lit(False)), c.err)
    if c.kind == "text":
        low = F.lower(c.value)
        value = F.when(low == "true", F.lit(True)).when(low.isin("false", "") | c.value.isNull(), F.lit(False))
        return Cell("bool", value, F.coalesce(c.err, F.when(value.isNull(), F.lit(VALUE))))
    return Cell("bool", number(c).value != 0, c.err)


def _round(x: Column, digits: Column, mode: str) -> Column:
    """Half away from zero, up or down in magnitude, on 15 significant digits."""
    scale = F.pow(F.lit(10.0), F.floor(digits))
    m = snapped(F.abs(x) * scale)
    whole = {"half": F.floor(m + 0.5), "up": F.ceil(m), "down": F.floor(m)}[mode]
    return F.signum(x) * whole / scale


def hangul_digits(n: Column, form: int) -> Column:
    """NUMBERSTRING: 1 Hangul units, 2 Hanja units, 3 digit by digit, of a non-negative whole number below 10^16."""
    from tessera.functions import money

    whole = n.cast("decimal(38,0)")
    if form == 3:
        return F.translate(whole.cast("string"), "0123456789", money.HANGUL)
    return money.spell(whole, hanja=form == 2, sheet=True)


def combine(*errs: Column) -> Column:
    return F.coalesce(*errs)


class Translator:
    def __init__(self, formula: str, columns: dict[str, T.DataType]):
        body = formula[1:] if formula.startswith("=") else formula
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while body[at:].strip():
            m = TOKEN.match(body, at)
            if not m:
                raise UnsupportedFormula(f"cannot read {body[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at, self.columns = 0, columns

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *values: str) -> str | None:
        kind, value = self.peek()
        if kind == "op" and value in values:
            self.at += 1
            return value
        return None

    def run(self) -> Cell:
        out = self.comparison()
        if self.peek()[0] != "end":
            raise UnsupportedFormula(f"unexpected {self.peek()[1]!r}")
        return out

    def comparison(self) -> Cell:
        left = self.joined()
        while op := self.take("=", "<>", "<", "<=", ">", ">="):
            left = self.compare(left, op, self.joined())
        return left

    def compare(self, a: Cell, op: str, b: Cell) -> Cell:
        """Numbers before text before booleans; text without regard to case; blank is the other side's empty value."""
        rank = {"num": 1, "text": 2, "bool": 3}
        if a.kind == "blank":
            a = {"num": number, "text": text, "bool": boolean, "blank": number}[b.kind](a)
        if b.kind == "blank":
            b = {"num": number, "text": text, "bool": boolean}[a.kind](b)
        if a.kind != b.kind:
            x, y = F.lit(rank[a.kind]), F.lit(rank[b.kind])
        elif a.kind == "text":
            x, y = F.lower(text(a).value), F.lower(text(b).value)
        else:
            same = number if a.kind == "num" else boolean
            x, y = same(a).value, same(b).value
        value = {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        return Cell("bool", value, combine(a.err, b.err))

    def joined(self) -> Cell:
        left = self.sum()
        while self.take("&"):
            a, b = text(left), text(self.sum())
            left = Cell("text", F.concat(a.value, b.value), combine(a.err, b.err))
        return left

    def sum(self) -> Cell:
        left = self.product()
        while op := self.take("+", "-"):
            a, b = number(left), number(self.product())
            left = Cell("num", a.value + b.value if op == "+" else a.value - b.value, combine(a.err, b.err))
        return left

    def product(self) -> Cell:
        left = self.power()
        while op := self.take("*", "/"):
            a, b = number(left), number(self.power())
            if op == "*":
                left = Cell("num", a.value * b.value, combine(a.err, b.err))
            else:
                left = Cell("num", F.try_divide(a.value, b.value), combine(a.err, b.err, F.when(b.value == 0, F.lit(DIV))))
        return left

    def power(self) -> Cell:
        left = self.signed()
        while self.take("^"):
            a, b = number(left), number(self.signed())
            raised = F.pow(a.value, b.value)
            bad = F.isnan(raised) | (F.abs(raised) == float("inf"))
            left = Cell("num", F.when(~bad, raised), combine(a.err, b.err, F.when(bad, F.lit(NUM))))
        return left

    def signed(self) -> Cell:
        if op := self.take("+", "-"):
            a = number(self.signed())
            return Cell("num", -a.value if op == "-" else a.value, a.err)
        out = self.primary()
        while self.take("%"):
            a = number(out)
            out = Cell("num", a.value / 100, a.err)
        return out

    def primary(self) -> Cell:
        kind, value = self.peek()
        self.at += 1
        if kind == "num":
            return Cell("num", F.lit(float(value)), _none())
        if kind == "str":
            return Cell("text", F.lit(value[1:-1].replace('""', '"')), _none())
        if kind == "err":
            return Cell("num", F.lit(None).cast("double"), F.lit(value))
        if kind == "col":
            return self.column(value[1:-1])
        if kind == "name":
            if self.take("("):
                return self.call(value.upper().removeprefix("_XLFN."), self.arguments())
            if value.upper() in ("TRUE", "FALSE"):
                return Cell("bool", F.lit(value.upper() == "TRUE"), _none())
            return self.column(value)
        if (kind, value) == ("op", "("):
            out = self.comparison()
            if not self.take(")"):
                raise UnsupportedFormula("a bracket is not closed")
            return out
        raise UnsupportedFormula(f"unexpected {value or 'end'!r}")

    def arguments(self) -> list[Cell]:
        out = []
        if self.take(")"):
            return out
        while True:
            empty = self.peek() in (("op", ","), ("op", ";"), ("op", ")"))
            out.append(Cell("blank", F.lit(None).cast("double"), _none()) if empty else self.comparison())
            if self.take(")"):
                return out
            if not self.take(",", ";"):
                raise UnsupportedFormula("a comma or bracket is missing")

    def column(self, name: str) -> Cell:
        if name not in self.columns:
            raise UnsupportedFormula(f"no column {name!r}")
        kind, c = self.columns[name], F.col(f"`{name}`")
        if isinstance(kind, T.NumericType):
            return Cell("num", c.cast("double"), _none())
        return Cell("bool" if isinstance(kind, T.BooleanType) else "text", c if isinstance(kind, T.BooleanType) else c.cast("string"), _none())

    def call(self, name: str, args: list[Cell]) -> Cell:
        errs = combine(_none(), *[a.err for a in args])
        nums = [number(a) for a in args] if name not in ("COUNT", "COUNTA", "IF", "IFERROR", "CONCAT", "CONCATENATE") else []
        errs_num = combine(_none(), *[a.err for a in nums])
        if name in ("SUM", "PRODUCT", "MIN", "MAX", "AVERAGE", "SUMPRODUCT") and args:
            v = [a.value for a in nums]
            if name == "SUM":
                return Cell("num", reduce(lambda a, b: a + b, v), errs_num)
            if name in ("PRODUCT", "SUMPRODUCT"):
                return Cell("num", reduce(lambda a, b: a * b, v), errs_num)
            if name == "AVERAGE":
                return Cell("num", reduce(lambda a, b: a + b, v) / len(v), errs_num)
            best = F.least if name == "MIN" else F.greatest
            return Cell("num", best(*v) if len(v) > 1 else v[0], errs_num)
        if name == "COUNT":
            ones = [F.when(number(a).err.isNull() & a.value.isNotNull(), 1).otherwise(0) for a in args if a.kind != "blank"]
            return Cell("num", reduce(lambda a, b: a + b, ones, F.lit(0)).cast("double"), _none())
        if name == "COUNTA":
            ones = [F.when(a.value.isNotNull() | a.err.isNotNull(), 1).otherwise(0) for a in args if a.kind != "blank"]
            return Cell("num", reduce(lambda a, b: a + b, ones, F.lit(0)).cast("double"), _none())
        if name in ("ROUND", "ROUNDUP", "ROUNDDOWN", "TRUNC") and 1 <= len(args) <= 2:
            digits = nums[1].value if len(args) == 2 else F.lit(0.0)
            mode = {"ROUND": "half", "ROUNDUP": "up"}.get(name, "down")
            return Cell("num", _round(nums[0].value, digits, mode), errs_num)
        if name == "INT" and len(args) == 1:
            return Cell("num", F.floor(snapped(nums[0].value)).cast("double"), errs_num)
        if name == "ABS" and len(args) == 1:
            return Cell("num", F.abs(nums[0].value), errs_num)
        if name == "MOD" and len(args) == 2:
            a, b = nums[0].value, nums[1].value
            return Cell("num", a - b * F.floor(F.try_divide(a, b)), combine(errs_num, F.when(b == 0, F.lit(DIV))))
        if name == "IF" and 2 <= len(args) <= 3:
            test = boolean(args[0])
            yes, no = args[1], args[2] if len(args) == 3 else Cell("bool", F.lit(False), _none())
            yes, no = self.alike(yes, no)
            return Cell(yes.kind, F.when(test.value, yes.value).otherwise(no.value), combine(test.err, F.when(test.value, yes.err).otherwise(no.err)))
        if name == "IFERROR" and len(args) == 2:
            a, b = self.alike(*args)
            failed = args[0].err.isNotNull()
            return Cell(a.kind, F.when(failed, b.value).otherwise(a.value), F.when(failed, b.err))
        if name in ("AND", "OR") and args:
            v = [boolean(a) for a in args]
            return Cell("bool", reduce((lambda a, b: a & b) if name == "AND" else (lambda a, b: a | b), [x.value for x in v]), combine(_none(), *[x.err for x in v]))
        if name == "NOT" and len(args) == 1:
            v = boolean(args[0])
            return Cell("bool", ~v.value, v.err)
        if name in ("CONCAT", "CONCATENATE") and args:
            return Cell("text", F.concat(*[text(a).value for a in args]), errs)
        if name == "VALUE" and len(args) == 1:
            return nums[0]
        if name == "NUMBERSTRING" and len(args) == 2:
            n = F.floor(nums[0].value + 0.5)
            spelled = F.when(nums[1].value == 1, hangul_digits(n, 1)).when(nums[1].value == 2, hangul_digits(n, 2)).when(nums[1].value == 3, hangul_digits(n, 3))
            bad = (n < 0) | (n >= 1e16) | ~nums[1].value.isin(1.0, 2.0, 3.0)
            return Cell("text", F.when(~bad, spelled), combine(errs_num, F.when(bad, F.lit(NUM))))
        raise UnsupportedFormula(f"no function {name} of {len(args)} arguments")

    @staticmethod
    def alike(a: Cell, b: Cell) -> tuple[Cell, Cell]:
        if a.kind == b.kind:
            return a, b
        if "blank" in (a.kind, b.kind):
            other = a.kind if b.kind == "blank" else b.kind
            to = {"num": number, "text": text, "bool": boolean}[other]
            return to(a), to(b)
        return text(a), text(b)


def with_formula(df: DataFrame, name: str, formula: str) -> DataFrame:
    """``df`` with the formula's value as ``name`` and its error code, or null, as ``name_err``."""
    cell = Translator(formula, {f.name: f.dataType for f in df.schema}).run()
    value = F.when(cell.err.isNull(), cell.value)
    return df.withColumns({name: value, f"{name}_err": cell.err})


def column_letters(index: Column) -> Column:
    """A, B, ... Z, AA, ... of a zero-based column number below 18278."""
    letter = lambda x: F.chr((F.lit(65) + x).cast("int"))
    n = index.cast("long")
    two, three = n - 26, n - 702
    return (
        F.when(n < 26, letter(n))
        .when(n < 702, F.concat(letter(F.floor(two / 26)), letter(two % 26)))
        .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26)))
    )


def column_index(letters: Column) -> Column:
    """The zero-based number of column letters; null if they are not letters."""
    up = F.upper(letters)
    value = F.aggregate(F.split(up, ""), F.lit(0).cast("long"), lambda a, c: a * 26 + F.ascii(c) - 64)
    return F.when(up.rlike("^[A-Z]{1,3}$"), value - 1)
