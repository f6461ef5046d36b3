"""Formulas built alike, computed together for many workbooks at once.

``=A1*B1`` and ``=A2*B2`` are one tree over other places.  All formulas of a
tree, in whatever workbooks of a chunk, are computed by arrays; which of them an
edit reaches, and in which order, are counts of cells between two places of the
sorted cells.  That holds where formulas make numbers of numbers, or choose
between texts, as most do.  A workbook with anything else that an edit reaches
(errors, blanks, texts read as numbers, cycles, long chains, other functions) is
named, for its formulas to be computed one by one.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.functions.formula import UnsupportedFormula
from tessera.operators import workbook

ROW_BITS, COL_BITS = 20, 14
NUM, STR, BOOL, ODD = 1, 2, 3, 4
KINDS = {None: 0, "blank": 0, "num": NUM, "str": STR, "bool": BOOL}
OVER_NUMBERS = ("SUM", "PRODUCT", "MIN", "MAX", "AVERAGE", "COUNT")
ARITIES = {"ROUND": (1, 2), "ROUNDUP": (1, 2), "ROUNDDOWN": (1, 2), "TRUNC": (1, 2), "MOD": (2,), "INT": (1,), "ABS": (1,), "VALUE": (1,), "NOT": (1,), "IF": (3,), "IFERROR": (2,)}
COMPARE = {"=": np.equal, "<>": np.not_equal, "<": np.less, "<=": np.less_equal, ">": np.greater, ">=": np.greater_equal}
MOST_ROUNDS = 64


class Beyond(Exception):
    """What arrays do not compute."""


def by_arrays(node) -> bool:
    """Whether arrays compute a tree."""
    kind = node[0]
    if kind == "value":
        return isinstance(node[1], (bool, float, str)) and not isinstance(node[1], workbook.Err)
    if kind in ("sign", "percent"):
        return by_arrays(node[-1])
    if kind == "binary":
        return node[1] not in ("&", "^") and by_arrays(node[2]) and by_arrays(node[3])
    if kind == "call" and node[1] in OVER_NUMBERS:
        return all(a[0] == "range" or by_arrays(a) for a in node[2])
    return kind == "cell" or kind == "call" and len(node[2]) in ARITIES.get(node[1], ()) and all(map(by_arrays, node[2]))


@lru_cache(50_000)
def built(text: str, sheet: str) -> tuple[str, tuple | None, list]:
    """(key, tree, areas) of a formula, equal keys for equal trees; no key where it cannot be read, no tree where arrays do not compute it."""
    try:
        own = workbook.read(text, sheet)
    except UnsupportedFormula:
        return "", None, []
    areas = [tuple(a[3:]) for a in own.areas]
    fits = all(0 <= r0 <= r1 < 1 << ROW_BITS and 0 <= c0 <= c1 < 1 << COL_BITS for _, _, r0, c0, r1, c1 in areas)
    # of formulas that arrays do not compute only the places they read matter here, so long as these fit
    if fits and by_arrays(own.tree):
        return repr(own.tree), own.tree, areas
    return "beyond" if fits else "outside", None, areas if fits else []


def over_stretches(over: np.ufunc, x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """``over`` x[first:last] of each pair, none empty; many that begin at one place take one pass."""
    out = np.empty(len(first))
    order = np.argsort(first, kind="stable")
    begins = np.flatnonzero(np.diff(first[order], prepend=-1))
    sizes = np.diff(begins, append=len(order))
    single = np.repeat(sizes <= 8, sizes)
    for k in np.flatnonzero(sizes > 8).tolist():
        own = order[begins[k] : begins[k] + sizes[k]]
        at = first[own[0]]
        out[own] = over.accumulate(x[at : last[own].max()])[last[own] - 1 - at]
    if (rest := order[single]).size:
        ends = np.column_stack((first[rest], last[rest])).ravel()
        out[rest] = over.reduceat(np.append(x, 0.0), ends)[::2]
    return out


def counted(flags: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(flags)))


def codes(column: pa.Array) -> tuple[np.ndarray, list]:
    """(code of each value, values), nulls among them."""
    own = column.dictionary_encode(null_encoding="encode")
    return own.indices.to_numpy(zero_copy_only=False), own.dictionary.to_pylist()


class Chunk:
    """The rows (book, place, value, formula, edit) of whole workbooks, those of each together.

    ``apart`` tells of each workbook, numbered in order, whether its formulas
    are to be computed one by one.
    """

    def __init__(self, rows: pa.RecordBatch):
        self.rows = rows
        self.book = codes(rows.column("book"))[0].astype(np.int64)
        self.apart = np.zeros(self.book[-1] + 1, bool)
        sheet, self.sheet_names = codes(rows.column("sheet"))
        row, col = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("row", "col"))
        edit = rows.column("edit").to_numpy(zero_copy_only=False)
        outside = ~((row >= 0) & (row < 1 << ROW_BITS) & (col >= 0) & (col < 1 << COL_BITS))
        self.apart[self.book[outside]] = True
        row, col = np.where(outside, 0, row).astype(np.int64), np.where(outside, 0, col).astype(np.int64)
        # cells by (workbook, sheet), column and row; an edit stands for the cell that it replaces
        self.sheets, group = np.unique(self.book * len(self.sheet_names) + sheet, return_inverse=True)
        key = (((group << COL_BITS | col) << ROW_BITS | row) << 1) | edit
        order = np.argsort(key)
        key = key[order]
        edited, key = (key & 1).astype(bool), key >> 1
        same = key[1:] == key[:-1]
        self.apart[self.book[order[1:][same & (edited[1:] == edited[:-1])]]] = True
        kept = np.append(~(same & edited[1:] & ~edited[:-1]), True)
        self.key, self.source, self.edited = key[kept], order[kept], edited[kept]
        ends = np.flatnonzero(np.diff(self.key >> ROW_BITS + COL_BITS, append=-1))
        self.width = self.key[ends] >> ROW_BITS & (1 << COL_BITS) - 1
        kind, names = codes(rows.column("kind"))
        self.kind = np.array([KINDS.get(n, ODD) for n in names], np.int8)[kind][self.source]
        self.value = rows.column("num").to_numpy(zero_copy_only=False)[self.source]
        self.kind[(self.kind == NUM) & rows.column("num").is_null().to_numpy(zero_copy_only=False)[self.source]] = 0
        self.members(sheet)
        self.read()

    def members(self, sheet: np.ndarray) -> None:
        """The formulas of workbooks with edits."""
        text, texts = codes(self.rows.column("formula"))
        has = np.array([t is not None for t in texts])[text[self.source]] & ~self.edited
        at = np.flatnonzero(has)
        pair, of = np.unique(text[self.source[at]].astype(np.int64) * len(self.sheet_names) + sheet[self.source[at]], return_inverse=True)
        own = [built(texts[p // len(self.sheet_names)], self.sheet_names[p % len(self.sheet_names)]) for p in pair.tolist()]
        keys = {key: k for k, key in enumerate(dict.fromkeys(key for key, _, _ in own))}
        self.trees: list = [None] * len(keys)
        for key, tree, _ in own:
            self.trees[keys[key]] = tree
        tree = np.array([keys[key] for key, _, _ in own], np.int64)[of] if own else np.zeros(0, np.int64)
        book = self.book[self.source[at]]
        for key in ("", "outside"):
            if key in keys:
                self.apart[book[tree == keys[key]]] = True
        live = np.zeros(len(self.apart), bool)
        live[self.book[self.source[self.edited]]] = True
        keep = (live & ~self.apart)[book]
        self.at, self.tree, self.of, self.owner = at[keep], tree[keep], of[keep], book[keep]
        sheets = {name: k for k, name in enumerate(self.sheet_names)}
        self.area_counts = np.array([len(areas) for _, _, areas in own], np.int64)
        self.areas = np.array([(a[0] == "cell", sheets.get(a[1], -1), *a[2:]) for _, _, areas in own for a in areas], np.int64).reshape(-1, 6)

    def read(self) -> None:
        """Where the areas of each formula lie: places of single cells, stretches of the columns of ranges."""
        n = self.area_counts[self.of]
        self.begin = counted(n)[:-1]
        self.reader = np.repeat(np.arange(len(n)), n)
        area = self.areas[(counted(self.area_counts)[:-1][self.of] - self.begin)[self.reader] + np.arange(len(self.reader))]
        single, sheet, r0, c0, r1, c1 = area.T
        wanted = self.owner[self.reader] * len(self.sheet_names) + sheet
        group = np.minimum(np.searchsorted(self.sheets, wanted), len(self.sheets) - 1)
        known = (self.sheets[group] == wanted) & (sheet >= 0)
        place = (group << COL_BITS | c0) << ROW_BITS | r0
        cell = np.minimum(np.searchsorted(self.key, place), len(self.key) - 1)
        self.cell = np.where(known & (single == 1) & (self.key[cell] == place), cell, -1)
        wide = np.flatnonzero(known & (single == 0) & (c0 <= self.width[group]))
        columns = np.minimum(c1, self.width[group])[wide] - c0[wide] + 1
        stretch = np.repeat(wide, columns)
        col = c0[stretch] + np.arange(len(stretch)) - np.repeat(counted(columns)[:-1], columns)
        column = (group[stretch] << COL_BITS | col) << ROW_BITS
        first, last = np.searchsorted(self.key, column | r0[stretch]), np.searchsorted(self.key, column | r1[stretch], "right")
        some = first < last
        self.stretch, self.first, self.last = stretch[some], first[some], last[some]

    def holding(self, flags: np.ndarray) -> np.ndarray:
        """Which formulas have a flagged cell in their areas."""
        out = np.zeros(len(self.at), bool)
        out[self.reader[np.append(flags, False)[self.cell]]] = True
        upto = counted(flags)
        out[self.reader[self.stretch[upto[self.last] > upto[self.first]]]] = True
        return out

    def narrowed(self, keep: np.ndarray) -> None:
        """Forget other formulas."""
        self.at, self.tree, self.of, self.owner = self.at[keep], self.tree[keep], self.of[keep], self.owner[keep]
        area = keep[self.reader]
        renamed = np.cumsum(area) - 1
        some = area[self.stretch]
        self.stretch, self.first, self.last = renamed[self.stretch[some]], self.first[some], self.last[some]
        self.begin, self.cell, self.reader = renamed[np.minimum(self.begin[keep], max(len(renamed) - 1, 0))], self.cell[area], (np.cumsum(keep) - 1)[self.reader[area]]

    def computed(self) -> pa.RecordBatch | None:
        """(book, place, before, after) of formulas whose value is another now, in workbooks that do not stand apart."""
        if not len(self.at):
            return None
        self.reach()
        self.texts = np.full(len(self.at), None, object)
        waits = ~self.apart[self.owner]
        for _ in range(MOST_ROUNDS):
            flags = np.zeros(len(self.key), bool)
            flags[self.at[waits]] = True
            ready = np.flatnonzero(waits & ~self.holding(flags))
            if not len(ready):
                break
            self.step(ready)
            waits[ready] = False
            waits &= ~self.apart[self.owner]
        self.apart[self.owner[waits]] = True
        return self.changes()

    def reach(self) -> None:
        """Keep the formulas that an edit reaches."""
        reached, flags = np.zeros(len(self.at), bool), self.edited.copy()
        for _ in range(MOST_ROUNDS):
            new = self.holding(flags) & ~reached
            if not new.any():
                break
            reached |= new
            flags = np.zeros(len(self.key), bool)
            flags[self.at[new]] = True
        else:
            self.apart[self.owner[new]] = True
        beyond = np.array([t is None for t in self.trees])[self.tree]
        self.apart[self.owner[reached & beyond]] = True
        self.narrowed(reached & ~self.apart[self.owner])

    def step(self, ready: np.ndarray) -> None:
        """Compute formulas that do not read each other."""
        numbers = self.kind == NUM
        self.numbers, self.upto, self.errors = self.value[numbers], counted(numbers), counted(self.kind == ODD)
        ready = ready[np.argsort(self.tree[ready], kind="stable")]
        found = []
        for own in np.split(ready, np.flatnonzero(np.diff(self.tree[ready])) + 1):
            try:
                found.append((own, *self.top(own)))
            except (Beyond, OverflowError, ValueError):
                self.apart[self.owner[own]] = True
        for own, kind, v, odd in found:
            self.apart[self.owner[own[np.broadcast_to(odd, own.shape)]]] = True
            self.kind[self.at[own]] = kind
            if kind == STR:
                self.texts[own] = v
            else:
                self.value[self.at[own]] = v

    def top(self, own: np.ndarray) -> tuple:
        kind, v, odd = self.of_node(self.trees[self.tree[own[0]]], own)
        return kind, v, odd | ~np.isfinite(v) if kind == NUM else odd

    def of_node(self, node, own: np.ndarray) -> tuple:
        """(kind, values, odd) of a node for the formulas ``own``; odd ones are left to others."""
        what = node[0]
        if what == "value":
            return (BOOL if isinstance(node[1], bool) else NUM if isinstance(node[1], float) else STR), node[1], False
        if what == "cell":
            at = self.cell[self.begin[own] + node[1]]
            return NUM, self.value[at], (at < 0) | (self.kind[at] != NUM)
        if what == "sign":
            v, odd = self.number(node[2], own)
            return NUM, node[1] * v, odd
        if what == "percent":
            v, odd = self.number(node[1], own)
            return NUM, v / 100, odd
        if what == "binary":
            return self.binary(node, own)
        if node[1] in OVER_NUMBERS:
            return NUM, *self.over_ranges(node[1], node[2], own)
        return self.call(node[1], node[2], own)

    def number(self, node, own: np.ndarray) -> tuple:
        kind, v, odd = self.of_node(node, own)
        if kind == STR:
            raise Beyond
        return np.asarray(v, np.float64), odd

    def truth(self, node, own: np.ndarray) -> tuple:
        v, odd = self.number(node, own)
        return v != 0, odd

    def binary(self, node, own: np.ndarray) -> tuple:
        op = node[1]
        if op in COMPARE:
            (a_kind, a, a_odd), (b_kind, b, b_odd) = self.of_node(node[2], own), self.of_node(node[3], own)
            if not a_kind == b_kind == NUM:
                raise Beyond
            return BOOL, COMPARE[op](a, b), a_odd | b_odd
        (a, a_odd), (b, b_odd) = self.number(node[2], own), self.number(node[3], own)
        if op == "/":
            return NUM, a / b, a_odd | b_odd | (b == 0)
        return NUM, a + b if op == "+" else a - b if op == "-" else a * b, a_odd | b_odd

    def over_ranges(self, name: str, args: list, own: np.ndarray) -> tuple:
        """SUM and its like, in the order of their arguments."""
        none = {"PRODUCT": 1.0, "MIN": math.inf, "MAX": -math.inf}.get(name, 0.0)
        over = {"PRODUCT": np.multiply, "MIN": np.minimum, "MAX": np.maximum}.get(name, np.add)
        n, v, odd = np.zeros(len(own), np.int64), np.full(len(own), none), np.zeros(len(own), bool)
        for arg in args:
            if arg[0] != "range":
                x, x_odd = self.number(arg, own)
                n, v, odd = n + 1, over(v, x), odd | x_odd | ~np.isfinite(x)
                continue
            # the stretches of these formulas' areas lie in their order
            area = self.begin[own] + arg[1]
            low, high = np.searchsorted(self.stretch, area), np.searchsorted(self.stretch, area, "right")
            many = high - low
            place = np.repeat(np.arange(len(own)), many)
            which = np.repeat(low - counted(many)[:-1], many) + np.arange(len(place))
            first, last = self.first[which], self.last[which]
            odd[place[self.errors[last] > self.errors[first]]] = True
            first, last = self.upto[first], self.upto[last]
            np.add.at(n, place, last - first)
            if name != "COUNT" and (some := first < last).any():
                # a range is added up by itself before it meets other arguments
                part, held = np.full(len(own), none), np.zeros(len(own), bool)
                over.at(part, place[some], over_stretches(over, self.numbers, first[some], last[some]))
                held[place[some]] = True
                v = np.where(held, over(v, part), v)
        if name == "COUNT":
            return n.astype(np.float64), odd
        if name == "AVERAGE":
            return v / np.maximum(n, 1), odd | (n == 0)
        return np.where(n == 0, 0.0, v) if name in ("MIN", "MAX") else v, odd

    def call(self, name: str, args: list, own: np.ndarray) -> tuple:
        if name == "IF":
            test, odd = self.truth(args[0], own)
            (a_kind, a, a_odd), (b_kind, b, b_odd) = self.of_node(args[1], own), self.of_node(args[2], own)
            if a_kind != b_kind:
                raise Beyond
            if a_kind == STR:
                a, b = (np.array([x], object) if isinstance(x, str) else x for x in (a, b))
            return a_kind, np.where(test, a, b), odd | np.where(test, a_odd, b_odd)
        if name == "IFERROR":
            kind, v, odd = self.of_node(args[0], own)
            return kind, v, odd | ~np.isfinite(v) if kind == NUM else odd
        if name == "NOT":
            v, odd = self.truth(args[0], own)
            return BOOL, ~v, odd
        x, odds = zip(*(self.number(a, own) for a in args), strict=True)
        odd = odds[0] | odds[-1]
        if name == "MOD":
            return NUM, x[0] - x[1] * np.floor(x[0] / x[1]), odd | (x[1] == 0) | ~np.isfinite(x[0] / x[1])
        if name in ("ABS", "VALUE"):
            return NUM, np.abs(x[0]) if name == "ABS" else x[0], odd
        odd = odd | ~np.isfinite(x[0])
        if name == "INT":
            return NUM, np.floor(fifteen(x[0])) + 0.0, odd
        digits, of = np.unique(x[1] if len(x) == 2 else 0.0, return_inverse=True)
        scale = np.array([10.0 ** math.floor(d) for d in digits])[of].reshape(np.shape(x[-1]) if len(x) == 2 else ())
        scaled = np.abs(x[0]) * scale
        m = fifteen(scaled)
        v = np.floor(m + 0.5) if name == "ROUND" else np.ceil(m) if name == "ROUNDUP" else np.floor(m)
        return NUM, np.copysign(v / scale, x[0]), odd | ~np.isfinite(scaled)

    def changes(self) -> pa.RecordBatch | None:
        own = np.flatnonzero(~self.apart[self.owner])
        at = self.at[own]
        source, kind, value = pa.array(self.source[at]), self.kind[at], self.value[at]
        before = [self.rows.column(c).take(source) for c in workbook.VALUE_FIELDS]
        text = pa.array(self.texts[own], pa.string())
        after = [
            pa.array(["num", "str", "bool"]).take(pa.array(kind - NUM)), pa.array(value, pa.float64(), mask=kind != NUM), text,
            pa.array(value != 0, pa.bool_(), mask=kind != BOOL), pa.nulls(len(own), pa.string()),
        ]
        same = np.ones(len(own), bool)
        for x, y in zip(before, after, strict=True):
            none = pc.and_(x.is_null(), y.is_null())
            same &= pc.or_(none, pc.fill_null(pc.equal(x, y), False)).to_numpy(zero_copy_only=False)
        other = pa.array(~same)
        place = [self.rows.column(c).take(source) for c in workbook.PLACE]
        whole = lambda parts: pa.StructArray.from_arrays([c.filter(other) for c in parts], names=list(workbook.VALUE_FIELDS))
        return pa.record_batch([*(c.filter(other) for c in place), whole(before), whole(after)], names=[*workbook.PLACE, "before", "after"])


def fifteen(x: np.ndarray) -> np.ndarray:
    """Numbers to fifteen digits."""
    return np.array([float(f"{v:.14e}") for v in np.ravel(x).tolist()]).reshape(np.shape(x))
