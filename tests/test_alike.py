"""Formulas computed together by arrays, against the same one by one."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import alike, workbook
from tessera.operators.scratch import batches_of

NAMES = ["book", "sheet", "row", "col", "kind", "num", "str", "bool", "err", "formula", "edit"]
KINDS = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.bool_()]
PLAIN = [
    "=A{r}*B{r}", "=SUM(A$1:A{r})", "=MIN(A$1:A{r})+MAX(A{s}:A{r})", "=SUM(A:B)/COUNT(A1:A50)", '=IF(A{r}>3,"big","small")', "=IF(B{r}<>0,A{r}/B{r},-1)", "=ROUND(A{r}/7,2)-ROUNDUP(B{r},-1)",
    "=TRUNC(A1/3)+INT(-B{r}/2)", "=MOD(A{r},-3)", "=IFERROR(A{r}/2,0)", "=NOT(A{r}>B{r})", "=AVERAGE(A1:B{r},10)", "=PRODUCT(A{s}:B{r})*10%", "=-A1+T!A1", "=MAX(T!A:C,B{r})", "=C{s}+1", "=SUM(C$1:C{s})", "=COUNT(C:C)+D1", "=D{s}", "=VALUE(A1)+ABS(B1)", "=5",
]
ODD = ["=A{r}&B{r}", "=A{r}^2", "=VLOOKUP(A1)", "=E{r}", "=SUMPRODUCT(A1:A3,B1:B3)", "=COUNTA(A:A)", "=1/0+A1", "=A1:A3", "=AND(A1:A4)", "=1+", "=ZZZ1+A1", "=Z1+A1"]


def num(book, sheet, row, col, v, f=None, edit=False):
    return (book, sheet, row, col, "num", v, None, None, None, f, edit)


def some_books(rnd: random.Random, n: int) -> list[tuple]:
    rows = []
    for k in range(n):
        book, odd, length = f"b{k:03}", rnd.random() < 0.4, rnd.randint(1, 30)
        for r in range(length):
            rows += [num(book, "S", r, c, float(rnd.randint(-3, 9)) / rnd.choice((1, 1, 3))) for c in (0, 1) if not odd or rnd.random() < 0.9]
            for c in range(2, 2 + rnd.randint(0, 3)):
                text = rnd.choice(PLAIN if not odd or rnd.random() < 0.8 else ODD).format(r=r + 1, s=max(r - 1, 1))
                rows.append(num(book, "S", r, c, float(rnd.randint(0, 4)), text))
            if odd and rnd.random() < 0.2:
                rows.append((book, "S", r, 9, *rnd.choice([("str", None, "x", None, None), ("bool", None, None, True, None), ("err", None, None, None, "#N/A"), ("blank", None, None, None, None), ("num", None, None, None, None)]), None, False))
        rows += [num(book, "T", 0, c, 2.0) for c in range(2)]
        if rnd.random() < 0.9:
            rows += [num(book, "S", r, rnd.randint(0, 1), 50.0, edit=True) for r in {0, rnd.randint(0, length + 1)}]
        if rnd.random() < 0.1:
            rows.append(num(book, "S", 0, 2, 7.0, edit=True))
    return rows


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES)


def one_by_one(rows: list[tuple]) -> dict:
    book = workbook.Book(rows, 10**9, 10**9)
    stored = {(m["sheet"], m["row"], m["col"]): v for m, v in zip(book.members, list(book.values), strict=True)}
    found = {tuple(r[2:5]): (r[5:10], r[10]) for r in book.results()}
    assert not book.unreadable
    return {at: v for at, (v, problem) in found.items() if problem is not None or stored[at][:5] != v}


def test_alike_equals_one_by_one():
    seen = apart = 0
    for seed in range(6):
        rows = some_books(random.Random(seed), 60)
        with np.errstate(all="ignore"):
            chunk = alike.Chunk(batch(rows))
            found = chunk.computed()
        got: dict = {}
        for r in found.to_pylist():
            assert set(r["after"]) == set(workbook.VALUE_FIELDS)
            got.setdefault(r["book"], {})[r["sheet"], r["row"], r["col"]] = tuple(r["after"].values())
        names = sorted({r[0] for r in rows})
        assert len(names) == len(chunk.apart)
        for name, other in zip(names, chunk.apart.tolist(), strict=True):
            if other:
                apart += 1
                assert name not in got
                continue
            want = one_by_one([r for r in rows if r[0] == name])
            assert got.get(name, {}).keys() == want.keys()
            for at, v in got.get(name, {}).items():
                assert v[0] == want[at][0] and v[2:] == want[at][2:] and (v[1] == want[at][1] or v[1] == pytest.approx(want[at][1], rel=1e-13))
            seen += 1
    assert seen > 100 and apart > 20


def test_lines_and_totals_stand_nowhere_apart():
    """Books as those of the queries: no formula is left to be read and computed one by one."""
    rows = []
    for b in range(40):
        for r in range(b % 7 + 1):
            rows += [num(f"{b:02}", "lines", r, 0, r + 1.0), num(f"{b:02}", "lines", r, 1, 5.0), num(f"{b:02}", "lines", r, 2, 5.0 * r + 5, f"=A{r + 1}*B{r + 1}")]
            rows.append(num(f"{b:02}", "lines", r, 5, 0.0, f"=MIN(A$1:A{r + 1})+MAX(A{max(1, r - 1)}:A{r + 1})"))
        rows += [num(f"{b:02}", "lines", 0, 3, 5.0, "=SUM(C:C)"), num(f"{b:02}", "lines", 1, 3, 5.0, "=ROUND(D1/COUNT(A1:A50), 0)"), num(f"{b:02}", "lines", 0, 0, 100.0, edit=True)]
        rows.append((f"{b:02}", "notes", 0, 0, "str", None, "small", None, None, '=IF(lines!D1>560, "big", "small")', False))
    chunk = alike.Chunk(batch(rows))
    got = {(r["book"], r["sheet"], r["row"], r["col"]): r["after"]["num"] if r["after"]["num"] is not None else r["after"]["str"] for r in chunk.computed().to_pylist()}
    assert not chunk.apart.any()
    assert got["06", "lines", 0, 3] == 635.0 and got["06", "lines", 1, 3] == 91.0 and got["06", "notes", 0, 0] == "big" and ("01", "notes", 0, 0) not in got
    assert got["02", "lines", 2, 5] == 102.0 and got["02", "lines", 1, 5] == 102.0


def test_long_columns_take_one_pass():
    """Ranges that begin at one cell are not added up again for each."""
    n = 40_000
    x = np.arange(n, dtype=float)
    first, last = np.zeros(n, np.int64), np.arange(1, n + 1)
    assert np.array_equal(alike.over_stretches(np.add, x, first, last), x * (x + 1) / 2)
    first = np.maximum(last - 3, 0)
    assert np.array_equal(alike.over_stretches(np.maximum, x, first, last), x) and np.array_equal(alike.over_stretches(np.minimum, x, first, last), first)


def test_edits_among_the_cells_and_long_texts(spark):
    """Edits may be rows of the cells; workbooks are cut where they end, whatever the batches."""
    rows = some_books(random.Random(9), 50) + [("b000", "S", 90, 3, "str", None, "x" * 9000, None, None, None, False)]
    schema = "book string, sheet string, row int, col int, kind string, num double, str string, bool boolean, err string, formula string, edit boolean"
    both = spark.createDataFrame(rows, schema).repartition(5)
    results = lambda found: [sorted(map(str, df.collect())) for df in found]
    one = results(workbook.recalculate(both))
    assert one == results(workbook.recalculate(both.filter("NOT edit").drop("edit"), both.filter("edit").drop("edit", "formula"))) and one[0] and one[1]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with batches_of(spark, 1 << 20):
        assert spark.conf.get(name) == "100"
    assert spark.conf.get(name) == before


def test_chunks_end_with_workbooks(monkeypatch):
    monkeypatch.setattr(workbook, "CHUNK", 7)
    rows = [num(b, "S", r, 0, 1.0) for b, n in (("a", 3), ("b", 9), ("c", 1), ("d", 20), ("e", 2)) for r in range(n)]
    for size in (1, 4, 50):
        found = [c.column("book").to_pylist() for c in workbook.chunks([batch(rows[k : k + size]) for k in range(0, len(rows), size)])]
        assert [b for own in found for b in own] == [r[0] for r in rows]
        assert not any(set(a) & set(b) for k, a in enumerate(found) for b in found[k + 1 :])


def test_cells_are_made_in_one_pass(spark):
    """One shuffle of the order lines, whatever is read of them."""
    from tessera.plans import registry

    made = []
    own, workbook.recalculate = workbook.recalculate, lambda cells: made.append(cells) or own(cells)
    try:
        for name in ("recalculated_orders", "running_totals"):
            registry.queries()[name](spark, "/root/testdata/sf0.001")
    finally:
        workbook.recalculate = own
    for cells in made:
        assert cells._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert cells.filter(F.col("edit")).count() == cells.select("book").distinct().count()


def test_columns_without_values_are_not_passed_on(spark):
    """Texts, truths and errors go to Python only where some cell has one, with the same changes; rows are read in small parts."""
    from tessera.operators.scratch import Scratch

    schema = "book string, sheet string, row int, col int, kind string, num double, str string, bool boolean, err string, formula string, edit boolean"
    rows = [num("b", "S", 0, 0, 1.0), num("b", "S", 0, 1, 2.0, "=A1*2"), num("b", "S", 0, 0, 4.0, edit=True)]
    cells = Scratch(spark, "test").write(spark.createDataFrame(rows, schema), "rows", part=1 << 20)
    for empty in ([], ["bool", "err"], ["str", "bool", "err"]):
        found = workbook.computed_by_book(cells, 3, empty, 100, 100)
        assert [(r.book, r.row, r.col, r.before.num, r.after.num, r.problem) for r in found.collect()] == [("b", 0, 1, 2.0, 8.0, None)]
        plan = found._jdf.queryExecution().executedPlan().toString()
        shuffled = next(line for line in plan.splitlines() if "MapInArrow" in line).split("run(")[1].split(")")[0]
        assert not [c for c in empty if f" {c}#" in shuffled or shuffled.startswith(f"{c}#")]
