"""Aggregates over ranges by look-ups, long chains and cycles of formulas."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessera.operators import ranges, workbook
from tessera.operators.scratch import Scratch

CELLS = "book string, sheet string, row int, col int, kind string, num double, str string, bool boolean, err string, formula string"


def num(row, col, v, f=None, sheet="S"):
    return ("b", sheet, row, col, "num", float(v), None, None, None, f)


def test_ranges_equal_all_cells(spark):
    rnd = random.Random(1)
    cells = [("b", "s", r, c, float(rnd.randint(-9, 9))) for r in range(70) for c in range(3) if rnd.random() < 0.8]
    areas = []
    for k in range(150):
        (r0, r1), (c0, c1) = sorted((rnd.randint(0, 75), rnd.randint(0, 99))), sorted((rnd.randint(0, 3), rnd.randint(0, 5)))
        areas.append((k, 0, "b", "s", r0, c0, r1, c1))
    table = spark.createDataFrame(cells, "book string, sheet string, row int, col int, num double")
    asked = spark.createDataFrame(areas, "id long, need int, book string, sheet string, r0 int, c0 int, r1 int, c1 int")
    sheets = table.groupBy("book", "sheet").agg(F.max("row").alias("rows"), F.max("col").alias("cols"))
    running = {"n": F.count("num"), "total": F.sum("num"), "least": F.min("num"), "product": F.product(F.signum("num"))}
    merged = {"n": F.sum("n"), "total": F.sum("total"), "least": F.min("least"), "product": F.product("product")}
    got = {r.id: (r.n, r.total, r.least, r["product"]) for r in ranges.over_ranges(asked, table, sheets, running, merged).collect()}
    for k, _, _, _, r0, c0, r1, c1 in areas:
        v = [x for _, _, r, c, x in cells if r0 <= r <= r1 and c0 <= c <= c1]
        sign = 1.0
        for x in v:
            sign *= (x > 0) - (x < 0)
        assert got.get(k, (0, None, None, None)) == (len(v), sum(v) if v else None, min(v, default=None), sign if v else None)


def test_components(spark):
    rnd = random.Random(2)
    edges = [(k, k + 1) for k in range(700)] + [(2000 + k, 2000 + rnd.randint(0, k - 1)) for k in range(1, 90)] + [(5000, 5000), (9, 9)]
    names = list(range(701))
    rnd.shuffle(names)
    edges = [(names[a], names[b]) if a < 701 and b < 701 else (a, b) for a, b in edges]
    got = ranges.components(Scratch(spark, "test"), spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {**dict.fromkeys(range(701), 0), **dict.fromkeys(range(2000, 2090), 2000), 5000: 5000} and len(got) == 792


def test_a_chain_of_ten_thousand_formulas_and_cycles(spark):
    n = 10_000
    cells = [num(0, 0, 1)] + [num(r, 0, 0, f"=A{r}+1") for r in range(1, n)]
    cells += [num(0, 3, 0, "=E1+F1"), num(0, 4, 0, "=D1"), num(0, 5, 0, "=A1"), num(1, 3, 0, "=D2+A1"), num(2, 3, 0, "=D1+1"), num(3, 3, 0, "=T!A1"), num(0, 0, 0, "=S!D4+S!A1", "T")]
    before = spark.createDataFrame(cells, CELLS).repartition(3)
    changes, problems = workbook.recalculate(before, spark.createDataFrame([num(0, 0, 5)], CELLS).drop("formula"))
    got = {r.address: r.after.num for r in changes.collect()}
    assert got == {**{f"A{r + 1}": float(r + 5) for r in range(1, n)}, "F1": 5.0}
    told = {(r.sheet, r.address): r.problem for r in problems.collect()}
    assert told == {("S", "D1"): "part of a cycle: D1, E1", ("S", "E1"): "part of a cycle: D1, E1", ("S", "D2"): "part of a cycle: D2", ("S", "D3"): "reads a cycle", ("S", "D4"): "part of a cycle: S!D4, T!A1", ("T", "A1"): "part of a cycle: S!D4, T!A1"}


def test_running_totals_of_a_long_column(spark):
    """Two look-ups a formula: what is shuffled stays in proportion to the cells, not to what the ranges hold."""
    n = 30_000
    rows = spark.range(n).select(F.col("id").cast("int").alias("row"))
    value = F.struct(F.lit(0).alias("col"), (F.col("row") % 7).cast("double").alias("num"), F.lit(None).cast("string").alias("formula"))
    total = F.struct(F.lit(1).alias("col"), F.lit(0.0).alias("num"), F.format_string("=SUM(A$1:A%d)-MIN(A%d:A$%d)", F.col("row") + 1, F.col("row") + 1, F.lit(n)).alias("formula"))
    cells = rows.select(F.lit("b").alias("book"), F.lit("S").alias("sheet"), "row", F.explode(F.array(value, total)).alias("c")).select("book", "sheet", "row", "c.col", F.lit("num").alias("kind"), "c.num", F.lit(None).cast("string").alias("str"), F.lit(None).cast("boolean").alias("bool"), F.lit(None).cast("string").alias("err"), "c.formula")
    changes, problems = workbook.recalculate(cells, spark.createDataFrame([num(0, 0, 1000)], CELLS).drop("formula"))
    got = {r.row: r.after.num for r in changes.collect()}
    values = [1000] + [r % 7 for r in range(1, n)]
    want, total, least = {}, sum(values), values[-1]
    for r in range(n - 1, -1, -1):
        least = min(least, values[r])
        want[r] = float(total - least)
        total -= values[r]
    assert got == want and problems.count() == 0


def test_rounds_where_a_task_would_hold_too_much(spark):
    cells = [num(r, 0, r) for r in range(6)] + [num(r, 1, 0, f"=SUM(A$1:A{r + 1})") for r in range(6)] + [num(r, 2, 0, f"=MAX(B$1:B{r + 1})+COUNT(B:B)") for r in range(6)] + [num(0, 3, 0, "=D2"), num(1, 3, 0, "=D1+A1")]
    before, edit = spark.createDataFrame(cells, CELLS), spark.createDataFrame([num(0, 0, 100)], CELLS).drop("formula")
    sums = [100, 101, 103, 106, 110, 115]
    want = {f"B{r + 1}": float(s) for r, s in enumerate(sums)} | {f"C{r + 1}": s + 6.0 for r, s in enumerate(sums)}
    for limits in ({}, {"most_reads": 3}):
        changes, problems = workbook.recalculate(before, edit, **limits)
        assert {r.address: r.after.num for r in changes.collect()} == want
        assert {r.address for r in problems.collect()} == {"D1", "D2"}


def test_workbooks_of_moderate_size_take_one_task(spark, monkeypatch):
    """The same changes and problems as by joins, which are left alone."""
    texts = ["=SUM(A$1:A5)+MIN(A2:A4)", "=MAX(A:A)-AVERAGE(A1:A3)", "=PRODUCT(A1:B2)", "=COUNTA(A1:A9)&AND(A1:A5)", "=C1+1", "=SUMPRODUCT(A1:A3,A2:A4)", "=VLOOKUP(A1)", "=C9+A1", "=C8", "=A2"]
    cells = spark.createDataFrame([num(r, 0, r + 1) for r in range(5)] + [num(r, 2, -1, text) for r, text in enumerate(texts)], CELLS)
    edit = spark.createDataFrame([num(0, 0, 9)], CELLS).drop("formula")
    results = lambda found: [sorted(map(str, df.collect())) for df in found]
    apart = results(workbook.recalculate(cells, edit, most_cells=0))
    monkeypatch.setattr(workbook, "recalculated_apart", None)
    assert results(workbook.recalculate(cells, edit)) == apart and apart[0] and apart[1]
