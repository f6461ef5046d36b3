"""What ranges of cells add up to, two look-ups for each column of a range, whatever its length.

Rows of a column are seen as the leaves of a binary tree.  The ends of a range
part at one level of it: there the range is the end of one half and the start of
the next.  So what a range holds is a running aggregate up to its last row
within a half, and one down to its first row.  All running aggregates of a half
are one pass over its cells, in which the ends of ranges lie between the cells.
Any aggregate that merges will do, also one that cannot be taken back (a
minimum, a product), and nothing is lost to differences of large sums.  A cell
takes part once for each level at which a range of its half ends, at most 20
times, and halves have no more rows than a sheet, so neither the number of
ranges nor their lengths meet in a product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMN = ("book", "sheet", "col")
HALF = (*COLUMN, "level", "half", "side")


def by_column(areas: DataFrame, sheets: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, book, sheet, col, first, last): a row for each column of an area (r0, c0, r1, c1) that its sheet (rows, cols) reaches."""
    near = areas.join(sheets, ["book", "sheet"]).withColumns({"last": F.least("r1", "rows"), "to_col": F.least("c1", "cols")}).filter("r0 <= last AND c0 <= to_col")
    return near.select(*keys, "book", "sheet", F.explode(F.sequence("c0", "to_col")).alias("col"), F.col("r0").alias("first"), "last")


def over_columns(ranges: DataFrame, cells: DataFrame, running: dict[str, Column], keys: tuple[str, ...]) -> DataFrame:
    """(keys, book, sheet, col, running ...) of each row (keys, book, sheet, col, first, last), one or two rows for each, to be merged.

    ``running`` names aggregates over ``cells`` (book, sheet, row, col, ...);
    for them the ends of ranges are rows too, with asks true and no values.
    Ranges without cells give rows of what the aggregates make of nothing.
    """
    part = F.col("first").bitwiseXOR(F.col("last"))
    level = F.when(part == 0, 0).otherwise(F.length(F.bin(part.cast("long"))) - 1)
    end = lambda row, side: F.struct(F.col(row).alias("row"), F.lit(side).alias("side"))
    ends = ranges.withColumn("level", level).withColumn("end", F.explode(F.when(part == 0, F.array(end("last", 1))).otherwise(F.array(end("last", 1), end("first", -1)))))
    ends = ends.select(*keys, *COLUMN, "level", "end.row", "end.side").withColumn("half", F.expr("shiftright(row, level)"))
    halves = ends.select(*HALF).distinct()
    levels = halves.groupBy(*COLUMN).agg(F.collect_set(F.struct("level", "side")).alias("at"))  # 42 at most
    placed = cells.join(levels, list(COLUMN)).withColumn("at", F.explode("at")).select("*", "at.level", "at.side").drop("at").withColumn("half", F.expr("shiftright(row, level)"))
    placed = placed.join(halves, list(HALF), "left_semi").withColumn("asks", F.lit(False))
    both = placed.unionByName(ends.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    upto = Window.partitionBy(*HALF).orderBy(F.col("row") * F.col("side"), "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.select(*keys, *COLUMN, "asks", *[agg.over(upto).alias(name) for name, agg in running.items()]).filter("asks").drop("asks")


def over_ranges(areas: DataFrame, cells: DataFrame, sheets: DataFrame, running: dict[str, Column], merged: dict[str, Column], keys: tuple[str, ...] = ("id", "need")) -> DataFrame:
    """(keys, merged ...) for each area (keys, book, sheet, r0, c0, r1, c1) that its sheet reaches."""
    return over_columns(by_column(areas, sheets, keys), cells, running, keys).groupBy(*keys).agg(*[agg.alias(name) for name, agg in merged.items()])


def holding(areas: DataFrame, cells: DataFrame, sheets: DataFrame) -> DataFrame:
    """The distinct ids of the areas (id, need, part, kind, place) that hold one of ``cells`` (book, sheet, row, col)."""
    cells = cells.select("book", "sheet", "row", "col")
    one = areas.filter("kind = 'cell'").join(cells.withColumnsRenamed({"row": "r0", "col": "c0"}), ["book", "sheet", "r0", "c0"], "left_semi").select("id")
    wide = over_ranges(areas.filter("kind <> 'cell'"), cells, sheets, {"n": F.count_if(~F.col("asks"))}, {"n": F.sum("n")}, ("id", "need", "part"))
    return one.union(wide.filter("n > 0").select("id")).distinct()


def links(areas: DataFrame, formulas: DataFrame, sheets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) that connect each formula with all those in its areas, and (id, n, side_by_side), how many these are.

    ``formulas`` is (id, place).  An area is tied to the first formula that it
    holds in a column, and formulas that follow each other in a column are tied
    where any area holds both, so edges grow with areas and formulas, not with
    what the areas hold.
    """
    order = Window.partitionBy(*COLUMN).orderBy("row")
    ranked = formulas.select("id", *COLUMN, "row").withColumns({"rank": F.row_number().over(order), "next": F.lead("id").over(order)})
    one = areas.filter("kind = 'cell'").join(ranked.select("book", "sheet", F.col("row").alias("r0"), F.col("col").alias("c0"), F.col("id").alias("on")), ["book", "sheet", "r0", "c0"])
    keys = ("id", "need", "part", "kind")
    running = {"low": F.min("rank"), "high": F.max("rank"), "n": F.count_if(~F.col("asks"))}
    wide = over_columns(by_column(areas.filter("kind <> 'cell'"), sheets, keys), ranked.select(*COLUMN, "row", "rank"), running, keys)
    wide = wide.groupBy(*keys, *COLUMN).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).filter("n > 0")
    first = wide.join(ranked.select(*COLUMN, F.col("rank").alias("low"), F.col("id").alias("on")), [*COLUMN, "low"]).select("id", "on")
    steps = wide.select(*COLUMN, F.explode(F.array(F.struct(F.col("low").alias("rank"), F.lit(1).alias("step")), F.struct(F.col("high").alias("rank"), F.lit(-1).alias("step")))).alias("end")).select(*COLUMN, "end.*")
    steps = steps.groupBy(*COLUMN, "rank").agg(F.sum("step").alias("step"))
    held = F.sum(F.coalesce("step", F.lit(0))).over(Window.partitionBy(*COLUMN).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    beside = ranked.join(steps, [*COLUMN, "rank"], "left").withColumn("held", held).filter("held > 0 AND next IS NOT NULL").select("id", "next")
    edges = one.select("id", "on").union(first).union(beside).toDF("a", "b")
    counts = one.select("id", F.lit(1).alias("n"), F.lit(False).alias("zip")).union(wide.select("id", "n", F.col("kind") == "zip"))
    return edges, counts.groupBy("id").agg(F.sum("n").alias("n"), F.bool_or("zip").alias("side_by_side"))


def components(scratch, edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b), the component being the smallest node.

    Each node takes the smallest node that it or a neighbour points at, and
    then what that one points at, until nothing moves: ways shrink by halves,
    so the rounds grow with the logarithm of the longest.
    """
    both = scratch.write(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    at = scratch.write(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to")).select(F.col("a").alias("node"), "to"), f"{name}-0")
    step = 0
    while True:
        step += 1
        # a node's root takes the smallest root among the node's neighbours, and each node then its root's root
        near = both.join(at.select(F.col("node").alias("b"), F.col("to").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        seen = at.join(near.select(F.col("a").alias("node"), "near"), "node")
        hooks = seen.groupBy("to").agg(F.min("near").alias("low")).filter("low < to").select(F.col("to").alias("node"), "low")
        hooked = scratch.write(seen.join(hooks, "node", "left").select("node", F.least("to", "near", "low").alias("to"), F.col("to").alias("was")), f"{name}-{step}-hooked")
        jump = hooked.select(F.col("node").alias("to"), F.col("to").alias("next"))
        moved = scratch.write(hooked.join(jump, "to").select("node", F.col("next").alias("to"), "was"), f"{name}-{step}")
        at = moved.select("node", "to")
        if moved.filter("`to` != was").isEmpty():
            return at.select("node", F.col("to").alias("component"))
