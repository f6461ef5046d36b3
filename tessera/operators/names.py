"""Unique names: the first of equal names stays, the others take the first free number, in the order of the rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.scratch import Scratch

#: A number that a name got or might have got: from 2, without leading zeros.
NUMBERED = r" \(([2-9]|[1-9][0-9]{1,14})\)$"


def running(df: DataFrame, ws: Scratch, step: str, by: str, order: list[str], weight: Column, name: str) -> DataFrame:
    """``df`` with the running sum of ``weight`` among the rows of the same ``by``, in ``order``, as ``name``.

    Rows lie in range partitions of group and order, so a group of any size is
    spread over many; the sums of a group's earlier partitions are added.  The
    window's groups are those of a partition.
    """
    parted = ws.write(df.withColumn("_w", weight).repartitionByRange(by, *order).withColumn("_p", F.spark_partition_id()), step)
    earlier = Window.partitionBy(by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = parted.groupBy("_p", by).agg(F.sum("_w").alias("_s")).select("_p", by, F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"))
    own = F.sum("_w").over(Window.partitionBy("_p", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return parted.withColumn("_own", own).join(sums, ["_p", by]).withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_p", "_w", "_own", "_before")


def _fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Which numbers of each family are passed over, from rows sorted by family and number; the state goes from frame to frame."""
    family, passed = None, 0
    for frame in frames:
        at, over = [], []
        for own, k, taken, before in zip(frame["parent"], frame["k"], frame["displaced"], frame["members"], strict=True):
            if own != family:
                family, passed = own, 0
            # the member of this rank would come to number k; it passes over it where the name itself came first
            rank = k - taken - passed
            at.append(rank)
            over.append(rank > before)
            passed += rank > before
        yield frame.assign(rank=pd.Series(at, dtype="int64", index=frame.index), over=pd.Series(over, dtype=bool, index=frame.index))[["key", "parent", "rank", "over"]]


def unique_names(df: DataFrame, stem: Column, tail: Column, row: str, out: str) -> DataFrame:
    """``df`` with ``out``: stem and tail, with " (2)", " (3)" ... between them where the name is taken, without regard to case.

    The result is that of going through the rows in the order of ``row`` (unique
    numbers) and giving each the first name not in use.  Names that are equal are
    a family; its k-th candidate is also the first name of another family, the
    child, where the rows hold one.  Whether the child or a member comes first
    follows from the child's first row and the members before it, so a family's
    numbers are ranks moved by the children that came first.  Ranks come from
    range partitions, and one task reads of a family only its distinct children.
    Families are settled by how many numbers their names end with, one step for
    each such depth in the data.  Null parts count as empty.
    """
    ws = Scratch(df.sparkSession, "names")
    parts = ws.write(df.withColumns({"_stem": F.coalesce(stem, F.lit("")), "_tail": F.coalesce(tail, F.lit(""))}), "parts")
    low, end = F.lower("_stem"), F.concat(F.lit("\0"), F.lower("_tail"))
    members = parts.select(F.concat(low, end).alias("key"), F.col(row).alias("_row"), F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("child"))
    families = members.groupBy("key").agg(F.min("_row").alias("_row"))
    own, rest = F.split_part("key", F.lit("\0"), F.lit(1)), F.split_part("key", F.lit("\0"), F.lit(2))
    k = F.nullif(F.regexp_extract(own, NUMBERED, 1), F.lit(""))
    depth = F.regexp_count(F.regexp_extract(own, r"((?: \((?:[2-9]|[1-9][0-9]{1,14})\))+)$", 1), F.lit(r"\("))
    children = families.filter(k.isNotNull()).withColumns({"parent": F.concat(F.regexp_replace(own, NUMBERED, ""), F.lit("\0"), rest), "k": k.cast("long"), "depth": depth})
    children = ws.write(children.join(families.select(F.col("key").alias("parent")), "parent", "left_semi"), "children")
    marks = children.select(F.col("parent").alias("key"), "_row", F.lit(0).alias("_kind"), F.col("key").alias("child"))
    ranked = ws.write(running(members.unionByName(marks), ws, "order", "key", ["_row", "_kind"], F.col("_kind"), "_rank"), "ranked")
    children = children.join(ranked.filter("_kind = 0").select(F.col("child").alias("key"), F.col("_rank").alias("members")), "key")
    settled = None
    for level in [r.depth for r in children.select("depth").distinct().orderBy("depth").collect()]:
        step = children.filter(F.col("depth") == level)
        if settled is None:
            step = step.withColumn("displaced", F.lit(0))
        else:
            step = step.join(settled.filter("NOT over").select(F.col("key").alias("parent"), F.lit(1).alias("_gone")), "parent", "left").withColumn("displaced", F.coalesce("_gone", F.lit(0)))
        step = step.select("key", "parent", "k", "displaced", "members").repartition("parent").sortWithinPartitions("parent", "k")
        step = ws.write(step.mapInPandas(_fold, "key string, parent string, rank long, over boolean"), f"settled{level}")
        settled = step if settled is None else settled.unionByName(step)
    places = ranked.filter("_kind = 1").select("key", "_rank", F.lit(1).alias("_kind"), "_row")
    if settled is not None:
        none = F.lit(None).cast("long").alias("_row")
        places = places.unionByName(settled.filter("over").select(F.col("parent").alias("key"), F.col("rank").alias("_rank"), F.lit(0).alias("_kind"), none))
        places = places.unionByName(settled.filter("NOT over").select("key", F.lit(0).cast("long").alias("_rank"), F.lit(0).alias("_kind"), none))
    number = running(places, ws, "places", "key", ["_rank", "_kind", "_row"], F.lit(1), "_number").filter("_kind = 1").select(F.col("_row").alias(row), "_number")
    named = F.when(F.col("_number") > 1, F.concat("_stem", F.lit(" ("), F.col("_number").cast("string"), F.lit(")"), "_tail")).otherwise(F.concat("_stem", "_tail"))
    return parts.join(number, row).withColumn(out, named).drop("_number", "_stem", "_tail")
