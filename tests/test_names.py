"""Unique names against a walk through the rows; the comparison of lines against tables of lengths."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessera.functions import texts
from tessera.operators import names, textdiff


def by_hand(rows):
    taken, out = set(), []
    for stem, tail in rows:
        name, k = stem + tail, 1
        while name.lower() in taken:
            k += 1
            name = f"{stem} ({k}){tail}"
        taken.add(name.lower())
        out.append(name)
    return out


def test_unique_names_equal_a_walk(spark):
    r = random.Random(5)
    for _ in range(4):
        stems = ["a", "A", "b", "a (2)", "a (3)", "A (2)", "a (2) (2)", "a (2) (3)", "a (2) (2) (2)", "a (02)", "a (1)", "b (4)", "b (5)", "", " (2)"]
        r.shuffle(stems)
        rows = [(r.choice(stems[: r.randrange(3, 16)]), r.choice([".t", ".t", ".T", ""])) for _ in range(150)]
        df = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "k long, stem string, tail string")
        got = names.unique_names(df, F.col("stem"), F.col("tail"), "k", "name").orderBy("k").collect()
        assert [x.name for x in got] == by_hand(rows)


def test_unique_names_of_one_large_family(spark):
    df = spark.range(200_000).select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("x ("), (F.col("id") + 2).cast("string"), F.lit(")"))).otherwise(F.lit("x")).alias("stem"))
    got = names.unique_names(df, F.col("stem"), F.lit(".csv"), "id", "name")
    assert got.select(F.lower("name")).distinct().count() == 200_000
    rows = [(x.stem, ".csv") for x in df.orderBy("id").limit(600).collect()]
    assert [x.name for x in got.orderBy("id").limit(600).collect()] == by_hand(rows)


def test_unique_names_of_odd_rows(spark):
    empty = spark.createDataFrame([], "k long, stem string")
    assert names.unique_names(empty, F.col("stem"), F.lit(None).cast("string"), "k", "name").collect() == []
    nulls = spark.createDataFrame([(1, None, "x"), (2, "", "y")], "k long, stem string, name string")
    assert [r.name for r in names.unique_names(nulls, F.col("stem"), F.lit(""), "k", "name").orderBy("k").collect()] == ["", " (2)"]
    files = spark.createDataFrame([(1, "a (2).txt"), (2, "a.txt"), (3, "A.TXT")], "k long, n string")
    assert [r.new_name for r in texts.plan_renames(files, "n", [F.col("k")], "{name}").orderBy("k").collect()] == ["a (2).txt", "a.txt", "A (3).TXT"]
    assert texts.sheet_names(["history", "' x '", "a\tb"]) == ["History_", "x", "a_b"]


def test_common_length_is_that_of_the_script():
    r = random.Random(2)
    for _ in range(2000):
        a, b = ("".join(r.choice("abcd") for _ in range(r.randrange(80))) for _ in range(2))
        script = textdiff.edit_script(list(a), list(b))
        assert textdiff.common_length(list(a), list(b)) == sum(op == "same" for op, _, _ in script)
    assert textdiff.parts_of("abcdefgh", "abxdefgh")[1] == [{"text": "ab", "changed": False}, {"text": "x", "changed": True}, {"text": "defgh", "changed": False}]
    assert textdiff.parts_of("abcdefgh", "zyxwvuts") is None and textdiff.graphemes("a\r\nb") == ["a", "\r\n", "b"]


def test_renamed_files_cut_numbers_as_their_sql_does(spark, tmp_path):
    import duckdb

    from tessera.plans import registry

    rows = spark.range(1, 100_012).select(F.col("id").alias("p_partkey"), F.concat(F.lit("Brand#"), (F.col("id") % 3).cast("string")).alias("p_brand"))
    rows.write.parquet(f"{tmp_path}/part.parquet")
    got = registry.queries()["renamed_files"](spark, str(tmp_path)).filter("p_partkey > 99990").collect()
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
        want = con.execute(f"SELECT p_partkey, new_name FROM ({registry.oracle_sql()['renamed_files']}) WHERE p_partkey > 99990").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
