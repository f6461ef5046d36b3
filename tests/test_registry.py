"""Every registered query outside the llm subpackage against its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(row):
    return tuple(str(x) if isinstance(x, (float, decimal.Decimal, datetime.date, bool)) else x for x in row)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, con):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(plain, df.select(*columns).collect()), key=repr)
    if name in registry.oracle_sql():
        want = con.sql(registry.oracle_sql()[name])
        assert sorted(want.columns) == columns
        assert got == sorted(map(plain, want.select(", ".join(columns)).fetchall()), key=repr)
    else:
        assert got


@pytest.mark.parametrize("name", ["markdown_parts", "spelled_amounts"])
def test_long_work_is_dealt_out(name, spark):
    """The table is one row group, so one task's where its rows are not dealt out."""
    assert registry.queries()[name](spark, SF).groupBy(F.spark_partition_id()).count().count() == 4


@pytest.mark.parametrize("name", ["found_tables", "html_paragraphs", "markdown_paragraphs", "markdown_parts"])
def test_blocks_are_found_once(name, spark):
    """Exploding a deterministic function's array filters by it below, so that it ran twice."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
