"""SQL functions against the column expressions of the same name and plain Python."""

from __future__ import annotations

import random
from decimal import Decimal

from pyspark.sql import functions as F

from tessera.functions import identifiers, money, sql
from tessera.operators import tables


def test_scalars_equal_columns(spark):
    assert len(sql.register(spark)) == len(sql.SCALARS) + len(sql.TABLES)
    r = random.Random(4)
    rows = [(Decimal(r.choice([r.randrange(100), r.randrange(10**14), 10**19 + r.randrange(10**6)])), r.randrange(10001), "".join(r.choice("0123456789") for _ in range(r.choice([9, 10, 10, 10])))) for _ in range(500)]
    rows += [(None, None, None), (Decimal(0), 0, "123-45-6789 1"), (Decimal(5), 1000, "220-81-62517"), (Decimal(5), 1000, "x2208162517")]
    df = spark.createDataFrame(rows, "n decimal(38,0), bp int, text string")
    both = df.select(
        F.expr("net_of_gross(n, bp)").alias("a"), money.from_gross(F.col("n"), F.col("bp"))["net"].alias("b"), F.expr("tax_of_net(n, bp)").alias("c"), money.from_net(F.col("n"), F.col("bp"))["tax"].alias("d"),
        F.expr("is_business_number(text)").alias("e"), F.coalesce((identifiers.check_number(F.col("text"))["kind"] == "business") & identifiers.check_number(F.col("text"))["valid"], F.lit(False)).alias("f"),
    )
    got = both.collect()
    assert all(x.a == x.b and x.c == x.d and x.e == x.f for x in got) and got[502].e and not got[503].e
    cells = spark.createDataFrame([("=1+1",), ("-5",), ("+82 10",), ("@x",), ("",), (None,), ("-1,000.5%",)], "c string")
    assert all(x.a == x.b for x in cells.select(F.expr("guarded(c)").alias("a"), tables.guard(F.col("c")).alias("b")).collect())


def test_tables(spark):
    sql.register(spark)
    got = spark.sql("SELECT n, k, due, part FROM VALUES (100L, 3), (-7L, 2), (5L, 0), (NULL, 2), (9L, NULL) v(amount, n), LATERAL instalments(amount, DATE'2024-01-31', n) WHERE amount IS NOT NULL ORDER BY n, k").collect()
    assert [(x.n, x.k, str(x.due), x.part) for x in got] == [(2, 1, "2024-02-29", -3), (2, 2, "2024-03-31", -4), (3, 1, "2024-02-29", 34), (3, 2, "2024-03-31", 33), (3, 3, "2024-04-30", 33)]
    words = spark.sql("SELECT k, place, word FROM VALUES (1, ' a  b\tc '), (2, ''), (3, NULL) v(k, t), LATERAL words_of(t) ORDER BY k, place").collect()
    assert [(x.k, x.word) for x in words] == [(1, "a"), (1, "b"), (1, "c")]
    plan = spark.sql("SELECT net_of_gross(100, 1000) FROM range(3)")._jdf.queryExecution().toString()
    assert "Python" not in plan
