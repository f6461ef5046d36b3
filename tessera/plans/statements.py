"""Queries written in spark.sql alone, with the library's SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.functions import sql
from tessera.plans.registry import query, read


@query("""
WITH g AS (SELECT l_returnflag, CAST(round(l_extendedprice * 100) AS HUGEINT) AS gross FROM lineitem), v AS (SELECT *, (2 * gross * 10000 + 11000) // 22000 AS net FROM g)
SELECT l_returnflag, CAST(sum(net) AS DECIMAL(38,0)) AS net, CAST(sum(gross - net) AS DECIMAL(38,0)) AS tax, CAST(sum(net * 1000 // 10000) AS DECIMAL(38,0)) AS again FROM v GROUP BY l_returnflag
""")
def sql_taxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    return spark.sql("""
        SELECT l_returnflag, CAST(sum(net) AS DECIMAL(38,0)) AS net, CAST(sum(gross - net) AS DECIMAL(38,0)) AS tax, CAST(sum(tax_of_net(net, 1000)) AS DECIMAL(38,0)) AS again
        FROM (SELECT *, net_of_gross(gross, 1000) AS net FROM (SELECT l_returnflag, CAST(round(l_extendedprice * 100) AS DECIMAL(38,0)) AS gross FROM {lines})) GROUP BY l_returnflag
    """, lines=read(spark, sf_dir, "lineitem"))  # fmt: skip


@query("""
WITH o AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, CAST(o_orderdate AS DATE) AS day, CAST(1 + o_orderkey % 6 AS INT) AS n FROM orders)
SELECT o_orderkey, k, CAST(day + to_months(k) AS DATE) AS due, cents // n + CASE WHEN k <= cents % n THEN 1 ELSE 0 END AS part FROM o, (SELECT CAST(unnest(range(1, 7)) AS INT) AS k) WHERE k <= n
""")
def sql_instalments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order paid in one to six monthly parts that sum up to it."""
    sql.register(spark)
    return spark.sql("""
        SELECT o_orderkey, k, due, part FROM {orders}, LATERAL instalments(CAST(round(o_totalprice * 100) AS BIGINT), CAST(o_orderdate AS DATE), CAST(1 + o_orderkey % 6 AS INT))
    """, orders=read(spark, sf_dir, "orders"))  # fmt: skip
