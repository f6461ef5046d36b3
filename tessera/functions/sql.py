"""SQL functions of the library for spark.sql: scalars and tables written in SQL, which the optimizer puts into the plan in place of their calls."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessera.functions.identifiers import BUSINESS_WEIGHTS

WEIGHED = " + ".join(f"CAST(substr(digits, {k + 1}, 1) AS INT) * {w}" for k, w in enumerate(BUSINESS_WEIGHTS))

#: (name and parameters, what is returned, body): whole amounts below 10^20, rates in basis points.
SCALARS = (
    ("whole_div(n DECIMAL(38,0), d DECIMAL(38,0))", "DECIMAL(38,0)", "CAST((n - n % d) / d AS DECIMAL(38,0))"),
    ("nearest_div(n DECIMAL(38,0), d DECIMAL(38,0))", "DECIMAL(38,0)", "CAST(whole_div(n, d) + CASE WHEN n % d >= d - n % d THEN 1 ELSE 0 END AS DECIMAL(38,0))"),
    ("net_of_gross(gross DECIMAL(38,0), bp INT)", "DECIMAL(38,0)", "nearest_div(CAST(gross * 10000 AS DECIMAL(38,0)), CAST(bp + 10000 AS DECIMAL(38,0)))"),
    ("tax_of_net(net DECIMAL(38,0), bp INT)", "DECIMAL(38,0)", "whole_div(CAST(net * bp AS DECIMAL(38,0)), CAST(10000 AS DECIMAL(38,0)))"),
    ("business_digit(digits STRING)", "INT", f"CAST((10 - ({WEIGHED} + CAST(floor(CAST(substr(digits, 9, 1) AS INT) * 5 / 10) AS INT)) % 10) % 10 AS INT)"),
    ("is_business_number(number STRING)", "BOOLEAN", r"coalesce(regexp_replace(trim(number), r'[\s.-]', '') RLIKE '^[0-9]{10}$' AND business_digit(regexp_replace(number, '[^0-9]', '')) = CAST(right(regexp_replace(number, '[^0-9]', ''), 1) AS INT), false)"),
    ("guarded(cell STRING)", "STRING", r"CASE WHEN cell RLIKE r'^[=+\-@\t\r]' AND NOT cell RLIKE r'^[+-]?([0-9]+(,[0-9]{3})*\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?%?$' THEN concat('''', cell) ELSE cell END"),
)
TABLES = (
    # the months after the start, each counted from it, so that an end of a month stays one; the first instalments carry what does not divide
    ("instalments(amount BIGINT, start DATE, n INT)", "TABLE(k INT, due DATE, part BIGINT)", "SELECT k, add_months(start, k), (amount - pmod(amount, n)) DIV n + CASE WHEN k <= pmod(amount, n) THEN 1 ELSE 0 END FROM (SELECT explode(CASE WHEN n >= 1 THEN sequence(1, n) END) AS k)"),
    ("words_of(text STRING)", "TABLE(place INT, word STRING)", r"SELECT pos, col FROM (SELECT posexplode(filter(split(text, r'[\x20\x09-\x0D]+'), w -> w <> '')))"),
)


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session, as temporary ones; returns their names.

    Scalars: nulls give null, but is_business_number is false and guarded keeps
    them.  Tables are for LATERAL; null arguments give no rows.
    """
    for head, kind, body in (*SCALARS, *TABLES):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return [head.split("(")[0] for head, _, _ in (*SCALARS, *TABLES)]
