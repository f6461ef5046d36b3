"""Check digits of Korean business and corporate numbers, and payment cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the published numbering rules.
BUSINESS_WEIGHTS = (1, 3, 7, 1, 3, 7, 1, 3, 5)
CORPORATE_WEIGHTS = (1, 2, 1, 2, 1, 2, 1, 2, 1, 2, 1, 2)
#: Digits five and six of a corporate number and the kind of company they name.
CORPORATE_TYPES = {"11": "stock company", "12": "general partnership", "13": "limited partnership", "14": "limited company"}


def digit(text: Column, k: int) -> Column:
    """The k-th digit (from 0) as a number."""
    return F.substring(text, k + 1, 1).cast("int")


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def business_check_digit(digits: Column) -> Column:
    """The tenth digit that the first nine ask for; the ninth counts its tens too."""
    total = sum((digit(digits, k) * w for k, w in enumerate(BUSINESS_WEIGHTS)), F.lit(0)) + F.floor(digit(digits, 8) * 5 / 10)
    return ((10 - total % 10) % 10).cast("int")


def corporate_check_digit(digits: Column) -> Column:
    """The thirteenth digit that the first twelve ask for."""
    total = sum((digit(digits, k) * w for k, w in enumerate(CORPORATE_WEIGHTS)), F.lit(0))
    return ((10 - total % 10) % 10).cast("int")


def business_type(digits: Column) -> Column:
    """The class that digits four and five name."""
    code = F.substring(digits, 4, 2).cast("int")
    return (
        F.when(code.between(1, 79), "individual, taxable")
        .when(code == 80, "individual, other")
        .when(code.isin(81, 86, 87, 88), "corporation, profit")
        .when(code == 82, "corporation, non-profit")
        .when(code == 83, "state or local body")
        .when(code == 84, "foreign corporation")
        .when(code == 85, "corporation, branch")
        .when(code == 89, "body without legal form")
        .when(code.between(90, 99), "individual, tax-free")
    )


def corporate_type(digits: Column) -> Column:
    """The kind of company that digits five and six name, null for others."""
    code, found = F.substring(digits, 5, 2), F.lit(None).cast("string")
    for k, name in CORPORATE_TYPES.items():
        found = F.when(code == k, name).otherwise(found)
    return found


def check_number(text: Column) -> Column:
    """STRUCT<kind, number, formatted, expected, valid, type> of a number of 10 or 13 digits; kind null otherwise."""
    d = digits_only(text)
    bare = F.regexp_replace(F.trim(text), r"[\s.-]", "").rlike("^[0-9]+$")
    ten, thirteen = bare & (F.length(d) == 10), bare & (F.length(d) == 13)
    expected = F.when(ten, business_check_digit(d)).when(thirteen, corporate_check_digit(d))
    shown = F.when(ten, F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 2), F.substring(d, 6, 5))).when(thirteen, F.concat_ws("-", F.substring(d, 1, 6), F.substring(d, 7, 7)))
    return F.struct(
        F.when(ten, "business").when(thirteen, "corporate").alias("kind"), d.alias("number"), shown.alias("formatted"), expected.alias("expected"),
        F.coalesce(expected == F.right(d, F.lit(1)).cast("int"), F.lit(False)).alias("valid"), F.when(ten, business_type(d)).when(thirteen, corporate_type(d)).alias("type"),
    )


def split_numbers(text: Column) -> Column:
    """The numbers of a pasted list: lines, commas and semicolons split; blanks only where a line's digits are not 10 or 13."""
    pieces = F.split(text, r"[\n\r,;]+")
    parts = F.transform(pieces, lambda p: F.when(F.length(digits_only(p)).isin(10, 13), F.array(F.trim(p))).otherwise(F.split(F.trim(p), r"\s+")))
    return F.filter(F.flatten(parts), lambda x: x != "")


def check_many(df: DataFrame, column: str) -> DataFrame:
    """One row for each number of the lists in ``column``, with the verdict's fields."""
    return df.withColumn("input", F.explode(split_numbers(F.col(column)))).withColumn("verdict", check_number(F.col("input"))).select(*df.columns, "input", "verdict.*")


def batch_csv(checked: DataFrame) -> DataFrame:
    """The verdicts of ``check_many`` as guarded CSV lines (input, line), those of formula-like input with a ' in front."""
    from tessera.operators.tables import csv_line

    shown = checked.withColumns({"kind": F.coalesce("kind", F.lit("unknown")), "verdict": F.when(F.col("kind").isNull(), "not a number").when(F.col("valid"), "valid").otherwise("invalid"), "expected": F.col("expected").cast("string")})
    return shown.select("input", csv_line(shown, ["input", "formatted", "kind", "verdict", "expected"], numbers_pass=False).alias("line"))


def totals(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count("*").alias("numbers"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))


def luhn(digits: Column) -> Column:
    """True if the digits satisfy the Luhn check."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda c, k: F.when(k % 2 == 1, F.floor(c.cast("int") * 2 / 10) + c.cast("int") * 2 % 10).otherwise(c.cast("int")).cast("int"))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0
