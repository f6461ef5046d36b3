"""Calendar and business-day arithmetic on DATE columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Korean holidays of the solar calendar.
FIXED_HOLIDAYS = ((1, 1, "New Year"), (3, 1, "Independence Movement Day"), (5, 5, "Children's Day"), (6, 6, "Memorial Day"), (8, 15, "Liberation Day"), (10, 3, "National Foundation Day"), (10, 9, "Hangul Day"), (12, 25, "Christmas Day"))


def parse_date(text: Column) -> Column:
    """A DATE from year, month and day split by - . / or a blank, or eight digits; null if there is no such day."""
    bare = F.regexp_replace(F.trim(text), r"[.]$", "")
    parts = F.when(bare.rlike(r"^\d{8}$"), F.array(F.substring(bare, 1, 4), F.substring(bare, 5, 2), F.substring(bare, 7, 2))).when(bare.rlike(r"^\d{1,4}([-./ ]\s*)\d{1,2}([-./ ]\s*)\d{1,2}$"), F.split(bare, r"[-./ ]\s*"))
    iso = F.concat_ws("-", F.lpad(parts[0], 4, "0"), F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))
    return F.when(parts.isNotNull() & (parts[0].cast("int") >= 1), F.try_to_date(iso, "yyyy-MM-dd"))


def weekday(d: Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(d) - 1


def is_weekend(d: Column) -> Column:
    return weekday(d).isin(0, 6)


def is_leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def days_in_month(d: Column) -> Column:
    return F.dayofmonth(F.last_day(d))


def with_weekday(d: Column) -> Column:
    """2025-03-01 (Sat)."""
    return F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" ("), F.element_at(F.array(*map(F.lit, ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"))), F.dayofweek(d)), F.lit(")"))


def dday(target: Column, today: Column) -> Column:
    """D-Day, D-3 before and D+3 after."""
    n = F.datediff(target, today)
    return F.when(n == 0, F.lit("D-Day")).when(n > 0, F.concat(F.lit("D-"), n.cast("string"))).otherwise(F.concat(F.lit("D+"), (-n).cast("string")))


def elapsed(start: Column, end: Column, inclusive: bool = False) -> Column:
    return F.datediff(end, start) + int(inclusive)


def nth_day(start: Column, n: Column) -> Column:
    """The n-th day counting the start as the first."""
    return F.date_add(start, (n - 1).cast("int"))


def add_months(d: Column, n: Column) -> Column:
    """STRUCT<date, clamped>: the day is cut to the month's last, and ``clamped`` says so."""
    out = F.add_months(d, n.cast("int"))
    return F.struct(out.alias("date"), (F.dayofmonth(out) != F.dayofmonth(d)).alias("clamped"))


def shift(d: Column, n: Column, unit: str) -> Column:
    """``d`` moved by n days, weeks, months or years."""
    if unit in ("day", "week"):
        return F.date_add(d, (n * (7 if unit == "week" else 1)).cast("int"))
    if unit in ("month", "year"):
        return F.add_months(d, (n * (12 if unit == "year" else 1)).cast("int"))
    raise ValueError(f"no unit {unit!r}; business days are added by add_business_days")


def ymd(a: Column, b: Column) -> Column:
    """STRUCT<years, months, days> from a to a later b: the most whole months that do not pass b, and the days left."""
    guess = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    months = F.when(F.add_months(a, guess) > b, guess - 1).otherwise(guess)
    return F.struct(F.floor(months / 12).cast("int").alias("years"), (months % 12).cast("int").alias("months"), F.datediff(b, F.add_months(a, months)).alias("days"))


def weekdays_before(d: Column) -> Column:
    """How many Mondays to Fridays lie in [1970-01-05, d): a linear function and the day of the week."""
    n = F.unix_date(d) - 4
    week = F.floor(n / 7)
    return (week * 5 + F.least(n - week * 7, F.lit(5))).cast("long")


def parse_holidays(df: DataFrame, column: str) -> DataFrame:
    """Rows (line, day, name, error) of holiday lists: a date and a name on each line, # starts a comment."""
    lines = df.select(F.posexplode(F.split(column, r"\r?\n")).alias("line", "raw"))
    bare = F.trim(F.regexp_replace("raw", "#.*$", ""))
    first = F.regexp_extract(bare, r"^([0-9][0-9./-]*)\s*(.*)$", 1)
    lines = lines.withColumn("bare", bare).filter("bare <> ''")
    day = parse_date(first)
    return lines.select((F.col("line") + 1).alias("line"), day.alias("day"), F.regexp_extract(bare, r"^([0-9][0-9./-]*)\s*(.*)$", 2).alias("name"), F.when(day.isNull(), F.lit("not a date")).alias("error"))


def fixed_holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(day, name) of the fixed holidays of the years, as a small dimension."""
    years = spark.range(first_year, last_year + 1).withColumnRenamed("id", "year")
    listed = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(d).alias("d"), F.lit(n).alias("name")) for m, d, n in FIXED_HOLIDAYS])
    return years.select("year", F.inline(listed)).select(F.make_date("year", "m", "d").alias("day"), "name")


def holiday_ranks(holidays: DataFrame) -> Callable[[Column], Column]:
    """A function of dates: how many of the distinct week-day holidays lie before one.

    Holiday lists are small (some tens a year).  Their running counts, a number
    for each day from the first to the last of them, go with the plan as one
    literal, so a row costs one look-up.
    """
    days = sorted(r.d for r in holidays.filter("day IS NOT NULL").filter(~is_weekend(F.col("day"))).select(F.unix_date("day").alias("d")).distinct().collect())
    if not days:
        return lambda d: F.lit(0).cast("long")
    first, last = days[0], days[-1]
    counts = F.lit(np.searchsorted(np.array(days), np.arange(first, last + 2), "left").astype(np.int32))
    return lambda d: F.get(counts, F.greatest(F.least(F.unix_date(d), F.lit(last + 1)), F.lit(first)) - first).cast("long")


def between(a: Column, b: Column, holidays: Callable[[Column], Column], include_start: bool = True, include_end: bool = True) -> Column:
    """STRUCT<days, weekdays, weekends, holidays, business, reversed> of the span from a to b.

    ``holidays`` counts the week days off before a date (``holiday_ranks``).
    Counts come from closed forms, so the cost does not grow with the span.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    first = lo if include_start else F.date_add(lo, 1)
    after = F.date_add(hi, 1) if include_end else hi
    days = F.greatest(F.datediff(after, first), F.lit(0)).cast("long")
    week = F.when(days > 0, weekdays_before(after) - weekdays_before(first)).otherwise(F.lit(0).cast("long"))
    off = F.when(days > 0, holidays(after) - holidays(first)).otherwise(F.lit(0).cast("long"))
    return F.struct(days.alias("days"), week.alias("weekdays"), (days - week).alias("weekends"), off.alias("holidays"), (week - off).alias("business"), (a > b).alias("reversed"))


def add_business_days(df: DataFrame, start: str, n: str, holidays: DataFrame, out: str, last_year: int = 2200) -> DataFrame:
    """``df`` with the date n business days after (or before) ``start``; the start does not count.

    A calendar of business days numbers them; the date found is the one whose
    number is n on.  Both joins are equi-joins on the calendar.  Null outside
    the calendar's years 1900 to ``last_year``.
    """
    spark = df.sparkSession
    first, last = -25567, int(spark.range(1).select(F.unix_date(F.make_date(F.lit(last_year), F.lit(12), F.lit(31))).alias("d")).first().d)
    days = spark.range(first, last + 1).select(F.date_from_unix_date(F.col("id").cast("int")).alias("day"))
    business = days.filter(~is_weekend(F.col("day"))).join(F.broadcast(holidays.select("day").distinct()), "day", "left_anti")
    # the number of a business day: week days before it less the holidays before it
    off = holiday_ranks(holidays)

    def rank(d: Column) -> Column:
        return weekdays_before(d) - off(d)

    numbered = business.select(F.col("day").alias(out), rank(F.col("day")).alias("_rank"))
    # counted from the last business day on or before the start (forward), the first on or after it (backward)
    target = F.when(F.col(n) >= 0, rank(F.date_add(F.col(start), 1)) - 1 + F.col(n)).otherwise(rank(F.col(start)) + F.col(n))
    moved = df.withColumn("_rank", F.when(F.col(n) != 0, target)).join(F.broadcast(numbered), "_rank", "left")
    return moved.withColumn(out, F.when(F.col(n) == 0, F.col(start)).otherwise(F.col(out))).drop("_rank")
