"""Column functions on written cases, and properties."""

from __future__ import annotations

import datetime
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import dates, formula, identifiers, money, private, texts


def one(spark, *columns):
    row = spark.range(1).select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


@pytest.mark.parametrize(
    ("text", "value", "error"),
    [
        ("=1+2*3", 7.0, None), ("=-2^2", 4.0, None), ("=(1+2)*3%", 0.09, None), ("=1/0", None, "#DIV/0!"), ("=IFERROR(1/0, 5)", 5.0, None), ('="a"&1&TRUE', "a1TRUE", None),
        ("=ROUND(2.5,0)", 3.0, None), ("=ROUND(-2.5,0)", -3.0, None), ("=ROUND(1.005,2)", 1.01, None), ("=ROUNDUP(-1.1,0)", -2.0, None), ("=TRUNC(-1.9)", -1.0, None), ("=INT(-1.5)", -2.0, None),
        ("=MOD(7,-3)", -2.0, None), ("=MOD(1,0)", None, "#DIV/0!"), ('=VALUE("1,234.5")', 1234.5, None), ('=VALUE("x")', None, "#VALUE!"), ('=IF("a"="A", 1, 2)', 1.0, None), ("=1<\"a\"", True, None),
        ("=AND(TRUE, 1, NOT(FALSE))", True, None), ("=SUM(1,2,3)/COUNT(1,2,3)", 2.0, None), ("=MAX(1,5,3)-MIN(4,2)", 3.0, None), ('=CONCAT("a","b")', "ab", None), ("=NUMBERSTRING(1234,3)", "일이삼사", None), ("=NUMBERSTRING(138600,1)", "일십삼만팔천육백", None), ("=NUMBERSTRING(138600,2)", "壹拾參萬八阡六百", None), ("=NUMBERSTRING(123456789,2)", "壹億貳阡參百四拾伍萬六阡七百八拾九", None), ("=NUMBERSTRING(12.7,1)", "일십삼", None), ("=NUMBERSTRING(0.4,2)", "零", None),
        ("=NUMBERSTRING(-1,1)", None, "#NUM!"), ("=ROUND(1.5,)", 2.0, None), ("=_xlfn.CONCAT(1;2)", "12", None), ("=AVERAGE(1,2)", 1.5, None), ("=PRODUCT(2,3)", 6.0, None), ("=(0-8)^0.5", None, "#NUM!"), ("=COUNTA(1,\"\",#N/A)", 3.0, None),
    ],
)
def test_formula(spark, text, value, error):
    row = formula.with_formula(spark.range(1), "v", text).first()
    assert (row.v if not isinstance(value, float) or row.v is None else pytest.approx(row.v)) == value
    assert row.v_err == error


def test_formula_columns_and_refusals(spark):
    df = spark.createDataFrame([(2.0, "3,000", None), (None, "x", True)], "a double, `b c` string, t boolean")
    rows = formula.with_formula(df, "v", "=a+[b c]").collect()
    assert [(r.v, r.v_err) for r in rows] == [(3002.0, None), (None, "#VALUE!")]
    for bad in ("=VLOOKUP(a)", "=nothing+1", "=(a", "=a b", "=ROUND()"):
        with pytest.raises(formula.UnsupportedFormula):
            formula.with_formula(df, "v", bad)


def test_column_letters(spark):
    df = spark.range(0, 18278).select("id", formula.column_letters(F.col("id")).alias("l"))
    assert df.filter(formula.column_index(F.col("l")) != F.col("id")).count() == 0
    assert [r.l for r in df.filter("id IN (0, 25, 26, 701, 702)").orderBy("id").collect()] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_money(spark):
    df = spark.createDataFrame([("₩1,234원", 1234, None), ("-5", None, "sign"), ("1.5", None, "decimals"), ("abc", None, "not a number"), ("", None, "empty"), (None, None, "empty"), ("1" + "0" * 20, None, "too large")], "t string, v long, e string")
    for r in df.select("*", money.parse_amount(F.col("t")).alias("p")).collect():
        assert (r.p.value, r.p.error) == (r.v, r.e), r.t
    n = F.lit("123456789").cast("decimal(38,0)")
    assert one(spark, money.spell(n)) == "일억이천삼백사십오만육천칠백팔십구"
    assert one(spark, money.spell(F.lit(1100).cast("decimal(38,0)"), omit_one=True)) == "천백"
    assert one(spark, money.formal(F.lit(10).cast("decimal(38,0)"), hanja=True)) == "金 壹拾원整"
    assert one(spark, money.mixed(n)) == "1억 2,345만 6,789원"
    wide = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    assert one(spark, money.formal(wide(12345000))) == "일금 일천이백삼십사만오천원정 (₩12,345,000)" and one(spark, money.formal(wide(12345000), omit_one=True)) == "일금 천이백삼십사만오천원정 (₩12,345,000)"
    assert one(spark, money.formal(wide(12345000), hanja=True)) == "金 壹阡貳佰參拾肆萬伍阡원整" and one(spark, money.spell(wide(6789), hanja=True)) == "陸阡柒佰捌拾玖"
    assert [one(spark, money.spell(wide(x), omit_one=True)) for x in (10000, 10001, 110000, 100010000, 10**8, 10**16)] == ["만", "만일", "십일만", "일억만", "일억", "일경"]
    read = [("일억이천만", 120000000), ("천오백", 1500), ("만", 10000), ("십만", 100000), ("영", 0), ("0", 0), ("일금 일천이백삼십사만오천원정", 12345000), ("金 壹阡貳佰參拾肆萬伍阡원整", 12345000), ("일조 삼억", 1000300000000), ("3억 5천만", 350000000), ("1,234만 5,000원", 12345000), ("3천5백", 3500), ("12억", 1200000000), ("壹阡", 1000), ("일금 오천원정", 5000), ("일금 일천원정 (₩1,000)", 1000), ("9999경", 99990000000000000000)]
    wrong = [("십천", "order"), ("만억", "order"), ("억만", "order"), ("일억만", "order"), ("만경", "order"), ("이삼", "digits"), ("3 5만", "digits"), ("일억abc", "sign"), ("1.5억", "decimals"), ("원", "empty"), ("", "empty"), (None, "empty"), ("영천", "order"), ("일공", "digits"), ("10000경", "too large"), ("x", "sign")]
    df = spark.createDataFrame([(t, str(v), None) for t, v in read] + [(t, None, e) for t, e in wrong], "t string, v string, e string")
    for r in df.select("t", F.col("v").cast("decimal(38,0)").alias("v"), "e", money.parse_spelled(F.col("t")).alias("p")).collect():
        assert (r.p.value, r.p.error) == (r.v, r.e), r.t
    any_ = {r.t: r.p for r in spark.createDataFrame([("12,345,000",), ("3억 5천만",), ("12345원",), ("억만",)], "t string").select("t", money.parse_any(F.col("t")).alias("p")).collect()}
    assert [(int(p.value) if p.value is not None else None) for p in any_.values()] == [12345000, 350000000, 12345, None]
    numbers = spark.range(1, 20000).select((F.col("id") * F.col("id") * 7919 + 1).cast("decimal(38,0)").alias("n"))
    assert numbers.filter(money.parse_spelled(money.spell(F.col("n")))["value"] != F.col("n")).count() == 0
    assert numbers.filter(~money.parse_spelled(money.spell(F.col("n"), hanja=True))["value"].eqNullSafe(F.col("n"))).count() == 0
    small = numbers.filter("n < 100000000")
    assert small.count() > 100 and small.filter(~money.parse_spelled(money.spell(F.col("n"), omit_one=True))["value"].eqNullSafe(F.col("n"))).count() == 0
    assert numbers.filter(~money.parse_any(money.mixed(F.col("n")))["value"].eqNullSafe(F.col("n"))).count() == 0
    assert numbers.filter(~money.parse_any(money.formal(F.col("n")))["value"].eqNullSafe(F.col("n"))).count() == 0


def test_tax(spark):
    numbers = spark.range(0, 3000).select((F.col("id") * 10**14 + F.col("id") * 37).cast("decimal(38,0)").alias("n"))
    for mode in ("floor", "round", "ceil"):
        v = money.from_gross(F.col("n"), F.lit(1000), mode)
        assert numbers.filter(v["net"] + v["tax"] != F.col("n")).count() == 0
    big = F.lit("9999999999999999999999999").cast("decimal(38,0)")
    assert one(spark, money.divide(big, F.lit(10000))) == 999999999999999999999
    assert [one(spark, money.divide(F.lit(7), F.lit(2), m)) for m in ("floor", "round", "ceil")] == [3, 4, 4]
    assert one(spark, money.parse_rate(F.lit("3.3%"))) == 330 and one(spark, money.parse_rate(F.lit("101"))) is None
    assert one(spark, money.rate_label(F.lit(330))) == "3.3%" and one(spark, money.rate_label(F.lit(1000))) == "10%"
    assert one(spark, money.from_tax(F.lit(100), F.lit(1000))["differs"]) is False
    items = spark.createDataFrame([("2", "1,000"), ("x", "5"), ("", ""), ("3", "-1")], "qty string, price string")
    lines = money.item_lines(items)
    assert sorted((r.error, r.amount) for r in lines.collect() if r.error) == [("price", None), ("quantity", None)]
    assert tuple(money.item_total(lines, 1000).first()) == (1, 2000, 200, 2200, 2)


def test_identifiers(spark):
    row = spark.createDataFrame([("124-81-00998, 1301110006246\n220 81 62517",)], "t string")
    got = {r.number: (r.kind, r.valid) for r in identifiers.check_many(row, "t").collect()}
    assert got == {"1248100998": ("business", True), "1301110006246": ("corporate", True), "2208162517": ("business", True)}
    good = "1248100998"
    for k in range(10):
        for d in "0123456789":
            if d != good[k]:
                assert not identifiers_valid(good[:k] + d + good[k + 1 :])
    assert one(spark, identifiers.luhn(F.lit("4111111111111111"))) and not one(spark, identifiers.luhn(F.lit("4111111111111112")))
    assert one(spark, identifiers.check_number(F.lit("12"))["kind"]) is None


def identifiers_valid(text):
    total = sum(int(c) * w for c, w in zip(text, identifiers.BUSINESS_WEIGHTS, strict=False)) + int(text[8]) * 5 // 10
    return (10 - total % 10) % 10 == int(text[9])


def test_dates(spark):
    for text, day in (("2025-02-28", "2025-02-28"), ("2025.2.8", "2025-02-08"), ("20250228", "2025-02-28"), ("2025-02-30", None), ("x", None), ("2024/2/29", "2024-02-29")):
        assert one(spark, dates.parse_date(F.lit(text)).cast("string")) == day
    d = lambda s: F.lit(datetime.date.fromisoformat(s))
    assert tuple(one(spark, dates.add_months(d("2025-01-31"), F.lit(1)))) == (datetime.date(2025, 2, 28), True)
    assert tuple(one(spark, dates.ymd(d("2025-01-30"), d("2025-02-28")))) == (0, 1, 0)
    assert one(spark, dates.dday(d("2025-01-01"), d("2025-01-04"))) == "D+3"
    assert one(spark, dates.weekday(d("1970-01-01"))) == 4
    assert one(spark, dates.nth_day(d("2025-01-01"), F.lit(100))) == datetime.date(2025, 4, 10)
    held = dates.parse_holidays(spark.createDataFrame([("2025-05-05 Children # note\nnope\n\n# only",)], "t string"), "t").collect()
    assert [(r.line, r.name, r.error) for r in held] == [(1, "Children", None), (2, "", "not a date")]
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(k) for k in range(400)]
    off = dates.fixed_holidays(spark, 2024, 2025)
    assert tuple(one(spark, dates.between(d("2024-12-24"), d("2025-01-03"), dates.holiday_ranks(off)))) == (11, 9, 2, 2, 7, False)
    assert tuple(one(spark, dates.between(d("2030-01-03"), d("2030-01-01"), dates.holiday_ranks(off.limit(0)))))[3:] == (0, 3, True)
    off_days = {r.day for r in off.collect()}
    df = spark.createDataFrame([(a, n) for a in days[150:170] for n in (-12, -1, 0, 1, 9)], "a date, n int")
    for r in dates.add_business_days(df, "a", "n", off, "due").collect():
        x, left = r.a, abs(r.n)
        while left:
            x += datetime.timedelta(1 if r.n > 0 else -1)
            left -= x.weekday() < 5 and x not in off_days
        assert r.due == x, r


def test_texts(spark):
    c = one(spark, texts.counts(F.lit("가 b👍🏽\r\n\r\nx")))
    assert (c.graphemes, c.chars, c.hangul, c.words, c.lines, c.paragraphs) == (7, 10, 1, 3, 3, 2)
    assert one(spark, texts.counts(F.lit("")))["lines"] == 0
    assert one(spark, texts.newline(F.lit("a\r\nb\rc\n"), "crlf")) == "a\r\nb\r\nc\r\n"
    assert one(spark, texts.hashes(F.lit(""))["md5"]) == "d41d8cd98f00b204e9800998ecf8427e"
    assert one(spark, texts.parse_expected(F.lit("zz"))["error"]) == "not hexadecimal"
    assert one(spark, texts.manifest_line(F.lit("a\\b\nc"), F.lit("00"))) == "\\00  a\\\\b\\nc"
    assert tuple(one(spark, texts.split_name(F.lit(".bashrc")))) == (".bashrc", "") and tuple(one(spark, texts.split_name(F.lit("a.tar.gz")))) == ("a.tar", "gz")
    assert one(spark, texts.sanitize_name(F.lit("con.txt"))) == "_con.txt" and one(spark, texts.sanitize_name(F.lit("a<b>. "))) == "a_b_"
    assert one(spark, texts.decode_xml(texts.escape_xml(F.lit("<a&\"'>")))) == "<a&\"'>"
    assert one(spark, texts.wifi_payload(F.lit("a;b"), F.lit("p,w"))) == "WIFI:T:WPA;S:a\\;b;P:p\\,w;;"
    assert one(spark, texts.size_label(F.lit(1536))) == "1.5 KB"
    m = one(spark, texts.manuscript(F.lit("가" * 20 + "\n\n나")))
    assert (m.rows, m.pages) == (4, 1)
    names = spark.createDataFrame([("f10.txt",), ("f9.txt",), ("F9.TXT",), ("f9 (2).txt",)], "n string")
    assert [r.n for r in names.orderBy(texts.natural_key(F.col("n")), "n").collect()][-1] == "f10.txt"
    got = [r.new_name for r in texts.plan_renames(spark.createDataFrame([(1, "a.txt"), (2, "A.txt"), (3, "a (2).txt")], "k int, n string"), "n", [F.col("k")], "{name}").orderBy("k").collect()]
    assert len({g.lower() for g in got}) == 3
    with pytest.raises(ValueError):
        texts.fill_template("{what}", F.lit(""), F.lit(""), F.lit(1), F.lit(None), F.lit(None))


def test_redaction(spark):
    text = "a 900101-1234567 b 4111 1111 1111 1111 c 010-1234-5678 d xy@y.example.org e 4111111111111112 f 2024-01-02 g x@y.example.org h 1588.1234"
    assert one(spark, private.redact(F.lit(text))) == "a 900101-1****** b 4111 **** **** 1111 c 010-****-5678 d x*@y.example.org e 4111111111111112 f 2024-01-02 g *@y.example.org h 1588.****"
    assert [x.kind for x in one(spark, private.find_private(F.lit(text)))] == ["resident", "card", "phone", "email", "email", "phone"]
    assert one(spark, private.redact(F.lit("12-345-678901 M12345678 123-45-67890 2024-01-123456 0502-123-4567"), ("account", "passport"), "full")) == "**-***-****** ********* 123-45-67890 2024-01-123456 0502-123-4567"
    assert one(spark, private.redact(F.lit("12-345-678901 M123A5678"), ("account", "passport"))) == "12-***-****** M123*****"
    assert one(spark, private.redact(F.lit("ab.c@d-e.org"), mode="full")) == "****@***.***" and one(spark, private.redact(F.lit("ab@c.org 01012345678"), mode="tag")) == "[email] [phone]"
    assert one(spark, private.redact(F.lit(None).cast("string"))) is None and one(spark, private.redact(F.lit(""))) == ""
    for clean in ("900231-1234567", "034-123-4567 045-123-4567", "0101234567890123", "1-010-1234-5678", "x@y", "12.010-1234-5678", "010-1234-56789", "15881234"):
        assert one(spark, private.redact(F.lit(clean))) == clean, clean
    # the same digits within a longer run stay
    assert one(spark, private.redact(F.lit("010-1234-5678 and 9010-1234-5678"))) == "010-****-5678 and 9010-1234-5678"


def by_hand(text):
    """Telephone, card and resident numbers and addresses by plain scanning: candidates from each place on, longest first."""
    import calendar

    out, k = [], 0
    while k < len(text):
        for kind, n in [(kind, n) for kind in ("email", "resident", "card", "phone") for n in range(min(60, len(text) - k), 5, -1)]:
            piece, before, after = text[k : k + n], text[max(0, k - 2) : k], text[k + n : k + n + 2]
            digits = re.sub("[^0-9]", "", piece)
            marks = " -" if kind == "card" else ".-"
            inside = before[-1:].isdigit() or (before[1:] in marks and len(before) == 2 and before[0].isdigit()) or after[:1].isdigit() or (after[:1] in marks and len(after) == 2 and after[1].isdigit())
            luhn = sum(sum(divmod(2 * int(c), 10)) if j % 2 else int(c) for j, c in enumerate(reversed(digits))) % 10 == 0
            if kind == "resident":
                ok = re.fullmatch("[0-9]{6}[ -]?[1-8][0-9]{6}", piece) and not inside and 1 <= int(digits[2:4]) <= 12 and 1 <= int(digits[4:6]) <= calendar.monthrange(2000, int(digits[2:4]))[1]
            elif kind == "card":
                ok = re.fullmatch("[0-9]{4}([ -])[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}|[0-9]{13,19}", piece) and not inside and (not piece.isdigit() or piece[0] in "234569") and luhn
            elif kind == "phone":
                ok = re.fullmatch("01[016789]([ .-]?)[0-9]{3,4}\\1[0-9]{4}", piece) and not inside
            else:
                ok = re.fullmatch("[A-Za-z0-9_.%+-]+@([A-Za-z0-9-]+[.])+[A-Za-z]{2,}", piece) and not re.match("[A-Za-z0-9_.%+-]", before[-1:]) and not re.match("[A-Za-z0-9-]", after[:1])
            if ok:
                out.append((kind, k, text.count("\n", 0, k) + 1, piece))
                k += n - 1
                break
        k += 1
    return out


def test_findings_by_hand(spark):
    import random

    rnd = random.Random(4)
    digits = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    make = [lambda: f"010-{digits(4)}-{digits(4)}", lambda: f"011{digits(7)}", lambda: f"{digits(6)}-{rnd.randint(1, 9)}{digits(6)}", lambda: "4111 1111 1111 1111", lambda: "5500000000000004", lambda: f"{digits(4)}-{digits(4)}-{digits(4)}-{digits(4)}", lambda: f"j.d{digits(1)}@mail.ex-a.org", lambda: digits(rnd.randint(1, 20)), lambda: "word"]
    texts = ["".join(rnd.choice(make)() + rnd.choice([" ", ", ", "\n", ".", " x ", "-", ""]) for _ in range(rnd.randint(0, 8))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {k: [] for k in range(len(texts))}
    for r in private.findings(df).collect():
        got[r.k].append((r.kind, r["index"], r.line, r.found))
        assert r.length == len(r.found) and r.masked != r.found
    for k, t in enumerate(texts):
        assert sorted(got[k], key=lambda x: x[1]) == by_hand(t), t


def test_names_of_files(spark):
    assert texts.sheet_names(["a/b", "A_b", "", "'x'", "y" * 40, "y" * 40]) == ["a_b", "A_b (2)", "Sheet", "x", "y" * 31, "y" * 27 + " (2)"]
    assert one(spark, texts.part_file_name(F.lit("t"), F.lit(" a/b "), "csv")) == "t_a_b.csv" and one(spark, texts.part_file_name(F.lit("t"), F.lit(" "), "csv")) == "t_blank.csv"
    assert one(spark, texts.escape_rtf(F.lit("a{b}\\ é가👍\n"))) == "a\\{b\\}\\\\ \\u233?\\u-21504?\\u-10179?\\u-9139?\\line "
    assert one(spark, texts.page_label("{n} / {total}", F.lit(3), F.lit(10))) == "3 / 10"
    names = [(k, n) for k, n in enumerate(["a.txt", "A.txt", "a (2).txt", "a.txt", "a (2) (2).txt", "b.txt"])]
    got = [r.new_name for r in texts.plan_renames(spark.createDataFrame(names, "k int, n string"), "n", [F.col("k")], "{name}").orderBy("k").collect()]
    assert len({g.lower() for g in got}) == 6 and got[0] == "a.txt" and got[-1] == "b.txt"
    upper = texts.plan_renames(spark.createDataFrame(names, "k int, n string"), "n", [F.col("k")], "{n:2}-{name}", find="^A", replace="z", regex=True, flags="i").orderBy("k").collect()
    assert [r.new_name for r in upper][:2] == ["01-z.txt", "02-z.txt"]


def test_item_table_and_batches(spark):
    items = spark.createDataFrame([("pen", "2", "1,000"), ("x", "x", "5")], "item string, qty string, price string")
    rows = money.item_table(money.item_lines(items), 1000).orderBy("part", "item").collect()
    assert [(r.item, r.amount) for r in rows] == [("pen", "2,000"), ("x", "error: quantity"), ("net", "2,000"), ("tax", "200"), ("total", "2,200")]
    many = identifiers.check_many(spark.createDataFrame([("124.81.00998, 123-45-67890, =1",)], "t string"), "t")
    lines = {r.input: r.line for r in identifiers.batch_csv(many).collect()}
    assert lines["124.81.00998"] == "124.81.00998,124-81-00998,business,valid,8" and lines["=1"] == "'=1,,unknown,not a number,"
    assert "invalid" in lines["123-45-67890"]


def test_snapped(spark):
    import random

    rnd = random.Random(2)
    values = [rnd.choice([1, -1]) * rnd.random() * 10 ** rnd.randint(-18, 18) for _ in range(3000)] + [0.0, 1.005 * 100, 1e22, 1e300, 999.9999999999999, 1000.0, 0.1 + 0.2]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", formula.snapped(F.col("v")).alias("s"), formula.fifteen(F.col("v")).alias("f"))
    rows = df.collect()
    assert all(abs(r.s - r.f) <= 1.1e-14 * abs(r.f) for r in rows) and sum(r.s == r.f for r in rows) > 0.8 * len(rows)
    assert all(r.s == r.f for r in rows[-7:])
    for digits in range(-2, 7):
        x = df.select(*[F.signum("v") * F.floor(F.abs(F.col(c)) * 10.0**digits + 0.5) for c in ("s", "f")]).toDF("a", "b")
        assert x.filter("abs(a) < 1e13 AND a <> b").count() == 0
