"""Whole amounts of money: parsing, Korean spelling, value added tax."""

import decimal
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numerals and units of Korean numbers.
HANGUL = "영일이삼사오육칠팔구"
HANJA = "零壹貳參肆伍陸柒捌玖"
#: Those that spreadsheets spell with, which are formal for some numerals only.
SHEET_HANJA = "零壹貳參四伍六七八九"
SMALL = {False: ("", "십", "백", "천"), True: ("", "拾", "佰", "阡")}
SHEET_SMALL = ("", "拾", "百", "阡")
LARGE = {False: ("", "만", "억", "조", "경"), True: ("", "萬", "億", "兆", "京")}
LIMIT = 10**20
WIDE = "decimal(38,0)"


#: What stands before and after the digits: signs and names of the currency, and the mark of a whole amount.
BEFORE, AFTER = ("₩", "￦", "\\", "KRW"), ("원", "KRW", "원정")


def parse_amount(text: Column) -> Column:
    """STRUCT<value DECIMAL(38,0), error STRING> of an amount as people write it: currency sign, commas, trailing unit."""
    before, after = ("|".join(map(re.escape, sorted(marks, key=len, reverse=True))) for marks in (BEFORE, AFTER))
    bare = F.regexp_replace(F.regexp_replace(text, r"[,\s]", ""), f"^(?:{before})|(?:{after})$", "")
    value = F.when(bare.rlike("^[0-9]{1,38}$"), bare.try_cast(WIDE))
    error = (
        F.when(text.isNull() | (bare == ""), F.lit("empty"))
        .when(bare.rlike("^[-+]"), F.lit("sign"))
        .when(bare.rlike(r"^[0-9]*\.[0-9]+$"), F.lit("decimals"))
        .when(~bare.rlike("^[0-9]+$"), F.lit("not a number"))
        .when(value.isNull() | (value >= F.lit(str(LIMIT)).cast(WIDE)), F.lit("too large"))
    )
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def groups_of_four(n: Column) -> list[Column]:
    """The five four-digit groups of a number below 10^20, highest first, as integers."""
    digits = F.lpad(n.cast("string"), 20, "0")
    return [F.substring(digits, 1 + 4 * k, 4).cast("int") for k in range(5)]


def spell(n: Column, hanja: bool = False, omit_one: bool = False, sheet: bool = False) -> Column:
    """A whole number below 10^20 in Hangul or formal Hanja, by groups of four digits.

    ``omit_one`` leaves out "one" before tens, hundreds, thousands and a lone
    ten thousand.  ``sheet`` takes the Hanja that spreadsheets spell with.
    """
    numerals = (SHEET_HANJA if sheet else HANJA) if hanja else HANGUL
    small = SHEET_SMALL if hanja and sheet else SMALL[hanja]
    parts = []
    for place, group in zip((4, 3, 2, 1, 0), groups_of_four(n), strict=True):
        inner = []
        for k in (3, 2, 1, 0):
            digit = F.floor(group / 10**k) % 10
            bare = (digit == 1) if k > 0 else (group == 1) & F.lit(place == 1)
            shown = F.when(bare & F.lit(omit_one), F.lit("")).otherwise(F.translate(digit.cast("string"), "0123456789", numerals))
            inner.append(F.when(digit > 0, F.concat(shown, F.lit(small[k]))).otherwise(F.lit("")))
        parts.append(F.when(group > 0, F.concat(*inner, F.lit(LARGE[hanja][place]))).otherwise(F.lit("")))
    return F.when(n == 0, F.lit(numerals[0])).otherwise(F.concat(*parts))


def formal(n: Column, hanja: bool = False, omit_one: bool = False) -> Column:
    """The form used in contracts: 일금 …원정 with the figure in brackets, or its Hanja."""
    if hanja:
        return F.concat(F.lit("金 "), spell(n, True), F.lit("원整"))
    return F.concat(F.lit("일금 "), spell(n, omit_one=omit_one), F.lit("원정 (₩"), comma(n), F.lit(")"))


def mixed(n: Column) -> Column:
    """Digits with units: 1억 2,345만 6,789원."""
    shown = [F.when(g > 0, F.concat(F.format_number(g, 0), F.lit(u))) for u, g in zip(reversed(LARGE[False]), groups_of_four(n), strict=True)]
    return F.concat(F.when(n == 0, F.lit("0")).otherwise(F.concat_ws(" ", *shown)), F.lit("원"))


def comma(n: Column) -> Column:
    """Thousands separators, for whole numbers of any size."""
    return F.regexp_replace(n.cast("string"), r"(?<=\d)(?=(\d{3})+$)", ",")


#: All signs that are read as a numeral or unit.  Numerals become a to j, so that they are told from digits.
READ = {
    "a": "영공零", "b": "일壹一", "c": "이貳二", "d": "삼參三", "e": "사肆四", "f": "오伍五", "g": "육륙陸六", "h": "칠柒七", "i": "팔捌八", "j": "구玖九",
    "T": "십拾十", "H": "백佰百", "S": "천阡仟千", "M": "만萬", "E": "억億", "J": "조兆", "K": "경京",
}
_TIMES = "(?:[b-j]|[1-9][0-9]*)?"
#: One group: thousands, hundreds and tens, each after what it is taken times, then what is left.
_GROUP = rf"(?:({_TIMES})S)?(?:({_TIMES})H)?(?:({_TIMES})T)?([b-j]|[0-9]{{1,20}})?"
SPELLED = re.compile("".join(f"(?:{_GROUP}({large}))?" for large in "KJEM") + f"{_GROUP}()")
LETTERS = str.maketrans({sign: letter for letter, signs in READ.items() for sign in signs})
NUMERALS = str.maketrans("abcdefghij", "0123456789")
AROUND = re.compile(r"^\s*(?:일금|금|金)?\s*|\s*(?:원|圓)?\s*(?:정|整)?(?:\s*\(₩[0-9,]+\))?\s*$")


def read_spelled(text: str | None) -> tuple[decimal.Decimal | None, str | None]:
    """(value, error) of one amount, see ``parse_spelled``."""
    bare = AROUND.sub("", text or "")
    if not bare:
        return None, "empty"
    if re.search(r"[A-Za-z]|[^\w,.\s]|\.(?![0-9])", bare) or re.search(r"[^a-jTHSMEJK0-9,.\s]", plain := bare.translate(LETTERS)):
        return None, "sign"
    if re.search(r"[0-9]\.[0-9]", plain):
        return None, "decimals"
    if re.search(r"[a-j]\s*[a-j0-9]|[0-9]\s*[a-j]|[0-9]\s+[0-9]", plain):
        return None, "digits"
    packed = re.sub(r"\s|,(?=[0-9]{3}(?![0-9]))", "", plain)
    if packed in ("a", "0"):
        return decimal.Decimal(0), None
    if not (found := SPELLED.fullmatch(packed)) or re.search("[KJEM][KJEM]", packed):
        return None, "order"
    total = 0
    for k, large in enumerate((10**16, 10**12, 10**8, 10**4, 1)):
        *parts, rest, unit = found.groups()[5 * k : 5 * k + 5]
        group = sum(int(p.translate(NUMERALS) or 1) * small for p, small in zip(parts, (1000, 100, 10), strict=True) if p is not None) + int((rest or "a").translate(NUMERALS))
        if unit and packed.startswith(unit):  # a unit with nothing before it stands for itself
            group = 1
        total += group * large
    return (decimal.Decimal(total), None) if total < LIMIT else (None, "too large")


def parse_spelled(text: Column) -> Column:
    """STRUCT<value DECIMAL(38,0), error STRING> of an amount in Hangul or Hanja numerals, or digits with units; units must fall.

    One pattern states the order of groups and units.  A large unit has
    something before it, unless the amount begins with it (만 is 10,000).
    errors: empty, decimals, sign (one that is not read), digits (that follow
    each other without a unit), order, too large.  Batches of texts go to
    Python, as a Column would repeat its input for each part of the pattern.
    """

    @F.pandas_udf("value decimal(38,0), error string")
    def read(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_spelled(t) for t in texts], columns=["value", "error"])

    return read(text)


def parse_any(text: Column) -> Column:
    """Digits or spelling, whichever the text holds: a numeral or unit makes it a spelling."""
    signs = "".join(READ.values())
    return F.when(text.rlike(f"[{signs}]"), parse_spelled(text)).otherwise(parse_amount(text))


def divide(n: Column, d: Column, mode: str = "floor") -> Column:
    """Exact division of whole non-negative decimals: floor, ceil, or round (half up).

    Spark's div wraps beyond BIGINT, so the remainder is taken off first.
    """
    n, d = n.cast(WIDE), d.cast(WIDE)
    rest = n % d
    down = ((n - rest) / d).cast(WIDE)
    if mode == "floor":
        return down
    up = rest > 0 if mode == "ceil" else rest >= d - rest
    return F.when(up, down + 1).otherwise(down).cast(WIDE)


def parse_rate(text: Column) -> Column:
    """Basis points 0 to 10000 of a percentage with at most two decimals; null if it is none."""
    bare = F.regexp_replace(F.trim(text), r"\s*%$", "")
    value = F.round(bare.try_cast("decimal(10,2)") * 100, 0).cast("int")
    return F.when(bare.rlike(r"^[0-9]{1,3}(\.[0-9]{1,2})?$") & (value <= 10000), value)


def rate_label(bp: Column) -> Column:
    return F.concat(F.regexp_replace((bp / 100).cast("decimal(7,2)").cast("string"), r"\.?0+$", ""), F.lit("%"))


def from_net(net: Column, bp: Column, mode: str = "floor") -> Column:
    """STRUCT<net, tax, gross> of a net amount."""
    tax = divide(net.cast(WIDE) * bp.cast("decimal(5,0)"), F.lit(10000), mode)
    return F.struct(net.cast(WIDE).alias("net"), tax.alias("tax"), (net.cast(WIDE) + tax).cast(WIDE).alias("gross"))


def from_gross(gross: Column, bp: Column, mode: str = "round") -> Column:
    """STRUCT<net, tax, gross> of a gross amount; the tax is what is left, so the parts always sum up."""
    net = divide(gross.cast(WIDE) * 10000, bp.cast("decimal(5,0)") + 10000, mode)
    return F.struct(net.alias("net"), (gross.cast(WIDE) - net).cast(WIDE).alias("tax"), gross.cast(WIDE).alias("gross"))


def from_tax(tax: Column, bp: Column, mode: str = "floor") -> Column:
    """STRUCT<net, tax, gross, differs> of a tax; ``differs`` if the net's own tax is another."""
    net = F.when(bp > 0, divide(tax.cast(WIDE) * 10000, F.greatest(bp, F.lit(1)), "round"))
    again = from_net(net, bp, mode)["tax"]
    return F.struct(net.alias("net"), tax.cast(WIDE).alias("tax"), (net + tax.cast(WIDE)).cast(WIDE).alias("gross"), (again != tax.cast(WIDE)).alias("differs"))


def item_lines(items: DataFrame, quantity: str = "qty", price: str = "price") -> DataFrame:
    """``items`` with amount (quantity times price) and error; lines empty in both are left out.

    Quantities are whole numbers up to 10^9, prices as ``parse_amount`` reads.
    """
    q, p = F.trim(F.col(quantity)), F.col(price)
    whole = F.regexp_replace(q, ",", "")
    n = F.when(whole.rlike("^[0-9]{1,10}$"), whole.cast(WIDE))
    parsed = parse_amount(p)
    error = F.when(n.isNull() | (n > 10**9), F.lit("quantity")).when(parsed["error"].isNotNull(), F.lit("price"))
    kept = items.filter((F.coalesce(q, F.lit("")) != "") | (F.coalesce(F.trim(p), F.lit("")) != ""))
    return kept.withColumns({"error": error, "amount": F.when(error.isNull(), (n.cast("decimal(10,0)") * parsed["value"].cast("decimal(20,0)")).cast(WIDE))})


def item_total(lines: DataFrame, bp: int, mode: str = "floor") -> DataFrame:
    """One row: count of lines, net, tax once on the total, gross, lines in error."""
    total = lines.agg(F.count("amount").alias("lines"), F.coalesce(F.sum("amount"), F.lit(0)).cast(WIDE).alias("sum"), F.count("error").alias("errors"))
    return total.select("lines", from_net(F.col("sum"), F.lit(bp), mode).alias("v"), "errors").select("lines", "v.*", "errors")


def item_table(lines: DataFrame, bp: int, mode: str = "floor", name: str = "item", quantity: str = "qty", price: str = "price") -> DataFrame:
    """The lines of ``item_lines`` as text cells (item, quantity, price, amount), then net, tax and total; order by part, then as the lines are.

    Lines in error carry it in place of their amount.
    """
    cell = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    body = lines.select(F.lit(0).alias("part"), cell(F.col(name)).alias("item"), cell(F.col(quantity)).alias("quantity"), cell(F.col(price)).alias("price"), F.coalesce(comma(F.col("amount")), F.concat(F.lit("error: "), F.col("error"))).alias("amount"))
    rows = F.array(*[F.struct(F.lit(k).alias("part"), F.lit(label).alias("item"), F.lit("").alias("quantity"), F.lit("").alias("price"), comma(F.col(c)).alias("amount")) for k, (label, c) in enumerate((("net", "net"), ("tax", "tax"), ("total", "gross")), 1)])
    return body.unionByName(item_total(lines, bp, mode).select(F.inline(rows)))
