"""Text measures, newlines, hashes, names, payloads, escapes and masking, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.names import unique_names
from tessera.operators.tables import numbered

BLANKS = r"(?U)[\s﻿]"


def lines(text: Column) -> Column:
    """Lines without their ends; a final newline opens no line, an empty text has none."""
    whole = F.regexp_replace(text, r"\r\n|\r", "\n")
    return F.when(whole == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(whole, r"\n$", ""), "\n"))


def ends_with_newline(text: Column) -> Column:
    return text.rlike(r"[\r\n]$")


def newline(text: Column, mode: str) -> Column:
    """Line ends as they are (keep), or all lf or crlf."""
    if mode == "keep":
        return text
    return F.regexp_replace(text, r"\r\n|\r|\n", {"lf": "\n", "crlf": "\r\n"}[mode])


def graphemes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\X"), F.lit(0))


def count_graphemes(text: Column) -> Column:
    """How many there are; in ASCII only CR and LF join."""
    return F.when(text.rlike(r"[^\x00-\x7f]|\r\n"), F.regexp_count(text, F.lit(r"\X"))).otherwise(F.length(text))


def counts(text: Column) -> Column:
    """STRUCT of measures: graphemes, code points with and without white space, Hangul, words, lines, paragraphs, bytes."""
    parts = F.split(F.regexp_replace(text, r"\r\n|\r", "\n"), r"\n[^\S\n]*\n\s*")
    bare = F.regexp_replace(text, r"[\r\n]", "")
    return F.struct(
        count_graphemes(text).cast("long").alias("graphemes"),
        F.length(text).cast("long").alias("chars"),
        F.length(bare).cast("long").alias("with_spaces"),
        F.length(F.regexp_replace(text, BLANKS, "")).cast("long").alias("without_spaces"),
        F.regexp_count(text, F.lit("[가-힣]")).cast("long").alias("hangul"),
        F.regexp_count(text, F.lit(r"[^\s]+")).cast("long").alias("words"),
        F.size(lines(text)).cast("long").alias("lines"),
        F.size(F.filter(parts, lambda p: F.trim(p) != "")).cast("long").alias("paragraphs"),
        F.octet_length(text).cast("long").alias("utf8_bytes"),
    )


def manuscript(text: Column, columns: int = 20, rows: int = 10) -> Column:
    """STRUCT<rows, pages> of manuscript paper: each paragraph indented by a cell, empty ones a row."""
    need = F.transform(lines(text), lambda p: F.when(p == "", 1).otherwise(F.ceil((count_graphemes(p) + 1) / columns)).cast("long"))
    n = F.aggregate(need, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.struct(n.alias("rows"), F.ceil(n / rows).alias("pages"))


def hashes(content: Column) -> Column:
    """STRUCT of md5, sha1, sha256, sha384 and sha512 of text or bytes."""
    return F.struct(F.md5(content).alias("md5"), F.sha1(content).alias("sha1"), F.sha2(content, 256).alias("sha256"), F.sha2(content, 384).alias("sha384"), F.sha2(content, 512).alias("sha512"))


def parse_expected(text: Column) -> Column:
    """STRUCT<hash, algorithm, error> of a pasted hash: the first run of hexadecimal digits, its kind by its length."""
    bare = F.lower(F.regexp_extract(F.regexp_replace(F.trim(text), r"^(?i)(md5|sha-?\d+)\s*[:=(]\s*", ""), r"^\\?([0-9A-Fa-f]+)(\s|$)", 1))
    kind = F.when(F.length(bare) == 32, "md5").when(F.length(bare) == 40, "sha1").when(F.length(bare) == 64, "sha256").when(F.length(bare) == 96, "sha384").when(F.length(bare) == 128, "sha512")
    error = F.when(F.coalesce(F.trim(text), F.lit("")) == "", "empty").when(bare == "", "not hexadecimal").when(kind.isNull(), "no known length")
    return F.struct(F.when(error.isNull(), bare).alias("hash"), kind.alias("algorithm"), error.alias("error"))


def manifest_line(name: Column, digest: Column) -> Column:
    """A line as sha256sum prints it; names with a backslash or line end are escaped."""
    odd = name.rlike(r"[\\\n\r]")
    safe = F.replace(F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return F.concat(F.when(odd, F.lit("\\")).otherwise(F.lit("")), digest, F.lit("  "), safe)


def duplicate_groups(df: DataFrame, key: str, content: str) -> DataFrame:
    """(hash, copies, first) of contents that occur more than once.

    Counts and the smallest key are all that is gathered, so a group of any
    size stays one row; members are found by a join on the hash.
    """
    hashed = df.filter(F.col(content).isNotNull()).select(F.sha2(content, 256).alias("hash"), F.col(key).alias("key"))
    return hashed.groupBy("hash").agg(F.count("*").alias("copies"), F.min("key").alias("first")).filter("copies > 1")


# names of files


def split_name(name: Column) -> Column:
    """STRUCT<stem, ext>: the part after the last point, unless nothing stands before it."""
    return F.struct(F.regexp_extract(name, r"^(?s)(.+?)(\.[^.]*)?$", 1).alias("stem"), F.regexp_extract(name, r"^(?s)(.+?)\.([^.]*)$", 2).alias("ext"))


#: Device names that Windows keeps for itself.
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"COM{k}" for k in range(1, 10)), *(f"LPT{k}" for k in range(1, 10)))


def sanitize_name(name: Column, most: int = 200) -> Column:
    """A name that Windows accepts: bad characters as _, no blank or point at the end, no device name, at most ``most`` long."""
    safe = F.regexp_replace(F.regexp_replace(name, r'[\x00-\x1f<>:"/\\|?*]', "_"), r"[. ]+$", "")
    stem = F.upper(F.regexp_extract(safe, r"^([^.]*)", 1))
    safe = F.when(stem.isin(*RESERVED), F.concat(F.lit("_"), safe)).otherwise(safe)
    return F.when(safe == "", F.lit("_")).otherwise(F.substring(safe, 1, most))


def fill_template(template: str, name: Column, ext: Column, number: Column, date: Column, today: Column) -> Column:
    """A name from {name} {ext} {n} {n:W} {date} {today}; other tokens raise."""
    parts = []
    for literal, token in re.findall(r"([^{}]+)|\{([^{}]*)\}", template):
        if literal:
            parts.append(F.lit(literal))
        elif token in ("name", "ext"):
            parts.append(name if token == "name" else ext)
        elif token == "n":
            parts.append(number.cast("string"))
        elif re.fullmatch("n:[0-9]{1,2}", token):
            text, width = number.cast("string"), int(token[2:])
            parts.append(F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text))
        elif token in ("date", "today"):
            parts.append(F.date_format(date if token == "date" else today, "yyyy-MM-dd"))
        else:
            raise ValueError(f"no token {{{token}}}")
    return F.concat(*parts) if parts else F.lit("")


def natural_key(name: Column) -> Column:
    """A sort key in which runs of digits count as numbers: each padded to 20 places."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]+$") & (F.length(r) < 20), F.lpad(r, 20, "0")).otherwise(r)), "")


def plan_renames(df: DataFrame, name: str, order: list[Column], template: str, start: int = 1, step: int = 1, find: str = "", replace: str = "", regex: bool = False, flags: str = "", case: str = "keep", underscores: bool = False, modified: str | None = None, today: Column | None = None) -> DataFrame:
    """``df`` with new_name: find and replace in the stem, case, blanks, numbering, template, safe characters, unique names.

    Numbers follow ``order``, counted by range partitions, so no task sees all
    rows.  ``flags`` (of i, m, s, u) go with ``regex``.  Equal names (without
    regard to case) get " (2)", " (3)" in order, each the first that is free.
    """
    parts = split_name(F.col(name))
    stem = parts["stem"]
    if find:
        stem = F.regexp_replace(stem, f"(?{flags}){find}" if flags else find, replace) if regex else F.replace(stem, F.lit(find), F.lit(replace))
    stem = {"keep": stem, "lower": F.lower(stem), "upper": F.upper(stem)}[case]
    stem = F.regexp_replace(stem, r"\s+", "_") if underscores else stem
    today = F.current_date() if today is None else today
    date = F.col(modified) if modified else today
    planned = numbered(df, order, "_row").withColumn("_n", F.lit(start) + (F.col("_row") - 1) * step)
    dot = F.when(parts["ext"] != "", F.concat(F.lit("."), parts["ext"])).otherwise(F.lit(""))
    planned = planned.withColumns({"_stem": fill_template(template, stem, parts["ext"], F.col("_n"), date, today), "_dot": F.lit("") if "{ext}" in template else dot})
    planned = planned.withColumn("new_name", sanitize_name(F.concat("_stem", "_dot"))).drop("_stem")
    piece = split_name(F.col("new_name"))["stem"]
    unique = unique_names(planned, piece, F.substr("new_name", F.length(piece) + 1), "_row", "new_name")
    return unique.drop("_n", "_row", "_dot")


def part_file_name(stem: Column, label: Column, ext: str) -> Column:
    """The file of a part of a table: the table's name, the part's, the format's."""
    return sanitize_name(F.concat(stem, F.lit("_"), F.regexp_replace(F.coalesce(F.nullif(F.trim(label), F.lit("")), F.lit("blank")), r"\s+", " "), F.lit(f".{ext}")))


def sheet_names(names: list[str], most: int = 31) -> list[str]:
    """Legal names of worksheets, unique without regard to case: none of []:*?/\\ and no ' at the ends, ``most`` long, not History."""
    used: set[str] = set()
    out = []
    for name in names:
        base = re.sub(r"[\[\]:*?/\\\x00-\x1f]", "_", name).strip("'").strip() or "Sheet"
        base = "History_" if base.lower() == "history" else base
        k, new = 1, base[:most]
        while new.lower() in used:
            k += 1
            tail = f" ({k})"
            new = base[: most - len(tail)] + tail
        used.add(new.lower())
        out.append(new)
    return out


# payloads and escapes


def escape_xml(text: Column) -> Column:
    bare = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        bare = F.replace(bare, F.lit(a), F.lit(b))
    return bare


def decode_xml(text: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escape_rtf(text: Column) -> Column:
    """Text for RTF: braces and backslashes escaped, line ends as \\line, others than ASCII as signed UTF-16 units."""
    bare = F.regexp_replace(F.regexp_replace(text, r"([\\{}])", r"\\$1"), r"\r\n|\r|\n", r"\\line ")
    unit = lambda n: F.concat(F.lit("\\u"), F.when(n > 32767, n - 65536).otherwise(n).cast("string"), F.lit("?"))

    def one(c: Column) -> Column:
        n = F.ascii(c)
        high, low = F.floor((n - 65536) / 1024) + 55296, (n - 65536) % 1024 + 56320
        return F.when(n < 128, c).when(n < 65536, unit(n)).otherwise(F.concat(unit(high), unit(low)))

    return F.when(bare.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(F.split(bare, ""), one), "")).otherwise(bare)


def page_label(template: str, n: Column, total: Column) -> Column:
    """A page number as text: {n} and {total} of the template filled in."""
    return F.replace(F.replace(F.lit(template), F.lit("{n}"), n.cast("string")), F.lit("{total}"), total.cast("string"))


def wifi_payload(ssid: Column, password: Column, kind: str = "WPA", hidden: bool = False) -> Column:
    safe = lambda c: F.regexp_replace(c, r'([\;,":])', r"\\$1")
    key = F.lit("") if kind == "nopass" else F.concat(F.lit("P:"), safe(password), F.lit(";"))
    return F.concat(F.lit(f"WIFI:T:{kind};S:"), safe(ssid), F.lit(";"), key, F.lit("H:true;;" if hidden else ";"))


def vcard_payload(name: Column, phone: Column, email: Column, organisation: Column) -> Column:
    safe = lambda c: F.regexp_replace(F.regexp_replace(c, r"([\;,])", r"\\$1"), r"\r\n|\n", r"\\n")
    rows = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(k), safe(c))) for k, c in (("N:", name), ("FN:", name), ("ORG:", organisation), ("TEL:", phone), ("EMAIL:", email))]
    return F.concat_ws("\r\n", F.lit("BEGIN:VCARD"), F.lit("VERSION:3.0"), *rows, F.lit("END:VCARD"))


def mailto_payload(to: Column, subject: Column, body: Column) -> Column:
    code = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    query = F.concat_ws("&", *[F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{k}="), code(c))) for k, c in (("subject", subject), ("body", body))])
    return F.concat(F.lit("mailto:"), to, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def tel_payload(number: Column) -> Column:
    return F.concat(F.lit("tel:"), F.regexp_replace(number, r"[^0-9+*#]", ""))


def sms_payload(number: Column, body: Column) -> Column:
    return F.concat(F.lit("SMSTO:"), F.regexp_replace(number, r"[^0-9+]", ""), F.lit(":"), body)


def size_label(n: Column) -> Column:
    """1,023 B, 1.0 KB, 2.5 MB ..."""
    step = lambda k, u: F.concat(F.format_number(n / 1024**k, 1), F.lit(f" {u}"))
    return F.when(n < 1024, F.concat(F.format_number(n, 0), F.lit(" B"))).when(n < 1024**2, step(1, "KB")).when(n < 1024**3, step(2, "MB")).otherwise(step(3, "GB"))
