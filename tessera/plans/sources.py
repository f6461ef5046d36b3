"""Queries of the file sources: tables as files of each kind, read back."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.texts import escape_xml
from tessera.plans.registry import query, read
from tessera.operators.scratch import Scratch
from tessera.sources import files, imports, large_csv, patches, writers


def orders_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, rows) of each customer's orders (a few tens at the most): key, status and priority in the order of the keys."""
    row = F.struct("o_orderkey", "o_orderstatus", "o_orderpriority")
    orders = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return orders.withColumn("path", F.concat(F.lit("c"), F.col("o_custkey").cast("string")))


ROWS = "SELECT 'c' || o_custkey AS path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS key, o_orderstatus AS status, {} AS priority FROM orders"


@query(f"SELECT path, row, key, status, priority FROM ({ROWS.format("'a, ' || o_orderpriority || chr(10) || chr(34) || 'b' || chr(34)")})")
def csv_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted cells with commas, quotes and line ends, keys with leading zeros, blank rows between, a mark in front."""
    line = lambda r: F.concat(F.lpad(r["o_orderkey"].cast("string"), 9, "0"), F.lit(","), r["o_orderstatus"], F.lit(',"a, '), r["o_orderpriority"], F.lit('\\n""b"""\r\n'))
    text = F.concat(F.lit("key,status,priority\r\n"), F.array_join(F.transform("rows", line), " , \r\n"))
    found = files.read_csv(orders_of(spark, sf_dir).select("path", files.utf8_bytes(F.replace(text, F.lit("\\n"), F.lit("\n")), mark=True).alias("content")))
    place = F.ceil(F.col("row") / 2 + 0.25).cast("long")
    return found.filter("row > 0").select("path", place.alias("row"), F.col("cells")[0].alias("key"), F.col("cells")[1].alias("status"), F.col("cells")[2].alias("priority"))


@query("SELECT doc_id, lang, CAST(length(text) AS BIGINT) AS chars, md5(text) AS digest FROM (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents)")
def large_csv_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as CSV with line ends and quotes in cells, read back by splits."""
    at = f"{Scratch(spark, 'large-csv').path}/texts"
    read(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text")).write.options(quoteAll="true", escape='"', ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(at)
    cells = large_csv.read_large_csv(spark, at, 3).select(*[F.col("cells")[k].alias(c) for k, c in enumerate(("doc_id", "lang", "text"))])
    return cells.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.length("text").cast("long").alias("chars"), F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query(f"SELECT path, row, CAST(CAST(key AS BIGINT) AS VARCHAR) AS key, status, priority FROM ({ROWS.format('o_orderpriority')})")
def json_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.read_json(orders_of(spark, sf_dir).select("path", F.encode(F.to_json("rows"), "UTF-8").alias("content")))
    return found.filter("row > 0").select("path", "row", F.col("cells")[0].alias("key"), F.col("cells")[1].alias("status"), F.col("cells")[2].alias("priority"))


def workbooks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of a workbook for each customer."""

    @F.pandas_udf("binary")
    def written(rows: pd.Series) -> pd.Series:
        return pd.Series([files.xlsx_bytes([("orders", [["key", "status", "priority"], *[[int(r["o_orderkey"]), r["o_orderstatus"], r["o_orderpriority"]] for r in own]])]) for own in rows])

    return orders_of(spark, sf_dir).select("path", written("rows").alias("content"))


def orders_in(workbooks: DataFrame) -> DataFrame:
    cells = files.workbook_cells(files.read_xlsx(workbooks)).filter("row > 0")
    value = lambda col, name: F.max(F.when(F.col("col") == col, F.col(name)))
    return cells.groupBy(F.col("book").alias("path"), F.col("row").cast("long").alias("row")).agg(value(0, "num").alias("key"), value(0, "kind").alias("kind"), value(1, "str").alias("status"), value(2, "str").alias("priority"))


@query(f"SELECT path, row, CAST(key AS DOUBLE) AS key, 'num' AS kind, status, priority FROM ({ROWS.format('o_orderpriority')})")
def xlsx_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook for each customer, written and read back as cells with their kinds."""
    return orders_in(workbooks_of(spark, sf_dir))


@query(f"SELECT path, row, CAST(key AS DOUBLE) + CASE WHEN status = 'F' THEN 0.5 ELSE 0 END AS key, 'num' AS kind, status, CASE WHEN status = 'O' THEN 'open & ' || priority ELSE priority END AS priority FROM ({ROWS.format('o_orderpriority')})")
def patched_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same workbooks with numbers of finished orders and texts of open ones changed in place."""
    workbooks = workbooks_of(spark, sf_dir)
    orders = orders_of(spark, sf_dir).select("path", F.posexplode("rows").alias("row", "o"))
    place = lambda col: ["path", F.lit("orders").alias("sheet"), (F.col("row") + 1).alias("row"), F.lit(col).alias("col")]
    numbers = orders.filter("o.o_orderstatus = 'F'").select(*place(0), *patches.edit("num", F.col("o.o_orderkey") + 0.5))
    names = orders.filter("o.o_orderstatus = 'O'").select(*place(2), *patches.edit("str", F.concat(F.lit("open & "), "o.o_orderpriority")))
    return orders_in(patches.patched_workbooks(workbooks, numbers.unionByName(names)).select("path", "content"))


@query("SELECT 'c' || o_custkey AS path, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS pos, 'orders/' || o_orderkey || '.txt' AS name, CAST(strlen(o_orderpriority) AS BIGINT) AS size, sha256(o_orderpriority) AS sha256 FROM orders")
def zip_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive for each customer, with a path that leaves it among its entries."""

    @F.pandas_udf("binary")
    def packed(rows: pd.Series) -> pd.Series:
        out = []
        for own in rows:
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                for r in own:
                    z.writestr(f"orders/{r['o_orderkey']}.txt", r["o_orderpriority"])
                z.writestr("../outside.txt", "not read")
            out.append(buffer.getvalue())
        return pd.Series(out)

    found = files.read_zip(orders_of(spark, sf_dir).select("path", packed("rows").alias("content")))
    return found.select("path", "pos", "name", "size", F.sha2("data", 256).alias("sha256"))


@query(f"""
SELECT path, CAST(0 AS BIGINT) AS pos, 'paragraph' AS kind, 'Orders of ' || path || ' & Co' AS text, NULL AS cells FROM (SELECT DISTINCT path FROM ({ROWS.format('o_orderpriority')})) UNION ALL
SELECT path, CAST(1 AS BIGINT), 'table', NULL, string_agg(key || ',' || status, ';' ORDER BY row) FROM ({ROWS.format('o_orderpriority')}) GROUP BY path
""")
def office_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text document for each customer, with a paragraph and a table."""
    cell = lambda c: F.concat(F.lit("<w:tc><w:p><w:r><w:t>"), escape_xml(c), F.lit("</w:t></w:r></w:p></w:tc>"))
    row = lambda r: F.concat(F.lit("<w:tr>"), cell(F.lpad(r["o_orderkey"].cast("string"), 9, "0")), cell(r["o_orderstatus"]), F.lit("</w:tr>"))
    start = F.concat(F.lit('<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Orders of </w:t></w:r><w:r><w:t>'), F.col("path"), F.lit(" &amp; Co</w:t></w:r></w:p><w:tbl>"))
    body = F.concat(start, F.array_join(F.transform("rows", row), ""), F.lit("</w:tbl></w:body></w:document>"))

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("word/document.xml", text)
            out.append(buffer.getvalue())
        return pd.Series(out)

    found = files.read_office(orders_of(spark, sf_dir).select("path", packed(body).alias("content")))
    return found.select("path", "pos", "kind", "text", F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";").alias("cells"))


@query(f"""
WITH d AS (SELECT path || '.' || form AS path, row, key, status FROM ({ROWS.format('o_orderpriority')}), (SELECT unnest(['docx', 'epub', 'fb2', 'fodt', 'odt']) AS form))
SELECT path, CAST(0 AS BIGINT) AS pos, 'paragraph' AS kind, 'Orders of ' || path || ' & <Co>' AS text, NULL AS cells FROM (SELECT DISTINCT path FROM d) UNION ALL
SELECT path, CAST(1 AS BIGINT), 'table', NULL, string_agg(key || ',' || status, ';' ORDER BY row) FROM d GROUP BY path
""")
def written_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paragraph and a table for each customer, written in each format of documents that can be read, and read back."""
    block = lambda kind, text, rows: F.struct(F.lit(kind).alias("kind"), text.cast("string").alias("text"), rows.cast("array<array<string>>").alias("rows"))
    table = F.transform("rows", lambda r: F.array(F.lpad(r["o_orderkey"].cast("string"), 9, "0"), r["o_orderstatus"]))
    orders, none = orders_of(spark, sf_dir), F.lit(None)
    out = None
    for form in ("docx", "epub", "fb2", "fodt", "odt"):
        path = F.concat("path", F.lit(f".{form}"))
        parts = F.array(block("paragraph", F.concat(F.lit("Orders of "), path, F.lit(" & <Co>")), none), block("table", none, table))
        made = orders.select(path.alias("path"), writers.document_bytes(parts, F.col("path"), form).alias("content"))
        out = made if out is None else out.unionByName(made)
    return files.read_office(out).select("path", "pos", "kind", "text", F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";").alias("cells"))


@query(f"""
SELECT path || form AS path, CAST(row - 1 AS BIGINT) AS row, CAST(CAST(key AS BIGINT) AS VARCHAR) || ',' || status || ',' || CASE WHEN status = 'F' THEN 'TRUE' ELSE 'FALSE' END || ',' || '  ' || priority AS cells, 'num,str,bool,str' AS kinds
FROM ({ROWS.format('o_orderpriority')}), (SELECT unnest(['.ods', '.fods']) AS form)
""")
def written_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook for each customer in both OpenDocument forms, read back."""
    cell = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    row = lambda r: F.array(cell("num", r["o_orderkey"].cast("string")), cell("str", r["o_orderstatus"]), cell("bool", F.upper((r["o_orderstatus"] == "F").cast("string"))), cell("str", F.concat(F.lit("  "), r["o_orderpriority"])))
    sheets = F.array(F.struct(F.lit("orders & more").alias("name"), F.transform("rows", row).alias("rows")))
    orders = orders_of(spark, sf_dir)
    ods, fods = (orders.select(F.concat("path", F.lit(f".{form}")).alias("path"), writers.spreadsheet_bytes(sheets, form).alias("content")) for form in ("ods", "fods"))
    return files.read_xlsx(ods.unionByName(fods)).select("path", "row", F.array_join("cells", ",").alias("cells"), F.array_join("kinds", ",").alias("kinds"))


@query("""
WITH o AS (SELECT o_custkey, o_orderpriority AS p, CAST(o_orderkey AS VARCHAR) AS k, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY CAST(o_orderkey AS VARCHAR)) AS n FROM orders)
SELECT o_custkey AS path, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY p, k) - 1 AS BIGINT) AS pos, 'orders/' || p || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END || '.txt' AS name, k AS text FROM o
""")
def order_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of each customer as entries of an archive, named by priority, so that names meet."""
    entries = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("archive"), F.concat(F.lit("orders/"), "o_orderpriority", F.lit(".txt")).alias("name"), F.encode(F.col("o_orderkey").cast("string"), "UTF-8").alias("data"))
    found = files.read_zip(writers.archives(entries).select(F.col("archive").cast("string").alias("path"), "content"))
    return found.select(F.col("path").cast("bigint").alias("path"), "pos", "name", F.decode("data", "UTF-8").alias("text"))


@query(f"""
WITH r AS (SELECT path, row, CAST(CAST(key AS BIGINT) AS VARCHAR) AS k, key, status, priority FROM ({ROWS.format('o_orderpriority')}))
SELECT path || '.tsv' AS path, 'Sheet1' AS sheet, CAST(row - 1 AS BIGINT) AS row, key || '|' || status || '|' || priority AS cells, 'str,str,str' AS kinds FROM r UNION ALL
SELECT path || '.json', 'Sheet1', row, k || '|' || status || '|' || priority, 'num,str,str' FROM r UNION ALL
SELECT path || '.xml', 'orders', CAST(2 * row AS BIGINT), k || '|-|' || priority, 'num,blank,str' FROM r
""")
def mixed_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as TSV, JSON and XML spreadsheet files, read together by their endings."""
    row = lambda *cells: F.concat(*[c if not isinstance(c, str) else F.lit(c) for c in cells])
    tsv = F.array_join(F.transform("rows", lambda r: row(F.lpad(r["o_orderkey"].cast("string"), 9, "0"), "\t", r["o_orderstatus"], "\t", r["o_orderpriority"])), "\r\n")
    cell = lambda r, k: row('<Row s:Index="', ((k + 1) * 2 + 1).cast("string"), '"><Cell><Data s:Type="Number">', r["o_orderkey"].cast("string"), '</Data></Cell><Cell s:Index="3"><Data s:Type="String">', escape_xml(r["o_orderpriority"]), "</Data></Cell></Row>")
    xml = row('<Workbook xmlns:s="urn:schemas-microsoft-com:office:spreadsheet"><Worksheet s:Name="orders"><Table>', F.array_join(F.transform("rows", cell), ""), "</Table></Worksheet></Workbook>")
    orders = orders_of(spark, sf_dir)
    tables = [orders.select(F.concat("path", F.lit(f".{name}")).alias("path"), F.encode(text, "UTF-8").alias("content")) for name, text in (("tsv", tsv), ("json", F.to_json("rows")), ("xml", xml))]
    found = imports.read_sheets(tables[0].unionByName(tables[1]).unionByName(tables[2]))
    return found.filter("NOT (path LIKE '%.json' AND row = 0)").select("path", "sheet", "row", F.array_join("cells", "|", "-").alias("cells"), F.array_join("kinds", ",").alias("kinds"))
