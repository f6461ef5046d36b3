"""Queries of the document operators: blocks, differences, encodings and archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import blocks, textdiff
from tessera.operators.scratch import dealt
from tessera.plans.registry import query, read
from tessera.sources import files


@query(None)
def html_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of every page; HTML is not XML, so SQL has no parser for it and tests hold it to fixtures."""
    pages = read(spark, sf_dir, "pages").select("page_id", blocks.html_to_blocks("html").alias("blocks"))
    return blocks.explode_blocks(pages, "blocks").select("page_id", "pos", "kind", "text", F.size("rows").alias("n_rows"))


@query("""
SELECT doc_id, CAST(k - 1 AS INT) AS pos, 'paragraph' AS kind, p[k] AS text FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '[*_`~#>|\\[\\]!-]', ' ', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS p FROM documents), unnest(range(1, len(p) + 1)) u(k)
""")
def plain_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.regexp_replace("text", r"[*_`~#>|\[\]!-]", " ")
    lines = F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    docs = read(spark, sf_dir, "documents").select("doc_id", blocks.markdown_to_blocks(F.array_join(lines, "\n\n")).alias("blocks"))
    return blocks.explode_blocks(docs, "blocks").select("doc_id", "pos", "kind", "text")


@query(None)
def markdown_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of all texts as they are; tests hold the parser to written cases."""
    docs = read(spark, sf_dir, "documents").select("doc_id", blocks.markdown_to_blocks("text").alias("blocks"))
    return blocks.explode_blocks(docs, "blocks").select("doc_id", "pos", "kind", "text", F.size("rows").alias("n_rows"))


@query("""
WITH p AS (SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS VARCHAR) AS s FROM part)
SELECT p_partkey, pos, kind, text, cells FROM (
 SELECT p_partkey, 0 AS pos, 'heading2' AS kind, p_name AS text, NULL AS cells FROM p UNION ALL SELECT p_partkey, 1, 'paragraph', 'Made by ' || p_brand || ' (https://example.org/' || p_partkey || ') as ' || p_type || '. Second line.', NULL FROM p UNION ALL
 SELECT p_partkey, 2, 'table', NULL, 'size;a|b;' || s || ';' FROM p UNION ALL SELECT p_partkey, 3, 'item', p_brand, NULL FROM p UNION ALL SELECT p_partkey, 4, 'item', s || ' big', NULL FROM p UNION ALL
 SELECT p_partkey, 5, 'quote', p_type, NULL FROM p UNION ALL SELECT p_partkey, 6, 'rule', NULL, NULL FROM p UNION ALL SELECT p_partkey, 7, 'code', '# ' || p_name || chr(10) || '| x |', NULL FROM p)
""")
def markdown_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown with headings, links, tables, items, quotes, rules and code, made of the parts."""
    text = F.format_string(
        "## %1$s ##\n\nMade by [%2$s](https://example.org/%5$d \"title\") as **%3$s**.\nSecond `line`.\n\n| size | a\\|b\n|:---|---:|\n| %4$s |\n\n* %2$s\n2. %4$s ~~big~~\n> %3$s\n- - -\n```\n# %1$s\n| x |\n```",
        "p_name", "p_brand", "p_type", F.col("p_size").cast("string"), F.col("p_partkey").cast("long"),
    )
    part = dealt(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    parts = part.select("p_partkey", blocks.markdown_to_blocks(text).alias("blocks"))
    return blocks.explode_blocks(parts, "blocks").select("p_partkey", "pos", "kind", "text", F.array_join(F.flatten("rows"), ";").alias("cells"))


@query("SELECT n_regionkey, string_agg('<p>' || n_name || '</p>', chr(10) ORDER BY n_name) AS html, string_agg(n_name, chr(10) || chr(10) ORDER BY n_name) AS plain, '| n | k |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n_nationkey || ' |', chr(10) ORDER BY n_name) AS md FROM nation GROUP BY n_regionkey")
def blocks_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_name", F.col("n_nationkey").cast("string").alias("k")))).alias("l"))
    as_blocks = F.transform("l", lambda x: F.struct(F.lit("paragraph").alias("kind"), x["n_name"].alias("text"), F.lit(None).cast("array<array<string>>").alias("rows")))
    rows = F.concat(F.array(F.array(F.lit("n"), F.lit("k"))), F.transform("l", lambda x: F.array(x["n_name"], x["k"])))
    return n.select("n_regionkey", blocks.blocks_html(as_blocks).alias("html"), blocks.blocks_text(as_blocks).alias("plain"), blocks.table_markdown(rows).alias("md"))


@query("SELECT o_custkey AS doc, string_agg(o_orderstatus || chr(9) || CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY o_orderkey) AS text FROM orders GROUP BY 1")
def span_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = lambda text, x: F.struct(text.cast("string").alias("text"), F.lit(x).alias("x"), (F.col("o_orderkey") * 12.0).alias("y"), F.lit(20.0).alias("w"), F.lit(10.0).alias("h"))
    spans = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.lit(1).alias("page"), F.inline(F.array(span(F.col("o_orderkey"), 100.0), span(F.col("o_orderstatus"), 0.0))))
    ordered = blocks.reading_order(spans)
    return ordered.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n").alias("text"))


@query(None)
def turn_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation against the one before it: lines added and deleted, as a unified diff."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = read(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(w)).filter("before IS NOT NULL")
    return textdiff.diff_texts(turns, "before", "text", parts=False).select("conv_id", "turn", "added", "deleted", "changed", "complete", "unified")


@query("SELECT doc_id, text, 'utf-8' AS encoding, strlen(text) + 3 AS size FROM documents WHERE text IS NOT NULL")
def encoding_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = read(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", files.utf8_bytes(F.col("text"), mark=True).alias("content"))
    return marked.select("doc_id", files.decoded("content").alias("d"), F.octet_length("content").cast("long").alias("size")).select("doc_id", "d.text", "d.encoding", "size")


@query("""
WITH l AS (SELECT l_suppkey, l_orderkey, CAST(l_partkey AS VARCHAR) AS part, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS row FROM lineitem)
SELECT l_suppkey AS doc, CAST(row AS INT) AS row, 0 AS col, CAST(l_orderkey AS VARCHAR) AS text FROM l UNION ALL SELECT l_suppkey, CAST(row AS INT), 1, part FROM l UNION ALL SELECT l_suppkey, CAST(row AS INT), 2, part FROM l
""")
def spanned_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each supplier: an order's number spans its rows, a part's number two columns; read as a grid."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    first = F.row_number().over(Window.partitionBy("l_suppkey", "l_orderkey").orderBy("l_linenumber", "l_partkey")) == 1
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), "l_orderkey", "l_partkey", (F.row_number().over(order) - 1).alias("row"), first.alias("first"), F.count("*").over(Window.partitionBy("l_suppkey", "l_orderkey")).cast("int").alias("n"))
    cell = lambda pos, across, down, text: F.struct(F.lit(pos).alias("pos"), F.lit(across).alias("col_span"), down.alias("row_span"), text.cast("string").alias("text"))
    part = cell(1, 2, F.lit(1), F.col("l_partkey"))
    cells = lines.select("doc", "row", F.inline(F.when(F.col("first"), F.array(cell(0, 1, F.col("n"), F.col("l_orderkey")), part)).otherwise(F.array(part))))
    return blocks.place_cells(cells).select("doc", "row", "col", "text")


@query("""
WITH l AS (SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k, count(*) OVER (PARTITION BY o_orderkey) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT o_orderkey AS doc, CASE WHEN n > 1 THEN 1 ELSE CAST(k AS INT) END AS block, CASE WHEN n > 1 THEN 'table' ELSE 'line' END AS kind, string_agg(l_partkey || '|' || l_suppkey || '|' || (l_partkey % 7), '/' ORDER BY k) AS text FROM l GROUP BY 1, 2, 3 UNION ALL
SELECT o_orderkey, 0, 'line', 'Order ' || o_orderkey FROM (SELECT DISTINCT o_orderkey FROM l) UNION ALL
SELECT o_orderkey, 2, 'line', 'total|' || n FROM (SELECT DISTINCT o_orderkey, n FROM l)
""")
def found_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a page of positioned words: a title, its lines in three columns that are not quite straight, a total in two."""
    span = lambda x, y, w, text: F.struct(text.cast("string").alias("text"), x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(w).cast("double").alias("w"), F.lit(10.0).alias("h"))
    own = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("lines"))
    times = read(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("doc")).agg(F.count("*").cast("int").alias("times"))
    orders = own.join(times, "doc").select("doc", F.sort_array(F.when(F.col("times") == 1, F.col("lines")).otherwise(F.flatten(F.array_repeat("lines", F.col("times"))))).alias("lines"))

    def body(line: Column, k: Column) -> Column:
        bend, y = (k + 1) % 3, (k + 1) * 14 + 20
        return F.array(span(20 + bend, y, 40, line["l_partkey"]), span(120 - bend, y, 30, line["l_suppkey"]), span(200 + bend, y, 8, line["l_partkey"] % 7))

    n, ten = F.size("lines"), F.lit(10)
    ends = F.array(span(F.lit(20), ten, 30, F.lit("Order")), span(F.lit(55), ten, 30, F.col("doc")), span(F.lit(20), n * 14 + 34, 30, F.lit("total")), span(F.lit(140), n * 14 + 34, 30, n))
    found = orders.select("doc", F.inline(blocks.tables_of(F.concat(F.flatten(F.transform("lines", body)), ends))))
    return found.select("doc", "block", "kind", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "/").alias("text"))
