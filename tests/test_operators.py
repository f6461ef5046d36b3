"""Tables, blocks, differences, files and streams on small cases."""

from __future__ import annotations

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks, tables, textdiff, workbook
from tessera.sources import files, large_csv
from tessera.streaming import events


def test_merge(spark):
    a = spark.createDataFrame([("1", "2", "3")], "x string, y string, z string")
    b = spark.createDataFrame([("4", "5")], "p string, q string")
    out, header = tables.merge_tables([("a", ["n", "n ", "m"], a), ("b", ["N", "n"], b)], "source")
    assert header == ["n", "n", "m", "N"]
    assert sorted(tuple(r) for r in out.collect()) == [("a", "1", "2", "3", None), ("b", "5", None, None, "4")]


def test_blank_rows_and_guard(spark):
    df = spark.createDataFrame([(" ", None), (" ", ""), (None, "x")], "a string, b string")
    assert [tuple(r) for r in tables.drop_blank_rows(df).collect()] == [(None, "x")]
    cells = spark.createDataFrame([(x,) for x in ("=1", "-5", "+1.5%", "-a", "@x", "a", "\tz", "-1,234")], "c string")
    assert [r[0] for r in cells.select(tables.guard(F.col("c"))).collect()] == ["'=1", "-5", "+1.5%", "'-a", "'@x", "a", "'\tz", "-1,234"]
    line = spark.createDataFrame([('a"b', "c,d", None)], "a string, b string, c string")
    assert line.select(tables.csv_line(line, ["a", "b", "c"])).first()[0] == '"a""b","c,d",'
    assert line.select(tables.json_row(["a", "c"])).first()[0] == '["a\\"b",null]'


def test_split_rows_is_in_order(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("k"))
    got = {r.k: r.part for r in tables.split_by_rows(df, [F.col("k")], 30).collect()}
    assert got == {k: k // 30 + 1 for k in range(1000)}


def test_pages():
    assert tables.page_ranges("1-3, 5, 8-", 9) == [1, 2, 3, 5, 8, 9] and tables.page_ranges("-2", 9) == [1, 2]
    assert tables.split_ranges("1-3; 4,6", 6) == [[1, 2, 3], [4, 6]]
    for bad in ("0", "3-1", "x", "1-99", ""):
        with pytest.raises(ValueError):
            tables.page_ranges(bad, 9)
    with pytest.raises(ValueError):
        tables.split_ranges("1;1", 3)


def test_html():
    got = blocks.html_blocks("<head><title>t</title></head><p>a <b>b</b><script>x()</script></p>c<br>d<table><tr><th>1</th><td>2 &amp; 3</td></tr><tr><td>4</table><div>e")
    assert [(b["kind"], b["text"] or b["rows"]) for b in got] == [("paragraph", "a b"), ("paragraph", "c"), ("paragraph", "d"), ("table", [["1", "2 & 3"], ["4"]]), ("paragraph", "e")]
    assert blocks.html_blocks(None) == [] and blocks.html_blocks("") == []


def test_markdown():
    text = "# T **b**\n\npara `x`\nmore [l](http://e.org)\n\n| a | b\\|c |\n|---|---|\n| 1 |\n\n- item\n> quote\n---\n```\ncode *x*\n```"
    got = [(b["kind"], b["text"] if b["rows"] is None else b["rows"]) for b in blocks.markdown_blocks(text)]
    assert blocks.inline("![a [b]](u) [x](<u v> \"t\") [no] (z) [q](w(1)) **s**") == "a [b] x (u) [no] (z) q (w(1)) s"
    assert blocks.is_divider("|:--|--:|") and blocks.is_divider("---|-") and not blocks.is_divider("| a |") and not blocks.is_divider("|-:-|") and not blocks.is_divider("")
    assert blocks.is_rule(" * * *") and blocks.is_rule("___") and not blocks.is_rule("--") and not blocks.is_rule("-*-")
    assert got == [("heading1", "T b"), ("paragraph", "para x more l (http://e.org)"), ("table", [["a", "b|c"], ["1", ""]]), ("item", "item"), ("quote", "quote"), ("rule", None), ("code", "code *x*")]


def test_spans_and_order(spark):
    cells = spark.createDataFrame([(1, 0, 0, 2, 2, "x"), (1, 0, 2, 1, 1, "y")], "doc int, row int, col int, col_span int, row_span int, text string")
    assert sorted((r.row, r.col, r.text) for r in blocks.expand_spans(cells).collect()) == [(0, 0, "x"), (0, 1, "x"), (0, 2, "y"), (1, 0, "x"), (1, 1, "x")]
    spans = spark.createDataFrame([(1, 1, "b", 60.0, 10.0, 10.0, 10.0), (1, 1, "a", 0.0, 10.5, 10.0, 10.0), (1, 1, "c", 71.0, 10.0, 5.0, 10.0), (1, 1, "d", 0.0, 30.0, 5.0, 10.0)], "doc int, page int, text string, x double, y double, w double, h double")
    assert [r.cells for r in blocks.reading_order(spans).orderBy("line").collect()] == [["a", "b c"], ["d"]]


def test_myers():
    assert sum(op != "same" for op, _, _ in textdiff.edit_script(list("ABCABBA"), list("CBABAC"))) == 5
    rnd = random.Random(5)
    for _ in range(200):
        a = [rnd.randint(0, 4) for _ in range(rnd.randint(0, 14))]
        b = [rnd.randint(0, 4) for _ in range(rnd.randint(0, 14))]
        script = textdiff.edit_script(a, b)
        assert [b[y] if op == "add" else a[x] for op, x, y in script if op != "del"] == b
        assert [a[x] for op, x, y in script if op != "add"] == a
    assert textdiff.edit_script([1] * 50, [2] * 50, most=10) is None
    edits, complete = textdiff.line_edits("a\nb", "c\nd", most=1)
    assert not complete and [e["op"] for e in edits] == ["del", "del", "add", "add"]


def test_diff(spark):
    df = spark.createDataFrame([("a\nb\nc\n", "a\nB\nc\nd"), (None, "x"), ("same", "same")], "a string, b string")
    rows = textdiff.diff_texts(df, "a", "b").collect()
    assert [(r.added, r.deleted) for r in rows] == [(2, 1), (1, 0), (0, 0)]
    assert rows[0].unified == "@@ -1,3 +1,4 @@\n a\n-b\n+B\n c\n+d" and rows[2].unified == ""
    assert textdiff.diff_texts(df, "a", "b", ignore_case=True).first().deleted == 0
    assert all(r.complete for r in rows) and rows[0].changed == 1
    blank = spark.createDataFrame([("a\n\nb", "a\nb\n\n")], "a string, b string")
    assert [(r.added, r.deleted) for r in textdiff.diff_texts(blank, "a", "b", ignore_blank=True).collect()] == [(0, 0)]
    pair = spark.createDataFrame([("the cat sat\nzzz", "the dog sat\nqqq")], "a string, b string")
    row = textdiff.diff_texts(pair, "a", "b").first()
    parts = {e.op: e.parts for e in row.edits if e.parts}
    assert row.changed == 2 and ["".join(p.text for p in parts[op]) for op in ("del", "add")] == ["the cat sat", "the dog sat"]
    assert "".join(p.text for p in parts["del"] if not p.changed) == "".join(p.text for p in parts["add"] if not p.changed) and [e.parts for e in row.edits if e.text in ("zzz", "qqq")] == [None, None]
    far = spark.createDataFrame([("\n".join(map(str, range(30))), "\n".join(map(str, [*range(15), "x", *range(15, 30)])))], "a string, b string")
    view = textdiff.diff_texts(far, "a", "b", context=2).first().view
    assert [(e.op, e.text) for e in view] == [("skip", "13"), ("same", "13"), ("same", "14"), ("add", "x"), ("same", "15"), ("same", "16"), ("skip", "13")]


def test_decoding(spark):
    cases = [("가나".encode("cp949"), "가나", "cp949"), ("가".encode(), "가", "utf-8"), (b"\xff\xfea\x00", "a", "utf-16-le"), (b"", "", "utf-8")]
    df = spark.createDataFrame([(bytearray(c),) for c, _, _ in cases], "c binary")
    assert [(r.d.text, r.d.encoding) for r in df.select(files.decoded("c").alias("d")).collect()] == [(t, e) for _, t, e in cases]
    row = spark.createDataFrame([("가👍",)], "t string").select(files.encoded_cp949("t").alias("e")).first().e
    assert bytes(row.content) == "가?".encode("cp949") and row.missing == ["👍"]
    assert spark.createDataFrame([(bytearray(b"\x89PNG\r\n\x1a\n00"),)], "c binary").select(files.image_kind(F.col("c"))).first()[0] == "png"


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿n,v\r\n001,\"x\r\ny\"\r\n , \r\n2,3,4\r\n".encode())
    (tmp_path / "b.json").write_text('[{"a": 1, "b": null}, {"a": true}]')
    (tmp_path / "c.json").write_text('[{"a": [1]}]')
    (tmp_path / "d.xlsx").write_bytes(files.xlsx_bytes([("S & 1", [["a", 1.5, None, True]]), ("T", [])]))
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("ok.txt", "hi")
        z.writestr("../bad.txt", "no")
    with zipfile.ZipFile(tmp_path / "f.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p/><w:p><w:t>two</w:t></w:p></w:document>')
    (tmp_path / "g.zip").write_bytes(b"not a zip")
    read = lambda name: files.binary_files(spark, f"file://{tmp_path}/{name}")
    assert [r.cells for r in files.read_csv(read("a.csv")).orderBy("row").collect()] == [["n", "v", ""], ["001", "x\r\ny", ""], ["2", "3", "4"]]
    assert [r.cells for r in files.read_json(read("b.json")).orderBy("row").collect()] == [["a", "b"], ["1", None], ["TRUE", None]]
    assert files.read_json(read("c.json")).first().error == "nested values"
    sheets = files.read_xlsx(read("d.xlsx"))
    assert [(r.sheet, r.cells, r.kinds) for r in sheets.collect()] == [("S & 1", ["a", "1.5", None, "True"], ["str", "num", "blank", "str"])]
    assert [(r.row, r.col, r.kind, r.num, r.str) for r in files.workbook_cells(sheets).orderBy("col").collect()] == [(0, 0, "str", None, "a"), (0, 1, "num", 1.5, None), (0, 3, "str", None, "True")]
    assert [(r.sheet, r.headers, r.rows) for r in tables.inspect_sheets(sheets).collect()] == [("S & 1", ["a", "1.5", None, "True"], 1)]
    assert tables.pick_sheets(sheets).count() == tables.pick_sheets(sheets, "*").count() == tables.pick_sheets(sheets, "S & 1").count() == 1 and tables.pick_sheets(sheets, "T").count() == 0
    assert [(r.name, bytes(r.data)) for r in files.read_zip(read("e.zip")).collect()] == [("ok.txt", b"hi")]
    assert files.read_zip(read("g.zip")).first().error
    assert [r.text for r in files.read_office(read("f.docx")).orderBy("pos").collect()] == ["one", "two"]
    for bad in (b"<!DOCTYPE x><x/>", b"<!--" + b"c" * 9000 + b"--><!DOCTYPE x [<!ENTITY a 'b'>]><x>&a;</x>", "<?xml version='1.0' encoding='UTF-16'?><!DOCTYPE x><x/>".encode("utf-16")):
        with pytest.raises(ValueError):
            files.parse_xml(bad)
    big = io.BytesIO()
    with zipfile.ZipFile(big, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", b"0" * 100000)
    with pytest.raises(ValueError):
        list(files.zip_entries(big.getvalue(), most_bytes=1000))


def test_more_files(spark, tmp_path):
    styles = '<styleSheet><numFmts><numFmt numFmtId="200" formatCode="yyyy/mm"/><numFmt numFmtId="201" formatCode="0.0&quot;day&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="200"/><xf numFmtId="201"/></cellXfs></styleSheet>'
    sheet = '<worksheet><sheetData><row r="2"><c r="A2" s="1"><v>45000</v></c><c r="B2" s="2"><v>45000.5</v></c><c r="C2" s="3"><v>45000</v></c><c r="D2" t="e"><v>#N/A</v></c><c r="E2" t="b"><v>1</v></c><c r="F2"><f>A2+1</f><v>45001</v></c><c r="G2" s="1"><v>59</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="s" r:id="x"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="x" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", styles)
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    ods = '<o:document-content xmlns:o="o" xmlns:t="t" xmlns:x="x"><t:table t:name="one"><t:table-row t:number-rows-repeated="3"><t:table-cell/></t:table-row><t:table-row><t:table-cell o:value-type="float" o:value="1.5"/><t:table-cell t:number-columns-repeated="2" o:value-type="string"><x:p>hi</x:p></t:table-cell><t:table-cell o:value-type="date" o:date-value="2024-01-02"/><t:table-cell t:number-columns-repeated="1000"/></t:table-row></t:table></o:document-content>'
    with zipfile.ZipFile(tmp_path / "b.ods", "w") as z:
        z.writestr("content.xml", ods)
    with zipfile.ZipFile(tmp_path / "c.odt", "w") as z:
        z.writestr("content.xml", '<d xmlns:x="x" xmlns:t="t"><x:h>Title</x:h><t:table><t:table-row><t:table-cell t:number-columns-spanned="2"><x:p>a</x:p></t:table-cell><t:covered-table-cell/></t:table-row><t:table-row><t:table-cell><x:p>b</x:p></t:table-cell><t:table-cell><x:p>c</x:p></t:table-cell></t:table-row></t:table><x:p>- end</x:p></d>')
    (tmp_path / "d.fb2").write_text("<FictionBook><description><p>no</p></description><body><section><title><p>T</p></title><p>one <b>two</b></p></section></body></FictionBook>")
    read = lambda name: files.binary_files(spark, f"file://{tmp_path}/{name}")
    row = files.read_xlsx(read("a.xlsx")).first()
    assert row.cells == ["2023-03-15", "2023-03-15 12:00:00", "45000", "#N/A", "TRUE", "45001", "1900-02-28"] and row.kinds == ["date", "date", "num", "err", "bool", "num", "date"] and row.formulas[5] == "A2+1" and row.row == 1
    row = files.read_xlsx(read("b.ods")).first()
    assert (row.sheet, row.row, row.cells, row.kinds) == ("one", 3, ["1.5", "hi", "hi", "2024-01-02"], ["num", "str", "str", "date"])
    got = [(r.kind, r.text, r.rows) for r in files.read_office(read("c.odt")).orderBy("pos").collect()]
    assert got == [("paragraph", "Title", None), ("table", None, [["a", ""], ["b", "c"]]), ("paragraph", "- end", None)]
    stats = files.document_stats(files.read_office(read("c.odt"))).first()
    assert (stats.paragraphs, stats.tables, stats.rows, stats.cells, stats.bullets) == (2, 1, 2, 4, 1)
    assert [r.text for r in files.read_office(read("d.fb2")).orderBy("pos").collect()] == ["T", "one two"]
    df = spark.createDataFrame([("001", "a,b"), ("=x", None)], "k string, v string").coalesce(1)
    tables.write_csv(df, ["k", "v"], ["key", 'v"'], f"file://{tmp_path}/out")
    [written] = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("part")]
    assert written.read_bytes() == '\ufeffkey,"v"""\r\n001,"a,b"\r\n\'=x,\r\n'.encode()
    big = large_csv.read_large_csv(spark, f"file://{tmp_path}/out", 3)
    assert [r.cells for r in big.orderBy("split", "row").collect()] == [["key", 'v"', ""], ["001", "a,b", ""], ["'=x", "", ""]]
    (tmp_path / "k.txt").write_bytes("전화 010-1234-5678".encode("cp949"))
    out = files.redacted_files(read("k.txt")).first()
    assert (bytes(out.content), out.encoding, out.lost, out.found) == ("전화 010-****-5678".encode("cp949"), "cp949", False, 1)
    labels = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "file string, sheet string")
    assert sorted(r.label for r in tables.table_labels(labels).collect()) == ["a - x", "a - y", "b"]


def test_recalculation(spark):
    num = lambda sheet, row, col, v, f=None: ("b", sheet, row, col, "num", float(v), None, None, None, f)
    schema = "book string, sheet string, row int, col int, kind string, num double, str string, bool boolean, err string, formula string"
    cells = [num("S", k, 0, k + 1) for k in range(5)] + [num("S", k, 1, 2 * k + 2, f"=A{k + 1}*2") for k in range(5)] + [("b", "S", 5, 0, "str", None, "text", None, None, None)]
    formulas = ["=SUM(B1:B5)", "=SUM(B:B)/COUNT(A1:A6)", '=IF(C1>30,"big","small")', "=SUMPRODUCT(A1:A5,$B$1:$B$5)", "=C5+A1", "=C5+C1", "=VLOOKUP(A1)", "=C7&1", "=A1/0", "=IFERROR(C9,-1)+MAX(A1:A5,100)", "=1+", "=A2", "=COUNTA(A1:A9)&AND(A1:A5)", "=A1:A3", "=SUMPRODUCT(A1:A2,B1:B3)", "=-A1^2", "=MIN(Z1:Z9)+AVERAGE(A1:A2)", "=A1=\"10\"", "=B1&\"\"", "=AVERAGE(Z1:Z2)+A1"]
    cells += [num("S", k, 2, -7, f) for k, f in enumerate(formulas)] + [num("T's", 0, 0, 0, "='S'!C1+S!A1"), num("S", 30, 0, 0, "='T''s'!A1*10")]
    before = spark.createDataFrame(cells, schema).repartition(3)
    edit = spark.createDataFrame([num("S", 0, 0, 10)], schema).drop("formula")
    changes, problems = workbook.recalculate(before, edit)
    got = {(r.sheet, r.address): next((x for x in r.after[1:] if x is not None), None) for r in changes.collect()}
    assert got == {("S", "B1"): 20.0, ("S", "C1"): 48.0, ("S", "C2"): 9.6, ("S", "C3"): "big", ("S", "C4"): 308.0, ("S", "C9"): "#DIV/0!", ("S", "C10"): 99.0, ("S", "C13"): "6TRUE", ("S", "C14"): "#VALUE!", ("S", "C15"): "#VALUE!", ("S", "C16"): 100.0, ("S", "C17"): 6.0, ("S", "C18"): False, ("S", "C19"): "20", ("S", "C20"): "#DIV/0!", ("T's", "A1"): 58.0, ("S", "A31"): 580.0}
    found = {r.address: r.problem for r in problems.collect()}
    assert set(found) == {"C5", "C6", "C7", "C8", "C11"} and "cycle" in found["C6"] and "VLOOKUP" in found["C7"] and found["C8"].startswith("reads")
    none, nothing = workbook.recalculate(before, edit.limit(0))
    assert none.count() == 0 and [r.address for r in nothing.collect()] == ["C11"]
    replaced, _ = workbook.recalculate(before, spark.createDataFrame([num("S", 0, 1, 5)], schema).drop("formula"))
    assert {r.address for r in replaced.collect()} >= {"C1", "C2"} and "B1" not in {r.address for r in replaced.collect()}


def test_stream_equals_batch(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    got = events.run_once(spark, sf, "events.parquet", f"file://{tmp_path}/out", f"file://{tmp_path}/check")
    want = events.windowed_counts(spark.read.parquet(f"{sf}/events.parquet"))
    rows = {tuple(r) for r in got.collect()}
    assert rows and rows <= {tuple(r) for r in want.collect()}
