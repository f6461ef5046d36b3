"""Files of all endings, whole and damaged."""

from __future__ import annotations

import json

from tessera.sources import files, imports, writers

XML = """<?xml version="1.0"?><Workbook xmlns="urn:schemas-microsoft-com:office:spreadsheet" xmlns:ss="urn:schemas-microsoft-com:office:spreadsheet"><Worksheet ss:Name="A"><Table>
<Row><Cell><Data ss:Type="String">x</Data></Cell><Cell ss:Index="3" ss:Formula="=RC[-2]"><Data ss:Type="Number">1.5</Data></Cell></Row><Row/><Row ss:Index="5"><Cell ss:MergeAcross="1"><Data ss:Type="Boolean">1</Data></Cell><Cell><Data ss:Type="DateTime">2024-02-29T00:00:00.000</Data></Cell></Row></Table></Worksheet></Workbook>"""


def frame(spark, rows):
    return spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in rows], "path string, content binary").coalesce(1)


def test_sheets(spark):
    own = [("d/a.csv", b"k,v\n001,\n"), ("b.TSV", "k\tv\n가\t1".encode()), ("c.json", json.dumps([{"a": 1, "b": None}, {"a": True, "b": "x"}]).encode()), ("d.xml", XML.encode()), ("e.xlsx", files.xlsx_bytes([("S", [["n", 2]])]))]
    got = {}
    for r in imports.read_sheets(frame(spark, own)).orderBy("path", "row").collect():
        assert r.error is None, r
        got.setdefault(r.path, []).append((r.sheet, r.row, r.cells, r.kinds))
    assert got["d/a.csv"] == [("Sheet1", 0, ["k", "v"], ["str"] * 2), ("Sheet1", 1, ["001", ""], ["str"] * 2)]
    assert got["b.TSV"][1] == ("Sheet1", 1, ["가", "1"], ["str"] * 2)
    assert got["c.json"] == [("Sheet1", 0, ["a", "b"], ["str"] * 2), ("Sheet1", 1, ["1", None], ["num", "blank"]), ("Sheet1", 2, ["TRUE", "x"], ["bool", "str"])]
    assert got["d.xml"] == [("A", 0, ["x", None, "1.5"], ["str", "blank", "num"]), ("A", 4, ["TRUE", None, "2024-02-29 00:00:00"], ["bool", "blank", "date"])]
    assert got["e.xlsx"] == [("S", 0, ["n", "2"], ["str", "num"])]


def test_documents(spark):
    book = '<FictionBook><body><p>one</p></body><body name="notes"><p>note</p></body></FictionBook>'
    own = [("x/a.txt", b"one\n\n# two\n"), ("b.md", b"# H\n\ntext"), ("c.html", b"<p>p</p><script>no</script>"), ("d.fb2", book.encode()), ("no ending", b"x"), ("e.txt", b"")]
    got = {}
    for r in imports.read_documents(frame(spark, own)).orderBy("path", "pos").collect():
        got.setdefault(r.path, []).append((r.title, r.kind, r.text, bool(r.error)))
    assert got == {
        "x/a.txt": [("a", "paragraph", "one", False), ("a", "paragraph", "", False), ("a", "paragraph", "# two", False)], "b.md": [("b", "heading1", "H", False), ("b", "paragraph", "text", False)], "c.html": [("c", "paragraph", "p", False)],
        "d.fb2": [("d", "paragraph", "one", False), ("d", "paragraph", "note", False)], "no ending": [(None, None, None, True)],
    }


def test_damaged_files_are_rows_with_errors(spark):
    parts = lambda **more: [(n, t.encode()) for n, t in more.items()]
    shared = [("xl/workbook.xml", b'<w><sheet name="a" id="1"/></w>'), ("xl/_rels/workbook.xml.rels", b'<r><x Id="1" Target="s.xml"/></r>'), ("xl/s.xml", b'<s><row r="1"><c r="A1" t="s"><v>7</v></c></row></s>'), ("xl/sharedStrings.xml", b"<sst/>")]
    bad = [("a.xlsx", writers.zipped(shared)), ("b.xlsx", writers.zipped([("xl/workbook.xml", b"<w/>")])), ("c.xlsx", b"PK\x03\x04"), ("d.json", b"[1]"), ("e.json", b"[" * 100000), ("f.csv", b"\xff\xfe\x00"), ("g.xml", b"<a/>"), ("h.ods", b""), ("i.dbf", b"x"), ("j.csv", None)]
    out = imports.read_sheets(frame(spark, bad)).collect()
    assert sorted(r.path for r in out if r.error) == sorted(p for p, _ in bad)
    bad = [("a.epub", writers.zipped([("META-INF/container.xml", b"<c/>")])), ("b.fb2", b"<FictionBook/>"), ("c.docx", writers.zipped(parts(other="x"))), ("d.md", None)]
    assert sorted(r.path for r in imports.read_documents(frame(spark, bad)).collect() if r.error) == [p for p, _ in bad]
    long = "x" * 200000
    assert [len(r.cells[0]) for r in files.read_csv(frame(spark, [("a.csv", long.encode())])).collect()] == [200000]
