"""XLSX files with some cells changed."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from tessera.sources import files, patches, writers

SHEET = (
    '<?xml version="1.0" encoding="UTF-8"?>\n<worksheet xmlns="m"><cols><col min="1"/></cols><sheetData><row r="1" ht="20"><c r="A1" s="3"><v>1</v></c><c s="4" r="B1" t="s"><v>0</v></c>'
    '<c r="C1" s="5"><f t="shared" ref="C1:C2" si="0">A1*2 &lt; 3</f><v>2</v></c><c r="D1" s="6"/></row><row r="2"><c r="C2" t="str"><f si="0"/></c><c r="A2" t="b"><v>1</v></c></row></sheetData><mergeCells count="1"/></worksheet>'
)


def book(workbook='<workbook xmlns="m" xmlns:r="r"><sheets><sheet name="S &amp; 1" r:id="i"/></sheets><definedNames/></workbook>', sheet=SHEET):
    parts = {"xl/workbook.xml": workbook, "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="i" Target="worksheets/s.xml"/></Relationships>', "xl/worksheets/s.xml": sheet}
    parts |= {"xl/sharedStrings.xml": "<sst><si><t>old</t></si></sst>", "xl/styles.xml": "<styleSheet/>"}
    return writers.zipped([(n, t.encode()) for n, t in parts.items()])


def value(at, kind, v, sheet="S & 1"):
    return {"sheet": sheet, "address": at, "kind": kind, "num": None, "str": None, "bool": None, "err": None} | ({kind: v} if kind != "blank" else {})


def test_only_the_wanted_bytes_change():
    edits = [value("A1", "num", 2.5), value("B1", "str", "é <new>\n"), value("C1", "err", "#N/A"), value("C2", "bool", True), value("D1", "num", 1.0), value("A2", "num", 1.0), value("Z9", "num", 1.0), value("A1", "num", 1.0, "T")]
    out, problems = patches.patch_xlsx(book(), edits)
    want = SHEET.replace('<c r="A1" s="3"><v>1</v></c>', '<c r="A1" s="3"><v>2.5</v></c>').replace('<c s="4" r="B1" t="s"><v>0</v></c>', '<c s="4" r="B1" t="inlineStr"><is><t xml:space="preserve">é &lt;new&gt;\n</t></is></c>')
    want = want.replace('<c r="C1" s="5">', '<c r="C1" s="5" t="e">').replace("<v>2</v>", "<v>#N/A</v>").replace('<c r="C2" t="str"><f si="0"/></c>', '<c r="C2" t="b"><f si="0"/><v>1</v></c>')
    before, after = dict(files.zip_entries(book())), dict(files.zip_entries(out))
    assert after["xl/worksheets/s.xml"].decode() == want
    assert after["xl/workbook.xml"].decode().endswith('<definedNames/><calcPr fullCalcOnLoad="1"/></workbook>')
    assert [n for n in before if before[n] != after[n]] == ["xl/workbook.xml", "xl/worksheets/s.xml"] and list(before) == list(after)
    assert [(p["sheet"], p["address"]) for p in problems] == [("S & 1", "D1"), ("S & 1", "A2"), ("S & 1", "Z9"), ("T", "A1")]
    settings = book('<x:workbook xmlns:x="m" xmlns:r="r"><x:sheets><x:sheet name="S &amp; 1" r:id="i"/></x:sheets><x:calcPr calcId="1" fullCalcOnLoad="0"></x:calcPr></x:workbook>')
    assert b'<x:calcPr calcId="1" fullCalcOnLoad="1"/></x:workbook>' in dict(files.zip_entries(patches.patch_xlsx(settings, edits)[0]))["xl/workbook.xml"]


def test_nothing_to_change_and_kinds():
    for kind, v in (("str", "x"), ("bool", True), ("blank", None)):
        out, problems = patches.patch_xlsx(book(), [value("A1", kind, v)])
        assert out == book() and len(problems) == 1
    out, problems = patches.patch_xlsx(book(), [value("C1", "blank", None)])
    assert b'<c r="C1" s="5"><f t="shared" ref="C1:C2" si="0">A1*2 &lt; 3</f></c>' in dict(files.zip_entries(out))["xl/worksheets/s.xml"] and not problems


def test_patched_workbooks(spark):
    good, bad = book(), book(sheet='<!DOCTYPE x [<!ENTITY e "1">]>' + SHEET.partition("\n")[2])
    made = spark.createDataFrame([("a", good, "own"), ("a", good, None), ("b", b"no file", "o"), ("c", bad, "o"), ("d", good, "o"), ("e", None, "o")], "path string, content binary, error string")
    rows = [("a", "S & 1", 0, 0, 7.0), ("a", "S & 1", 0, 0, 9.0), ("a", "none", 0, 0, 9.0), ("a", None, 0, 0, 9.0), ("b", "S & 1", 0, 0, 9.0), ("c", "S & 1", 0, 0, 9.0), ("e", "S & 1", 0, 0, 9.0), ("x", "S & 1", 0, 0, 9.0), (None, "S", 0, 0, 1.0)]
    edits = spark.createDataFrame(rows, "path string, sheet string, row int, col int, v double").select("path", "sheet", "row", "col", *patches.edit("num", F.col("v")))
    got = patches.patched_workbooks(made, edits).orderBy("path").collect()
    assert [(r.path, [tuple(p) for p in r.problems], bool(r.error)) for r in got] == [("a", [("none", "A1", "no such sheet")], False)] * 2 + [("b", [], True), ("c", [], True), ("d", [], False), ("e", [], False)]
    assert b'<c r="A1" s="3"><v>9</v></c>' in dict(files.zip_entries(bytes(got[0].content)))["xl/worksheets/s.xml"]
    assert [None if r.content is None else bytes(r.content) for r in got[2:]] == [b"no file", bad, good, None]
    assert zipfile.is_zipfile(io.BytesIO(got[1].content))
    assert patches.patched_workbooks(made.limit(0), edits).count() == 0
