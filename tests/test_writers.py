"""Files written and read back."""

from __future__ import annotations

import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.functions import identifiers
from tessera.operators.blocks import BLOCKS
from tessera.sources import files, writers

TEXT = "a  b & <c>\t'd' \"e\"\n 日本 👍 x\x01y "
ROWS = [["h", None], ["1  2", "é"], []]


def read_back(spark, name, content):
    made = spark.createDataFrame([(name, bytearray(content))], "path string, content binary")
    rows = files.read_office(made).orderBy("pos").collect()
    assert all(r.error is None for r in rows), rows
    return [(r.kind, r.text, r.rows) for r in rows]


def test_documents(spark):
    odd = [("doc", [("paragraph", TEXT, None), ("table", None, ROWS), ("paragraph", None, None), ("table", None, None)]), (None, None), ("empty", [])]
    df = spark.createDataFrame(odd, f"title string, blocks {BLOCKS}").coalesce(1)
    got = df.select(*[writers.document_bytes(F.col("blocks"), F.col("title"), f).alias(f) for f in writers.DOCUMENT_FORMATS]).collect()
    clean, table = TEXT.replace("\x01", ""), ("table", None, [["h", ""], ["1 2", "é"]])
    for form in ("docx", "odt", "fodt"):
        assert read_back(spark, f"a.{form}", got[0][form]) == [("paragraph", clean, None), table]
    assert read_back(spark, "a.fb2", got[0].fb2)[:2] == [("paragraph", x, None) for x in clean.split("\n")]
    kinds = [b[0] for b in read_back(spark, "a.epub", got[0].epub)]
    assert kinds[0] == "paragraph" and "table" in kinds
    with zipfile.ZipFile(io.BytesIO(got[0].epub)) as z:
        first = z.infolist()[0]
        assert (first.filename, first.compress_type, z.read(first)) == ("mimetype", zipfile.ZIP_STORED, b"application/epub+zip")
    for row in got[1:]:
        for form in ("docx", "odt", "fodt", "fb2", "epub"):
            assert read_back(spark, f"b.{form}", row[form]) == []
    with pytest.raises(ValueError):
        writers.document_bytes(F.col("blocks"), F.col("title"), "pdf")


def test_rtf_is_ascii(spark):
    df = spark.createDataFrame([([("paragraph", "a{é\\", None), ("table", None, [["👍", "b"], ["c", None]])],)], f"blocks {BLOCKS}")
    text = bytes(df.select(writers.document_bytes(F.col("blocks"), F.lit("t"), "rtf").alias("c")).first().c).decode("ascii")
    assert text == "{\\rtf1\\ansi\\deff0\\uc1 a\\{\\u233?\\\\\\par\n\\u-10179?\\u-9139?\\tab b\\par\nc\\tab }"


def test_sheets(spark):
    schema = "array<struct<name string, rows array<array<struct<kind string, text string>>>>>"
    rows = [[("num", "1.5"), ("blank", None), ("date", "2024-02-29 10:00:00")], [], [("str", " a  b\n<"), ("bool", "TRUE"), ("str", None)]]
    df = spark.createDataFrame([([("S & 'T'", rows), ("U", [])],), (None,)], f"sheets {schema}").coalesce(1)
    for form in ("ods", "fods"):
        first, none = df.select(writers.spreadsheet_bytes(F.col("sheets"), form).alias("c")).collect()
        made = spark.createDataFrame([("a", first.c)], "path string, content binary")
        got = [(r.sheet, r.row, r.cells, r.kinds) for r in files.read_xlsx(made).orderBy("row").collect()]
        assert got == [("S & 'T'", 0, ["1.5", None, "2024-02-29 10:00:00"], ["num", "blank", "date"]), ("S & 'T'", 2, [" a  b\n<", "TRUE"], ["str", "bool"])]
        assert files.read_xlsx(spark.createDataFrame([("b", none.c)], "path string, content binary")).count() == 0


def test_archives(spark):
    names = ["x/a.txt", "x/A.txt", "x/a.txt", "noending", "noending", ".hidden", ".hidden", "p.png"]
    rows = [("one", n, bytearray(b"%d" % k), "own") for k, n in enumerate(names)] + [("bad", "../up", None, "own"), ("bad", "ok", None, None), ("nameless", None, None, None)]
    rows += [("many", f"f{k}", bytearray(b"."), None) for k in range(20)] + [("large", "f", bytearray(5000), None), (None, "n", None, None)]
    out = writers.archives(spark.createDataFrame(rows, "archive string, name string, data binary, error string"), most_entries=10, most_bytes=4000)
    got = {r.archive: r for r in out.collect()}
    assert {a: r.error for a, r in got.items()} == {"one": None, None: None, "bad": "a name is missing or unsafe", "nameless": "a name is missing or unsafe", "many": "too many entries", "large": "too large"}
    entries = dict(files.zip_entries(bytes(got["one"].content)))
    assert entries == {".hidden": b"5", ".hidden (2)": b"6", "noending": b"3", "noending (2)": b"4", "p.png": b"7", "x/A.txt": b"1", "x/a (2).txt": b"0", "x/a (3).txt": b"2"}
    assert dict(files.zip_entries(bytes(got[None].content))) == {"n": b""}
    kinds = {i.filename: i.compress_type for i in zipfile.ZipFile(io.BytesIO(got["one"].content)).infolist()}
    assert kinds["p.png"] == zipfile.ZIP_STORED and kinds["noending"] == zipfile.ZIP_DEFLATED
    assert writers.archives(spark.createDataFrame([], "archive string, name string, data binary")).count() == 0


@pytest.mark.parametrize("name", ["", "/a", "\\a", "c:x", "a\0b", "..", "a/../b", "a\\..", "a..b", "..a/b", "a/b", "a:b"])
def test_unsafe_names_are_those_of_the_reader(name):
    assert (re.search(writers.UNSAFE, name) is None) == files.safe_path(name)


def test_corporate_types(spark):
    got = spark.createDataFrame([("1101111234567",), ("110199-1234567",)], "n string").select(identifiers.check_number(F.col("n"))["type"]).collect()
    assert [r[0] for r in got] == ["stock company", None]


def test_archives_and_patches_take_no_python_call_per_group(spark):
    """Python gets batches of gathered rows; a call for each archive or file costs more than its work."""
    from tessera.sources import patches, writers

    entries = spark.createDataFrame([(1, "a", b"x")], "archive long, name string, data binary")
    edits = spark.createDataFrame([], "path string, sheet string, row int, col int, kind string, num double, str string, bool boolean, err string")
    books = spark.createDataFrame([("p", b"")], "path string, content binary")
    for df in (writers.archives(entries), patches.patched_workbooks(books, edits)):
        assert "GroupsInPandas" not in df._jdf.queryExecution().toString()


def test_files_reach_python_in_small_batches(spark):
    from tessera.sources import files

    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    files.read_xlsx(spark.createDataFrame([("p", b"")], "path string, content binary"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_tag_names_are_cut_once():
    """Of a table of 4,000 elements each name is taken from its tag once."""
    xml = f'<FictionBook xmlns="{writers.FICTION_BOOK}"><body><section><table>{"<tr><td>a</td><td>b</td><td>c</td></tr>" * 1000}</table></section></body></FictionBook>'
    files.local.cache_clear()
    assert [len(b["rows"]) for b in files._office("x.fb2", xml.encode())] == [1000] and files.local.cache_info().misses < 10
