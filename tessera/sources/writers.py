"""Documents, spreadsheets and archives written as files.

The markup of a file is an expression over its blocks or sheets and stays in
the JVM; Python only puts the parts of a container into a ZIP archive, without
times of writing, so that equal contents give equal bytes.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.texts import escape_rtf, escape_xml
from tessera.operators.blocks import blocks_html
from tessera.operators.scratch import small_batches
from tessera.sources.files import MOST_BYTES, MOST_ENTRIES

#: Namespaces and media types of the file formats.
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
DOCUMENT_LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"
WORD_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
ODF = "urn:oasis:names:tc:opendocument:xmlns"
ODF_TYPE = "application/vnd.oasis.opendocument"
FICTION_BOOK = "http://www.gribuser.ru/xml/fictionbook/2.0"
#: Endings of files that are compressed already.
COMPRESSED = {"7z", "avif", "docx", "epub", "gif", "gz", "heic", "hwpx", "jpeg", "jpg", "mp3", "mp4", "odp", "ods", "odt", "png", "pptx", "rar", "webp", "xlsx", "zip", "zst"}
DOCUMENT_FORMATS = ("docx", "epub", "fb2", "fodt", "odt", "rtf")
EARLIEST = (1980, 1, 1, 0, 0, 0)
#: Names that ``files.safe_path`` refuses: empty, absolute, with a drive, a zero character or a part that leads upwards.
UNSAFE = r"^$|^[/\\]|^[A-Za-z]:|\x00|(^|[/\\])\.\.([/\\]|$)"


def joined(items: Column, f, sep: str = "") -> Column:
    return F.array_join(F.transform(items, f), sep)


def between(tag: str, inside: Column, attributes: str = "") -> Column:
    return F.concat(F.lit(f"<{tag}{' ' if attributes else ''}{attributes}>"), inside, F.lit(f"</{tag}>"))


def unified_lines(text: Column) -> Column:
    """Text without nulls, its line ends \\n."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n|\r", "\n")


def by_kind(blocks: Column, paragraph, table, sep: str = "") -> Column:
    """Markup of all blocks: ``paragraph`` of a text, ``table`` of rows; a null list has no blocks."""
    each = lambda b: F.when(b["kind"] == "table", table(F.coalesce(b["rows"], F.array().cast("array<array<string>>")))).otherwise(paragraph(b["text"]))
    return F.coalesce(joined(blocks, each, sep), F.lit(""))


def docx_xml(blocks: Column) -> Column:
    """The main part of a DOCX file; tabs and line ends inside a paragraph are elements between its texts."""
    piece = lambda x: between("w:t", escape_xml(x), 'xml:space="preserve"')
    line = lambda x: joined(F.split(x, "\t"), piece, "<w:tab/>")
    paragraph = lambda x: between("w:p", between("w:r", joined(F.split(unified_lines(x), "\n"), line, "<w:br/>")))
    widest = lambda rows: F.greatest(F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(1)), F.lit(1))

    def table(rows: Column) -> Column:
        cells = lambda r: between("w:tr", joined(r, lambda c: between("w:tc", paragraph(c))))
        grid = between("w:tblGrid", F.repeat(F.lit("<w:gridCol/>"), widest(rows)))
        return between("w:tbl", F.concat(F.lit("<w:tblPr/>"), grid, joined(F.filter(rows, lambda r: F.size(r) > 0), cells)))

    return between("w:document", between("w:body", F.concat(by_kind(blocks, paragraph, table), F.lit("<w:sectPr/>"))), f'xmlns:w="{WORD}"')


def odf_paragraph(text: Column) -> Column:
    """A paragraph of OpenDocument, in which only the first of several blanks is a character."""
    marked = F.regexp_replace(escape_xml(unified_lines(text)), r"(?<![^ \n\t]) | (?=\n|\t|\z)", "<text:s/>")
    return between("text:p", F.replace(F.replace(marked, F.lit("\t"), F.lit("<text:tab/>")), F.lit("\n"), F.lit("<text:line-break/>")))


def odf_xml(body: Column, kind: str, flat: bool) -> Column:
    """A whole flat document of ``kind`` (text, spreadsheet), or the content part of an archive."""
    spaces = " ".join(f'xmlns:{x}="{ODF}:{x}:1.0"' for x in ("office", "text", "table"))
    tag = "office:document" if flat else "office:document-content"
    own = f' office:mimetype="{ODF_TYPE}.{kind}"' if flat else ""
    return between(tag, between("office:body", between(f"office:{kind}", body)), f'{spaces} office:version="1.2"{own}')


def odf_text(blocks: Column) -> Column:
    cells = lambda r: between("table:table-row", joined(r, lambda c: between("table:table-cell", odf_paragraph(c), 'office:value-type="string"')))
    return by_kind(blocks, odf_paragraph, lambda rows: between("table:table", joined(rows, cells)))


def odf_sheets(sheets: Column) -> Column:
    """Tables of ``sheets``, an array<struct<name, rows array<array<struct<kind, text>>>>> with the kinds of ``read_xlsx``."""

    def cell(c: Column) -> Column:
        text = escape_xml(F.coalesce(c["text"], F.lit("")))
        valued = lambda kind, name, v: F.concat(F.lit(f'<table:table-cell office:value-type="{kind}" office:{name}="'), v, F.lit('">'), odf_paragraph(c["text"]), F.lit("</table:table-cell>"))
        return (
            F.when(c["text"].isNull() | (c["kind"] == "blank"), F.lit("<table:table-cell/>"))
            .when(c["kind"] == "num", valued("float", "value", text))
            .when(c["kind"] == "bool", valued("boolean", "boolean-value", F.lower(text)))
            .when(c["kind"] == "date", valued("date", "date-value", F.replace(text, F.lit(" "), F.lit("T"))))
            .otherwise(between("table:table-cell", odf_paragraph(c["text"]), 'office:value-type="string"'))
        )

    table = lambda s: F.concat(F.lit('<table:table table:name="'), escape_xml(s["name"]), F.lit('">'), joined(s["rows"], lambda r: between("table:table-row", joined(r, cell))), F.lit("</table:table>"))
    return F.coalesce(joined(sheets, table), F.lit(""))


def fb2_xml(blocks: Column, title: Column) -> Column:
    line = lambda x: F.when(F.trim(x) == "", F.lit("<empty-line/>")).otherwise(between("p", escape_xml(x)))
    table = lambda rows: between("table", joined(rows, lambda r: between("tr", joined(r, lambda c: between("td", escape_xml(F.coalesce(c, F.lit(""))))))))
    name = between("title-info", F.concat(F.lit("<genre>unrecognised</genre><author><nickname>unknown</nickname></author>"), between("book-title", title), F.lit("<lang>ko</lang>")))
    body = by_kind(blocks, lambda x: joined(F.split(unified_lines(x), "\n"), line), table)
    return between("FictionBook", F.concat(between("description", name), between("body", between("section", body))), f'xmlns="{FICTION_BOOK}"')


def blocks_rtf(blocks: Column) -> Column:
    """RTF in ASCII: a paragraph a block, a row of a table a paragraph with tabs."""
    own = lambda x: escape_rtf(F.coalesce(x, F.lit("")))
    rows = lambda r: joined(r, lambda c: joined(c, own, "\\tab "), "\\par\n")
    return F.concat(F.lit("{\\rtf1\\ansi\\deff0\\uc1 "), by_kind(blocks, own, rows, "\\par\n"), F.lit("}"))


def zipped(entries: list[tuple[str, bytes]], mimetype: str | None = None) -> bytes:
    """A ZIP archive; what is compressed already is stored, and a media type goes first, stored, as its formats ask."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, data in ([("mimetype", mimetype.encode())] if mimetype else []) + entries:
            bare = name == "mimetype" or name.rpartition(".")[2].lower() in COMPRESSED
            info = zipfile.ZipInfo(name, EARLIEST)
            z.writestr(info, data, zipfile.ZIP_STORED if bare else zipfile.ZIP_DEFLATED)
    return buffer.getvalue()


def in_archive(parts: dict[str, Column], mimetype: str | None = None) -> Column:
    """The bytes of an archive of text parts, one archive a row."""
    names = list(parts)

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([zipped([(n, t.encode()) for n, t in zip(names, texts, strict=True)], mimetype) for texts in batch.itertuples(index=False, name=None)])

    return run(F.struct(*[p.alias(f"p{k}") for k, p in enumerate(parts.values())]))


def odf_archive(content: Column, kind: str) -> Column:
    entry = lambda path, of: f'<manifest:file-entry manifest:full-path="{path}" manifest:media-type="{of}"/>'
    manifest = f'<manifest:manifest xmlns:manifest="{ODF}:manifest:1.0" manifest:version="1.2">{entry("/", f"{ODF_TYPE}.{kind}")}{entry("content.xml", "text/xml")}</manifest:manifest>'
    return in_archive({"content.xml": content, "META-INF/manifest.xml": F.lit(manifest)}, f"{ODF_TYPE}.{kind}")


def epub_archive(blocks: Column, title: Column, modified: str) -> Column:
    """A book of one page; its identifier is a digest of what it holds."""
    head = between("head", between("title", title))
    page = between("html", F.concat(head, between("body", blocks_html(F.coalesce(blocks, F.array().cast("array<struct<kind string, text string, rows array<array<string>>>>"))))), 'xmlns="http://www.w3.org/1999/xhtml"')
    link = between("nav", between("ol", between("li", between("a", title, 'href="page.xhtml"'))), 'epub:type="toc"')
    contents = between("html", F.concat(head, between("body", link)), 'xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"')
    digest = between("dc:identifier", F.concat(F.lit("urn:sha256:"), F.sha2(F.concat(title, page), 256)), 'id="own"')
    about = between("metadata", F.concat(digest, between("dc:title", title), F.lit(f'<dc:language>ko</dc:language><meta property="dcterms:modified">{modified}</meta>')), 'xmlns:dc="http://purl.org/dc/elements/1.1/"')
    xhtml = 'media-type="application/xhtml+xml"'
    items = f'<manifest><item id="page" href="page.xhtml" {xhtml}/><item id="contents" href="contents.xhtml" {xhtml} properties="nav"/></manifest><spine><itemref idref="page"/></spine>'
    book = between("package", F.concat(about, F.lit(items)), 'xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="own"')
    container = f'<container version="1.0" xmlns="{ODF}:container"><rootfiles><rootfile full-path="book/book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    return in_archive({"META-INF/container.xml": F.lit(container), "book/book.opf": book, "book/page.xhtml": page, "book/contents.xhtml": contents}, "application/epub+zip")


def document_bytes(blocks: Column, title: Column, form: str, modified: str = "2000-01-01T00:00:00Z") -> Column:
    """The bytes of a document of ``blocks`` (see ``operators.blocks``) in one of ``DOCUMENT_FORMATS``.

    Null blocks give a document without content, a null title an empty one.
    Characters that XML does not allow are left out.
    """
    name = escape_xml(F.coalesce(title, F.lit("")))
    if form == "docx":
        types = f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="xml" ContentType="application/xml"/><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="{WORD_TYPE}"/></Types>'
        links = f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{DOCUMENT_LINK}" Target="word/document.xml"/></Relationships>'
        return in_archive({"[Content_Types].xml": F.lit(types), "_rels/.rels": F.lit(links), "word/document.xml": docx_xml(blocks)})
    if form == "odt":
        return odf_archive(odf_xml(odf_text(blocks), "text", flat=False), "text")
    if form == "epub":
        return epub_archive(blocks, name, modified)
    texts = {"fodt": lambda: odf_xml(odf_text(blocks), "text", flat=True), "fb2": lambda: fb2_xml(blocks, name), "rtf": lambda: blocks_rtf(blocks)}
    if form not in texts:
        raise ValueError(f"no document format: {form}")
    return F.encode(texts[form](), "UTF-8")


def spreadsheet_bytes(sheets: Column, form: str) -> Column:
    """The bytes of an ODS or FODS workbook of ``sheets`` (see ``odf_sheets``)."""
    if form not in ("ods", "fods"):
        raise ValueError(f"no spreadsheet format: {form}")
    content = odf_xml(odf_sheets(sheets), "spreadsheet", flat=form == "fods")
    return F.encode(content, "UTF-8") if form == "fods" else odf_archive(content, "spreadsheet")


def free_name(name: str, used: set[str]) -> str:
    """``name``, or with the first free number before its ending; ``used`` holds names in lower case and gets the new one."""
    folder, slash, file = name.rpartition("/")
    stem, dot, ending = file.rpartition(".")
    if not stem:
        stem, dot, ending = file, "", ""
    k = 1
    while name.lower() in used:
        k += 1
        name = f"{folder}{slash}{stem} ({k}){dot}{ending}"
    used.add(name.lower())
    return name


def archives(entries: DataFrame, most_entries: int = MOST_ENTRIES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(archive, content, error): a ZIP file of the entries (archive, name, data) of each archive, in the order of their names.

    Names that are there already get a number, null data counts as empty, and
    other columns are ignored.  An archive is one file and so one task's work:
    one of more entries or bytes than the limits of ``files.zip_entries``, or
    with a null or unsafe name, is not built and comes out with its error, told
    from counts before any entry is gathered.
    """
    unsafe = F.coalesce(F.col("name").rlike(UNSAFE), F.lit(True))
    own = entries.select("archive", "name", F.coalesce("data", F.lit(b"")).alias("data"))
    sums = own.groupBy("archive").agg(F.count("*").alias("n"), F.sum(F.octet_length("data")).alias("size"), F.count_if(unsafe).alias("unsafe"))
    error = F.when(F.col("unsafe") > 0, "a name is missing or unsafe").when(F.col("n") > most_entries, "too many entries").when(F.col("size") > most_bytes, "too large")
    judged = sums.select("archive", error.alias("error"))

    def write(own: list[dict]) -> bytes:
        used: set[str] = set()
        return zipped([(free_name(n, used), d) for n, d in sorted((e["name"], bytes(e["data"])) for e in own)])

    @F.pandas_udf("binary")
    def written(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(write)

    small_batches(entries.sparkSession)
    fits = judged.filter("error IS NULL").select(F.col("archive").alias("fitting"))
    held = own.join(fits, F.col("archive").eqNullSafe(F.col("fitting")), "left_semi")
    gathered = held.groupBy("archive").agg(F.collect_list(F.struct("name", "data")).alias("entries"))
    built = gathered.select("archive", written("entries").alias("content"), F.lit(None).cast("string").alias("error"))
    return built.unionByName(judged.filter("error IS NOT NULL").select("archive", F.lit(None).cast("binary").alias("content"), "error"))
