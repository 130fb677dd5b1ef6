"""Queries of the readers: files of every kind are made of test tables and read back, with their SQL.

The makers below write the least that a file of its kind needs; they are fixtures, not exporters.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable, Iterator
from html import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.registry import query, table
from millrace.sources import code, formats, readers


def _zipped(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


_REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _pdf(text: str) -> bytes:
    shown = text.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
    body = zlib.compress(f"BT /F1 12 Tf ({shown}) Tj ET".encode("latin-1", "replace"))
    return b"%PDF-1.4\n1 0 obj\n<</Length " + str(len(body)).encode() + b" /Filter /FlateDecode>>\nstream\n" + body + b"\nendstream\nendobj\n"


#: Makers of files by extension, from a number and a line of text.
MAKERS: dict[str, Callable[[int, str], bytes]] = {
    "docx": lambda n, t: _zipped({"word/document.xml": f'<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>doc {n}</w:t></w:r></w:p><w:p><w:r><w:t>{escape(t)}</w:t></w:r></w:p></w:body></w:document>'}),
    "xlsx": lambda n, t: _zipped({
        "xl/workbook.xml": f'<workbook {_REL}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst><si><t>{escape(t)}</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet><sheetData><row r="1"><c r="A1"><v>{n}</v></c><c r="C1" t="s"><v>0</v></c></row></sheetData></worksheet>',
    }),
    "pptx": lambda n, t: _zipped({
        "ppt/slides/slide1.xml": f'<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:t>slide {n}</a:t></a:p></p:sp><p:sp><a:p><a:t>{escape(t)}</a:t></a:p></p:sp></p:sld>',
        "ppt/notesSlides/notesSlide1.xml": '<p:notes xmlns:p="p" xmlns:a="a"><a:p><a:t>note</a:t></a:p></p:notes>',
    }),
    "odt": lambda n, t: _zipped({"content.xml": f'<o:doc xmlns:o="o" xmlns:text="t"><text:p>{escape(t)}</text:p><text:h>head {n}</text:h></o:doc>'}),
    "ods": lambda n, t: _zipped({"content.xml": f'<o:doc xmlns:o="o" xmlns:table="t"><table:table><table:table-row><table:table-cell>{n}</table:table-cell><table:table-cell>{escape(t)}</table:table-cell></table:table-row></table:table></o:doc>'}),
    "odp": lambda n, t: _zipped({"content.xml": f'<o:doc xmlns:o="o" xmlns:d="d" xmlns:text="t"><d:page><text:p>{n}</text:p></d:page><d:page><text:p>{escape(t)}</text:p></d:page></o:doc>'}),
    "epub": lambda n, t: _zipped({
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>',
        "o/p.opf": '<package><manifest><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="c" href="c.css" media-type="text/css"/></manifest><spine><itemref idref="a"/><itemref idref="b"/><itemref idref="c"/></spine></package>',
        "o/a.xhtml": f"<html><body><h1>one {n}</h1></body></html>",
        "o/b.xhtml": f"<html><body><p>{escape(t)}</p></body></html>",
        "o/c.css": "p {}",
    }),
    "vsdx": lambda n, t: _zipped({"visio/pages/page1.xml": f"<Page><Text>{escape(t)}</Text><Text>{n}</Text></Page>"}),
    "mm": lambda n, t: f'<map><node TEXT="root {n}"><node TEXT="{escape(t)}"/></node></map>'.encode(),
    "rss": lambda n, t: f"<rss><channel><item><title>title {n}</title><link>http://x/{n}</link><description>{escape(t)}</description></item></channel></rss>".encode(),
    "tex": lambda n, t: f"\\title{{title {n}}}\n\\begin{{document}}% note\n\\section{{head}}\n{t} $x_1$\n\\end{{document}}".encode(),
    "eml": lambda n, t: f'Subject: mail {n}\nContent-Type: multipart/alternative; boundary="q"\n\n--q\nContent-Type: text/html\n\n<p>other</p>\n--q\nContent-Type: text/plain\n\n{t}\n--q--\n'.encode(),
    "srt": lambda n, t: f"1\n00:00:01,000 --> 00:00:02,000\ncaption {n}\n\n2\n00:00:02,000 --> 00:00:03,000\n{t}\n".encode(),
    "vtt": lambda n, t: f"WEBVTT\n\n00:00:01.000 --> 00:00:02.000\ncaption {n}\n{t}\n".encode(),
    "rtf": lambda n, t: f"{{\\rtf1\\ansi {{\\fonttbl{{\\f0 Arial;}}}} rtf {n}\\par {t}}}".encode(),
    "html": lambda n, t: f"<html><head><title>x</title></head><body><p>html {n}</p><script>no</script><p>{escape(t)}</p></body></html>".encode(),
    "pdf": lambda n, t: _pdf(f"pdf {n} {t}"),
    "json": lambda n, t: f'{{"n": {n}, "a": {{"b": null}}}}'.encode(),
    "ndjson": lambda n, t: f'{{"n": {n}}}\nbad line\n{{"m": true}}\n'.encode(),
    "csv": lambda n, t: f'id,text\r\n{n},"a ""b"" | c"\r\n'.encode(),
    "md": lambda n, t: b"\xef\xbb\xbf" + f"# {n}\r\n{t}\rend".encode(),
    "xyz": lambda n, t: t.encode(),
}


def _files(spark, sf_dir) -> DataFrame:
    """(path, content): a file of every kind for each benchmark passage, of its first letters alone."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.trim(F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 120), "[^A-Za-z]+", " ")).alias("line"))

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = [(f"/in/{n}.{kind}", make(n, line)) for n, line in zip(part["item_id"], part["line"], strict=True) for kind, make in MAKERS.items()]
            yield pd.DataFrame(made, columns=["path", "content"])

    return rows.mapInPandas(work, "path string, content binary")


_LINE = "trim(regexp_replace(substr(text, 1, 120), '[^A-Za-z]+', ' ', 'g'))"
_EXPECTED = {
    "docx": "'doc ' || n || nl || t", "xlsx": "'S' || nl || '| ' || n || ' |  | ' || t || ' |' || nl || '| --- | --- | --- |'",
    "pptx": "'slide ' || n || nl || t || nl || 'note'", "odt": "'head ' || n || nl || t", "ods": "'| ' || n || ' | ' || t || ' |' || nl || '| --- | --- |'", "odp": "n || nl || '---' || nl || t",
    "epub": "'one ' || n || nl || nl || t", "vsdx": "t || nl || n", "mm": "'root ' || n || nl || '    ' || t", "rss": "'title ' || n || nl || t",
    "tex": "'title ' || n || nl || nl || 'head' || nl || nl || t || ' [MATH]'", "eml": "'mail ' || n || nl || nl || t", "srt": "'caption ' || n || ' ' || t", "vtt": "'caption ' || n || ' ' || t", "rtf": "'rtf ' || n || nl || t",
    "html": "'html ' || n || nl || t", "pdf": "'pdf ' || n || ' ' || t", "json": "'| key | value |' || nl || '| --- | --- |' || nl || '| n | ' || n || ' |' || nl || '| a.b | null |'",
    "ndjson": "'| n | m |' || nl || '| --- | --- |' || nl || '| ' || n || ' |  |' || nl || '|  | true |'", "csv": "'| id | text |' || nl || '| --- | --- |' || nl || '| ' || n || ' | a \"b\" \\| c |'", "md": "'# ' || n || nl || t || nl || 'end'",
}


@query(f"""WITH b AS (SELECT item_id::VARCHAR AS n, {_LINE} AS t, chr(10) AS nl FROM benchmark)
SELECT '/in/' || n || '.' || kind AS path, body AS text, NULL::VARCHAR AS error FROM (SELECT n, unnest([{', '.join(f"'{k}'" for k in _EXPECTED)}]) AS kind, unnest([{', '.join(_EXPECTED.values())}]) AS body FROM b)
UNION ALL SELECT '/in/' || n || '.xyz', NULL, 'unsupported file type: xyz' FROM b""")
def files_of_all_kinds(spark, sf_dir):
    """Files of every kind that is read, and of one that isn't, which gives an error row."""
    out = readers.parsed(_files(spark, sf_dir))
    return out.select("path", F.regexp_replace("text", " +(?=\n|$)", "").alias("text"), "error")


@query("SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g')) AS text_sha256 FROM documents")
def normalized_texts(spark, sf_dir):
    """Texts with a byte-order mark and line ends of two kinds, as they are read."""
    body = F.concat(F.lit("\ufeff"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.when(F.col("doc_id") % 2 == 0, "\r\n").otherwise("\r")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(readers.normalized(body), 256).alias("text_sha256"))


@query("SELECT event_id, 1::BIGINT AS line_no, false AS bad FROM events UNION ALL SELECT event_id, 3, true FROM events UNION ALL SELECT event_id, 4, false FROM events")
def ndjson_lines(spark, sf_dir):
    """Lines of JSON, blank ones and bad ones, by their numbers."""
    text = F.concat(F.col("props"), F.lit("\r\n\n{not json\n"), F.col("event_id").cast("string"))
    return readers.ndjson_rows(table(spark, sf_dir, "events").withColumn("body", text), "event_id", "body").select("event_id", F.col("line_no").cast("bigint").alias("line_no"), "bad")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'ndjson' ELSE 'csv' END AS kind FROM events")
def sniffed_formats(spark, sf_dir):
    n = F.col("event_id") % 3
    body = F.when(n == 0, F.concat(F.lit("\ufeff [\n"), F.col("props"), F.lit("]"))).when(n == 1, F.concat("props", F.lit("\n\n"), F.col("props"))).otherwise("a,b\n1,2")
    return table(spark, sf_dir, "events").select("event_id", readers.sniffed(body).alias("kind"))


@query("SELECT unnest(['a', 'a.b', 'a.b.c', 'k', 'z']) AS path, unnest(['object', 'object', 'array', 'number', 'string']) AS type, unnest([false, false, false, false, true]) AS nullable")
def nested_schema(spark, sf_dir):
    """Paths of nested JSON, by name; a field that is null in some rows takes its type from the others."""
    made = F.concat(F.lit('{"z":'), F.when(F.col("event_id") % 2 == 0, "null").otherwise('"s"'), F.lit(',"a":{"b":{"c":[1]}},"k":'), F.col("event_id").cast("string"), F.lit("}"))
    fields = readers.json_fields(table(spark, sf_dir, "events").select("event_id", made.alias("j")), "event_id", "j")
    return readers.inferred_schema(fields, "event_id").select("path", "type", "nullable").orderBy("path")


@query("SELECT page_id, substr(md5(page_id::VARCHAR), 1, 11) AS video, page_id * 1500 AS start_ms, 250::BIGINT AS duration_ms, 'a & ''b''' AS text FROM pages")
def video_segments(spark, sf_dir):
    """Ids of videos in the forms of their addresses, and segments of timed text."""
    n = F.col("page_id")
    video = F.substring(F.md5(n.cast("string")), 1, 11)
    url = F.when(n % 3 == 0, F.concat(F.lit("https://www.youtube.com/watch?t=1&v="), video)).when(n % 3 == 1, F.concat(F.lit("https://youtu.be/"), video, F.lit("?x"))).otherwise(F.concat(F.lit("https://www.youtube.com/embed/"), video))
    xml = F.concat(F.lit('<transcript><text start="'), (n * 1.5).cast("string"), F.lit('" dur="0.25">a &amp; &#39;b&#39;</text><text start="1">no duration</text></transcript>'))
    rows = table(spark, sf_dir, "pages").select("page_id", readers.video_id(url).alias("video"), F.explode(readers.transcript_segments(xml)).alias("s"))
    return rows.select("page_id", "video", F.col("s.start_ms").cast("bigint").alias("start_ms"), F.col("s.duration_ms").cast("bigint").alias("duration_ms"), "s.text")


_PY = "import os\n\ndef f_{n}(x):\n    if x:\n        return {n}\n\n# note\nclass C_{n}:\n    y = 1\nvalue = {n}\nother = 2\n"
_TS = 'import a from "b";\nexport function f_{n}(x) {{\n  if (x) {{ return "}}"; }}\n}}\ninterface I_{n} {{ a: string }}\n'


@query("""WITH p AS (SELECT doc_id AS n FROM documents), c AS (
  SELECT n, unnest(['import', 'function', 'class', 'block']) AS type, unnest([NULL, 'f_' || n, 'C_' || n, NULL]) AS name, unnest([1, 3, 8, 10]) AS start_line, unnest([1, 6, 9, 11]) AS end_line, 'python' AS language, 'import os' AS imports, 'class C_' || n || ':' || chr(10) || '    y = 1' AS declarations FROM p WHERE n % 2 = 0
  UNION ALL
  SELECT n, unnest(['import', 'function', 'block']), unnest([NULL, 'f_' || n, NULL]), unnest([1, 2, 5]), unnest([1, 4, 5]), 'typescript', 'import a from "b";', 'interface I_' || n || ' { a: string }' FROM p WHERE n % 2 = 1)
SELECT n AS doc_id, language, imports, declarations, type, name, start_line, end_line FROM c""")
def code_chunks(spark, sf_dir):
    """Source files in two languages as imports, definitions and blocks."""
    n = F.col("doc_id").cast("string")
    source = lambda t: F.replace(F.lit(t.replace("{{", "{").replace("}}", "}")), F.lit("{n}"), n)
    even = F.col("doc_id") % 2 == 0
    files = table(spark, sf_dir, "documents").select(F.concat(n, F.when(even, ".py").otherwise(".ts")).alias("path"), F.when(even, source(_PY)).otherwise(source(_TS)).alias("text"))
    found = code.parsed(files).select(F.regexp_extract("path", r"^(\d+)", 1).cast("bigint").alias("doc_id"), "language", "imports", "declarations", F.explode("chunks").alias("c"))
    return found.select("doc_id", "language", "imports", "declarations", "c.type", "c.name", "c.start_line", "c.end_line")


@query("SELECT item_id, item_id % 2 = 0 AS image_only FROM benchmark")
def scanned_pdfs(spark, sf_dir):
    """PDFs with an image and no text, and with text."""

    @F.pandas_udf("boolean")
    def scanned(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda n: formats.image_only_pdf((b"<</Subtype /Image>>" if n % 2 == 0 else b"") + _pdf("" if n % 2 == 0 else "a text of more than twenty letters")))

    return table(spark, sf_dir, "benchmark").select("item_id", scanned("item_id").alias("image_only"))


@query("SELECT item_id, 'a & <b> ''c'' \"d\" é &#0;' AS text FROM benchmark")
def decoded_entities(spark, sf_dir):
    from millrace.functions.text import decode_entities

    return table(spark, sf_dir, "benchmark").select("item_id", decode_entities(F.lit("a &amp; &lt;b&gt; &#39;c&apos; &quot;d&#34; &#233; &#0;")).alias("text"))


@query("SELECT item_id, CASE item_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 25 WHEN 2 THEN 26 ELSE 701 END AS place FROM benchmark")
def column_places(spark, sf_dir):
    @F.pandas_udf("int")
    def place(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda n: formats.column_index(("A", "z", "AA", "ZZ")[n % 4]))

    return table(spark, sf_dir, "benchmark").select("item_id", place("item_id").alias("place"))
