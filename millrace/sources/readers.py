"""Files and tables as documents.

:func:`read_files` reads any supported folder into (path, text, error), a row a file; a file that
can't be parsed gives an error row. Structured kinds have readers of their own that return rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import decode_entities, js_trim
from millrace.sources import formats

#: Extensions and the kinds they stand for.
KINDS = {
    "txt": "text", "md": "text", "markdown": "text", "html": "html", "htm": "html", "rtf": "rtf", "docx": "docx", "pdf": "pdf",
    "epub": "epub", "xlsx": "xlsx", "pptx": "pptx", "odt": "odt", "ods": "ods", "odp": "odp", "tex": "latex", "eml": "email",
    "srt": "srt", "vtt": "vtt", "rss": "feed", "atom": "feed", "xml": "feed", "mm": "mindmap", "vsdx": "visio", "json": "json", "ndjson": "ndjson", "jsonl": "ndjson", "csv": "csv",
}


def extension(path: Column) -> Column:
    """The lower-case extension of a path."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def normalized(text: Column) -> Column:
    """Text without a byte-order mark, with line feeds alone between lines."""
    return F.regexp_replace(F.regexp_replace(text, "^\\uFEFF", ""), "\\r\\n?", "\n")


def parsed(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, text, error) from binary contents."""
    rows = files.select(F.col(path_col).alias("path"), extension(F.col(path_col)).alias("kind"), F.col(content_col).alias("content"))

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = [formats.text_of(KINDS.get(k), c) if k in KINDS else (None, f"unsupported file type: {k}") for k, c in zip(part["kind"], part["content"], strict=True)]
            yield pd.DataFrame({"path": part["path"], "text": [t for t, _ in out], "error": [e for _, e in out]})

    return rows.mapInPandas(work, "path string, text string, error string")


def read_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """All files below a path that match ``pattern``, parsed."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return parsed(reader.load(path))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole plain-text files, natively."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), normalized(F.col("value")).alias("text"))


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", quote: str = '"', header: bool = True) -> DataFrame:
    """CSV with doubled quotes and line breaks within quotes; all columns text."""
    return spark.read.csv(path, sep=delimiter, quote=quote, escape=quote, header=header, multiLine=True, inferSchema=False)


def ndjson_rows(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, value, bad): each line that isn't blank, parsed as a variant; ``bad`` if it can't be."""
    lines = texts.select(id_col, F.posexplode(F.split(normalized(F.col(text_col)), "\n")).alias("pos", "line")).where(F.trim("line") != "")
    value = F.try_parse_json("line")
    return lines.select(id_col, (F.col("pos") + 1).alias("line_no"), "line", value.isNull().alias("bad"))


def sniffed(text: Column) -> Column:
    """json, ndjson or csv: several lines that each parse are ndjson, else a leading bracket is json."""
    bare = js_trim(F.regexp_replace(text, "^\\uFEFF", ""))
    lines = F.filter(F.split(bare, "\r?\n"), lambda x: F.trim(x) != "")
    alone = (F.size(lines) > 1) & F.forall(lines, lambda x: F.try_parse_json(x).isNotNull())
    opens = F.rlike(bare, F.lit(r"^[\[{]"))
    return F.when(opens & alone, "ndjson").when(opens, "json").otherwise("csv")


def json_fields(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, path, type, value): what each JSON object holds, by dotted path; arrays are leaves.

    Nesting is as deep as the data's, so objects are walked in Arrow batches.
    """
    kept = rows.select(F.col(id_col).alias("id"), F.col(json_col).alias("json"))
    kind = kept.schema["id"].dataType.simpleString()

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [(i, *field) for i, text in zip(part["id"], part["json"], strict=True) for field in formats.fields(text)]
            yield pd.DataFrame(found, columns=["id", "path", "type", "value"])

    return kept.mapInPandas(work, f"id {kind}, path string, type string, value string").withColumnRenamed("id", id_col)


def inferred_schema(fields: DataFrame, order: str) -> DataFrame:
    """(path, type, nullable, sample) of (path, type, value): the first type that isn't null wins."""
    first = F.struct((F.col("type") == "null").alias("later"), F.col(order).alias("at"))
    found = fields.groupBy("path").agg(F.min_by("type", first).alias("type"), F.max((F.col("type") == "null").cast("int")).alias("n"), F.min_by("value", first).alias("sample"))
    return found.select("path", "type", (F.col("n") == 1).alias("nullable"), F.when(F.col("type") != "null", F.col("sample")).alias("sample"))


#: Elements that carry no content, removed with all they hold.
REMOVED = ("script", "style", "noscript", "iframe", "nav", "footer", "header", "aside")


def sanitized(html: Column) -> Column:
    """HTML without scripts, frames, page furniture, comments, event handlers and script links."""
    for tag in REMOVED:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    html = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    html = F.regexp_replace(html, r"""(?i)\son[A-Za-z0-9_]+\s*=\s*("[^"]*"|'[^']*'|[^\s>]*)""", "")
    return F.regexp_replace(html, r"""(?i)javascript:[^\s"'<>]*""", "")


def title(html: Column) -> Column:
    """The title of a page, or null."""
    return F.nullif(js_trim(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)), F.lit(""))


def main_html(html: Column) -> Column:
    """The part of a page that is its content: main, article, role main, class content, body, else all."""
    part = lambda p, g=1: F.when(F.rlike(html, F.lit(p)), F.regexp_extract(html, p, g))
    return F.coalesce(
        part(r"(?is)<main\b[^>]*>(.*?)</main\s*>"),
        part(r"(?is)<article\b[^>]*>(.*?)</article\s*>"),
        part(r"""(?is)<div\b[^>]*role\s*=\s*("|')main\1[^>]*>(.*?)</div\s*>""", 2),
        part(r"""(?is)<div\b[^>]*class\s*=\s*"[^"]*\bcontent\b[^"]*"[^>]*>(.*?)</div\s*>"""),
        part(r"(?is)<body\b[^>]*>(.*?)</body\s*>"),
        html,
    )


def html_text(html: Column) -> Column:
    """Text of HTML: breaks and ends of blocks become line feeds, tags go, entities are decoded, blanks close."""
    text = F.regexp_replace(html, r"(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-6]|section|article|blockquote)\s*>", "\n")
    text = decode_entities(F.regexp_replace(text, r"<[^>]+>", ""))
    return js_trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r" ?\n[ \n]*", "\n"))


def page_texts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, title, text) of web pages."""
    return pages.select(id_col, title(F.col(html_col)).alias("title"), html_text(main_html(sanitized(F.col(html_col)))).alias("text"))


def video_id(url: Column) -> Column:
    """The id of a video in the forms of its addresses."""
    return F.nullif(F.regexp_extract(url, r"(?:v=|youtu\.be/|/embed/|/shorts/|/live/)([A-Za-z0-9_-]{11})", 1), F.lit(""))


def transcript_segments(xml: Column) -> Column:
    """Segments (start_ms, duration_ms, text) of timed text."""
    tag = r"(?s)<text\b[^>]*>.*?</text>"
    ms = lambda t, a: F.floor(F.nullif(F.regexp_extract(t, rf'\b{a}="([^"]+)"', 1), F.lit("")).try_cast("double") * 1000 + 0.5)
    rows = F.transform(F.regexp_extract_all(xml, F.lit(f"({tag})"), F.lit(0)), lambda t: F.struct(ms(t, "start").alias("start_ms"), ms(t, "dur").alias("duration_ms"), js_trim(decode_entities(F.regexp_extract(t, r"(?s)<text\b[^>]*>(.*?)</text>", 1))).alias("text")))
    return F.filter(rows, lambda r: r["start_ms"].isNotNull() & r["duration_ms"].isNotNull() & (r["text"] != ""))
