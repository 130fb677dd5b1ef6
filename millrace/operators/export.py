"""Layouts of exported datasets, as columns and as files.

A layout turns items (see :mod:`millrace.schema`) into lines; :data:`LAYOUTS` names them, and
:func:`write` writes the lines in the items' order, in parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import csv_escape, html_escape, tsv_escape
from millrace.operators.ordering import numbered
from millrace.schema import all_messages, display_text, export_text
from millrace.storage import cut


def _pruned_json(*names: str) -> Column:
    return F.to_json(F.struct(*names))


def jsonl(items: DataFrame) -> DataFrame:
    """(item_id, line): each item as a JSON object without absent fields."""
    return items.select("item_id", _pruned_json("format", "instruction", "input", "output", "text", "messages").alias("line"))


def text_lines(items: DataFrame) -> DataFrame:
    """(item_id, line): each item's text."""
    return items.select("item_id", export_text().alias("line"))


def csv_layout(items: DataFrame) -> DataFrame:
    """(layout): the columns of a CSV export: messages or text if more than half of the items have them."""
    chat, text = F.count_if(F.col("messages").isNotNull()), F.count_if(F.col("messages").isNull() & (F.coalesce("text", F.lit("")) != ""))
    n = F.count("*")
    return items.agg(F.when(chat > n / 2, "messages").when(text > n / 2, "text").otherwise("instruction,input,output").alias("layout"))


def csv_lines(items: DataFrame, with_metadata: bool = False) -> DataFrame:
    """(item_id, line): rows of the CSV export in its layout."""
    cell = lambda c: csv_escape(F.coalesce(c, F.lit("")))
    joined = items.join(F.broadcast(csv_layout(items)), F.lit(True))
    messages = cell(F.to_json("messages"))
    row = F.when(F.col("layout") == "messages", messages).when(F.col("layout") == "text", cell(F.col("text"))).otherwise(F.concat_ws(",", cell(F.col("instruction")), cell(F.col("input")), cell(F.col("output"))))
    if with_metadata:
        row = F.concat(row, F.lit(","), csv_escape(F.coalesce(F.to_json("metadata"), F.lit("null"))))
    return joined.select("item_id", row.alias("line"))


def tsv_lines(items: DataFrame) -> DataFrame:
    """(item_id, line): instruction, input, output and text between tabs."""
    cells = (tsv_escape(F.coalesce(F.col(c), F.lit(""))) for c in ("instruction", "input", "output", "text"))
    return items.select("item_id", F.concat_ws("\t", *cells).alias("line"))


def gui_text_lines(items: DataFrame) -> DataFrame:
    """(item_id, line): the text that is shown of each item, a blank line after it."""
    return items.select("item_id", F.concat(display_text(), F.lit("\n")).alias("line"))


def preview_lines(items: DataFrame, most: int = 200) -> DataFrame:
    """(item_id, line): the item's place from 1 and the beginning of its text."""
    placed = numbered(items.select("item_id", display_text().alias("_text")), ["item_id"], "_n")
    start = F.concat(F.substring("_text", 1, most), F.when(F.length("_text") > most, "...").otherwise(""))
    return placed.select("item_id", F.concat(F.lit("["), F.col("_n").cast("string"), F.lit("] "), start).alias("line"))


def chatml_items(items: DataFrame) -> DataFrame:
    """The chat items if there is any, else all."""
    # One row.
    found = items.agg(F.coalesce(F.max(F.when(F.col("format") == "chatml", True)), F.lit(False)).alias("_any"))
    return items.join(F.broadcast(found), F.lit(True)).where(~F.col("_any") | (F.col("format") == "chatml")).drop("_any")


def json_array_lines(items: DataFrame) -> DataFrame:
    """(item_id, line): each item as indented JSON, the lines of a JSON array when they are put between brackets.

    All but the last line end in a comma, so parts written in order make one array.
    """
    body = F.regexp_replace(F.to_json(F.struct("format", "instruction", "input", "output", "text", "messages"), {"pretty": "true"}), "(?m)^", "  ")
    # One row.
    last = items.agg(F.max("item_id").alias("_last"))
    rows = items.join(F.broadcast(last), F.lit(True))
    return rows.select("item_id", F.concat(F.replace(body, F.lit(" : "), F.lit(": ")), F.when(F.col("item_id") < F.col("_last"), ",").otherwise("")).alias("line"))


def spreadsheet_columns(items: DataFrame) -> DataFrame:
    """(columns): those of a spreadsheet: messages as soon as one item has some, else the three of a pair."""
    any_chat = F.coalesce(F.max(F.when(F.size("messages") > 0, True)), F.lit(False))
    return items.agg(F.when(any_chat, F.array(F.lit("messages"))).otherwise(F.array(*map(F.lit, ("instruction", "input", "output")))).alias("columns"))


def spreadsheet_rows(items: DataFrame, columns: list[str]) -> DataFrame:
    """(item_id, cells): the columns as text, structures as JSON, absent ones empty."""
    simple = {f.name for f in items.schema.fields if f.dataType.typeName() not in ("array", "struct", "map")}
    cell = lambda c: F.lit("") if c not in items.columns else F.coalesce(F.col(c).cast("string") if c in simple else F.to_json(c), F.lit(""))
    return items.select("item_id", F.array(*map(cell, columns)).alias("cells"))


def csv_file_lines(items: DataFrame) -> DataFrame:
    """(item_id, line): the CSV export with its byte-order mark and head, which stand before the first item."""
    head = csv_layout(items).select(F.concat(F.lit("\ufeff"), F.col("layout"), F.lit("\n")).alias("_head"))
    first = items.agg(F.min("item_id").alias("_first"))
    rows = csv_lines(items).join(F.broadcast(head), F.lit(True)).join(F.broadcast(first), F.lit(True))
    return rows.select("item_id", F.concat(F.when(F.col("item_id") == F.col("_first"), F.col("_head")).otherwise(""), F.col("line")).alias("line"))


def log_lines(log: DataFrame, columns: list[str], layout: str = "csv") -> DataFrame:
    """(line) of a log in CSV (quoted where needed, without a guard against formulas) or JSON lines."""
    if layout == "jsonl":
        return log.select(F.to_json(F.struct(*columns)).alias("line"))
    quoted = lambda c: F.when(F.rlike(c, F.lit('[,"\\n\\r]')), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return log.select(F.concat_ws(",", *(quoted(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns)).alias("line"))


def file_name(template: str, source: Column, layout: str, index: Column, at: Column) -> Column:
    """A template's {source}, {format}, {date}, {timestamp} and {index}, without characters that files may not have."""
    base = F.regexp_extract(F.coalesce(source, F.lit("")), r"([^/\\\\]*)$", 1)
    stem = F.coalesce(F.nullif(F.when(F.rlike(base, F.lit(r"^.+\.[^.]*$")), F.regexp_extract(base, r"^(.+)\.[^.]*$", 1)).otherwise(base), F.lit("")), F.lit("output"))
    out = F.lit(template)
    for mark, value in (("{source}", stem), ("{format}", F.lit(layout)), ("{date}", F.date_format(at, "yyyyMMdd")), ("{timestamp}", F.unix_millis(at).cast("string")), ("{index}", index.cast("string"))):
        out = F.replace(out, F.lit(mark), value)
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(out, r'[<>:"/\\\\|?*\x00]', "_")), F.lit("")), F.lit("output"))


def json_schema(items: DataFrame) -> DataFrame:
    """(name, type): the fields of the first item (least id) and their JSON types, by name."""
    names = [c for c in ("format", "instruction", "input", "output", "text", "messages") if c in items.columns]
    first = items.agg(F.min_by(F.struct(*(F.col(c).isNotNull().alias(c) for c in names)), "item_id").alias("has"))
    kinds = F.array(*(F.struct(F.lit(c).alias("name"), F.lit("array" if c == "messages" else "string").alias("type"), F.col("has")[c].alias("has")) for c in sorted(names)))
    return first.select(F.explode(F.filter(kinds, lambda x: x["has"])).alias("f")).select("f.name", "f.type")


def openai_lines(items: DataFrame) -> DataFrame:
    """(item_id, line): {"messages": [...]}; items without messages give none."""
    rows = items.select("item_id", all_messages().alias("messages")).where(F.size("messages") > 0)
    return rows.select("item_id", F.to_json(F.struct("messages")).alias("line"))


def sharegpt_lines(items: DataFrame) -> DataFrame:
    """(item_id, line): {"id", "conversations"}; the id is the item's place among all, from 1."""
    said = F.transform("messages", lambda m: F.struct(F.when(m["role"] == "assistant", "gpt").when(m["role"] == "system", "system").otherwise("human").alias("from"), m["content"].alias("value")))
    placed = numbered(items.select("item_id", all_messages().alias("messages")), ["item_id"], "id")
    rows = placed.where(F.size("messages") > 0).select("item_id", "id", said.alias("conversations"))
    return rows.select("item_id", F.to_json(F.struct("id", "conversations")).alias("line"))


def _exchanges(messages: Column) -> tuple[Column, Column]:
    """The system text, and pairs (user, assistant) at every second place after it, assistant null if it isn't one."""
    has_system = F.get(messages, 0)["role"] == "system"
    system = F.when(has_system, F.get(messages, 0)["content"]).otherwise("")
    turns = F.when(has_system, F.slice(messages, 2, F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(turns) - 1, F.lit(0))), lambda i: (i % 2 == 0) & (i < F.size(turns)))
    pairs = F.transform(starts, lambda i: F.struct(i.alias("at"), F.when(F.get(turns, i)["role"] == "user", F.get(turns, i)["content"]).alias("user"), F.when(F.get(turns, i + 1)["role"] == "assistant", F.get(turns, i + 1)["content"]).alias("assistant")))
    return F.coalesce(system, F.lit("")), F.filter(pairs, lambda p: p["user"].isNotNull())


def llama2(messages: Column) -> Column:
    """Messages under the [INST] template, the system text in the first exchange."""
    system, pairs = _exchanges(messages)
    block = F.when(F.length(system) > 0, F.concat(F.lit("<<SYS>>\n"), system, F.lit("\n<</SYS>>\n\n"))).otherwise("")
    parts = F.transform(pairs, lambda p: F.concat(F.lit("[INST] "), F.when(p["at"] == 0, block).otherwise(""), p["user"], F.lit(" [/INST] "), F.coalesce(p["assistant"], F.lit(""))))
    return F.array_join(parts, "")


def llama3(messages: Column) -> Column:
    """Messages under the header template."""
    system, pairs = _exchanges(messages)
    turn = lambda role, c: F.concat(F.lit(f"<|start_header_id|>{role}<|end_header_id|>\n\n"), c, F.lit("<|eot_id|>"))
    parts = F.transform(pairs, lambda p: F.concat(turn("user", p["user"]), F.coalesce(turn("assistant", p["assistant"]), F.lit(""))))
    return F.concat(F.lit("<|begin_of_text|>"), F.when(F.length(system) > 0, turn("system", system)).otherwise(""), F.array_join(parts, ""))


def mistral(messages: Column) -> Column:
    """Messages under the [INST] template, the system text before the first user text that there is."""
    system, pairs = _exchanges(messages)
    lead = F.when(F.length(system) > 0, F.concat(system, F.lit("\n\n"))).otherwise("")
    parts = F.transform(pairs, lambda p, i: F.concat(F.lit("[INST] "), F.when(i == 0, lead).otherwise(""), p["user"], F.lit(" [/INST] "), F.coalesce(p["assistant"], F.lit(""))))
    return F.array_join(parts, "")


def template_lines(items: DataFrame, template: Callable[[Column], Column]) -> DataFrame:
    """(item_id, line): {"text"} under a template."""
    rows = items.select("item_id", all_messages().alias("messages")).where(F.size("messages") > 0)
    return rows.select("item_id", F.to_json(F.struct(template(F.col("messages")).alias("text"))).alias("line"))


def markdown_lines(items: DataFrame) -> DataFrame:
    """(item_id, line): each item as a section of Markdown."""
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"**{name}:** "), c))
    said = F.array_join(F.transform("messages", lambda m: F.concat(F.lit("**"), m["role"], F.lit(":** "), m["content"])), "\n\n")
    body = F.concat_ws("\n\n", part("Instruction", F.col("instruction")), part("Input", F.col("input")), part("Output", F.col("output")), F.nullif(said, F.lit("")), F.nullif("text", F.lit("")))
    return items.select("item_id", F.concat(F.lit("## Item "), F.col("item_id").cast("string"), F.lit("\n\n"), body).alias("line"))


def html_lines(items: DataFrame) -> DataFrame:
    """(item_id, line): each item as an article of HTML, escaped."""
    part = lambda name: F.when(F.coalesce(F.col(name), F.lit("")) != "", F.concat(F.lit(f'<p class="{name}">'), html_escape(F.col(name)), F.lit("</p>")))
    said = F.array_join(F.transform("messages", lambda m: F.concat(F.lit('<p class="'), html_escape(m["role"]), F.lit('">'), html_escape(m["content"]), F.lit("</p>"))), "")
    body = F.concat_ws("", part("instruction"), part("input"), part("output"), said, part("text"))
    return items.select("item_id", F.concat(F.lit("<article>"), body, F.lit("</article>")).alias("line"))


def automl_rows(items: DataFrame, label: Column) -> DataFrame:
    """(item_id, text, label, value): rows for tabular training; value is the label's leading number."""
    text = F.coalesce(F.nullif("instruction", F.lit("")), F.nullif("input", F.lit("")), F.nullif("text", F.lit("")), F.lit(""))
    number = F.regexp_extract(label, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1)
    return items.select("item_id", text.alias("text"), label.alias("label"), F.nullif(number, F.lit("")).try_cast("double").alias("value"))


def size_estimate(items: DataFrame, layout: Callable[[DataFrame], DataFrame], sample: int = 50) -> DataFrame:
    """(bytes): the mean size of the first ``sample`` lines, with their line feeds, times the number of items."""
    first = layout(items.orderBy("item_id").limit(sample)).agg(F.avg(F.octet_length("line") + 1).alias("mean"))
    count = items.agg(F.count("*").alias("n"))
    return count.join(F.broadcast(first), F.lit(True)).select(F.floor(F.coalesce("mean", F.lit(0.0)) * F.col("n") + 0.5).alias("bytes"))


def parts(items: DataFrame, most: int = 100_000, source: str | None = None) -> DataFrame:
    """(item_id, file, part): where each item goes; with ``source`` a file a source, numbered as sources appear.

    Items are numbered over ranges, those of a source from its first one on, so a source that has
    most of the items is no single task.
    """
    if source is None:
        placed = numbered(items.select("item_id"), ["item_id"], "_n")
        return placed.select("item_id", F.lit(0).cast("bigint").alias("file"), F.floor((F.col("_n") - 1) / most).cast("bigint").alias("part"))
    named = items.select("item_id", F.coalesce(F.nullif(source, F.lit("")), F.concat(F.lit("unknown-"), F.col("item_id").cast("string"))).alias("_source"))
    placed = cut(numbered(named, ["_source", "item_id"], "_n"), "parts")
    sources = numbered(placed.groupBy("_source").agg(F.min("item_id").alias("_first"), F.min("_n").alias("_start")), ["_first"], "_file")
    joined = placed.join(sources.select("_source", "_start", "_file"), "_source")
    return joined.select("item_id", (F.col("_file") - 1).alias("file"), F.floor((F.col("_n") - F.col("_start")) / most).cast("bigint").alias("part"))


def dataset_stats(items: DataFrame) -> DataFrame:
    """One row: items, formats, mean lengths of instructions and of outputs or texts."""
    length = lambda c: F.avg(F.when(F.coalesce(c, F.lit("")) != "", F.length(c)))
    out = F.coalesce(F.nullif("output", F.lit("")), F.nullif("text", F.lit("")))
    return items.agg(
        F.count("*").alias("items"),
        F.count_if(F.col("format") == "instruction").alias("instruction_items"),
        F.count_if(F.col("format") == "chatml").alias("chat_items"),
        F.count_if(F.col("format") == "text").alias("text_items"),
        F.coalesce(length(F.col("instruction")), F.lit(0.0)).alias("avg_instruction"),
        F.coalesce(length(out), F.lit(0.0)).alias("avg_output"),
    )


def card(stats: dict, name: str, licence: str = "other") -> str:
    """A dataset card from a row of :func:`dataset_stats` (as a dict, with its size label)."""
    rows = "\n".join(f"| {k} | {v} |" for k, v in stats.items())
    return f"---\nlicense: {licence}\nsize_categories:\n- {stats.get('size', 'n<1K')}\n---\n\n# {name}\n\n| Statistic | Value |\n| --- | --- |\n{rows}\n"


#: Layouts by name; an extension adds its own.
LAYOUTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "jsonl": jsonl,
    "text": text_lines,
    "csv": csv_lines,
    "tsv": tsv_lines,
    "gui_text": gui_text_lines,
    "json": json_array_lines,
    "chatml": lambda items: json_array_lines(chatml_items(items)),
    "csv_file": csv_file_lines,
    "preview": preview_lines,
    "openai": openai_lines,
    "sharegpt": sharegpt_lines,
    "llama2": lambda items: template_lines(items, llama2),
    "llama3": lambda items: template_lines(items, llama3),
    "mistral": lambda items: template_lines(items, mistral),
    "markdown": markdown_lines,
    "html": html_lines,
}


def lines(items: DataFrame, layout: str) -> DataFrame:
    """The lines of a named layout."""
    if layout not in LAYOUTS:
        raise ValueError(f"no layout is named {layout!r}")
    return LAYOUTS[layout](items)


def write(items: DataFrame, layout: str, path: str, most: int = 100_000) -> None:
    """Writes a layout in the items' order, at most ``most`` items a file; parquet keeps (format, content)."""
    if layout == "parquet":
        items.select("format", jsonl_content().alias("content")).write.option("maxRecordsPerFile", most).parquet(path)
        return
    ordered = lines(items, layout).repartitionByRange("item_id").sortWithinPartitions("item_id")
    ordered.select("line").write.option("maxRecordsPerFile", most).text(path)


def jsonl_content() -> Column:
    """An item as JSON."""
    return _pruned_json("format", "instruction", "input", "output", "text", "messages")
