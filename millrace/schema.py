"""The item: one row of a training dataset, and how tables become items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import filled

MESSAGES = "array<struct<role:string,content:string>>"
#: Columns of an item beside its id; absent fields are null.
ITEM_FIELDS = {"format": "string", "instruction": "string", "input": "string", "output": "string", "text": "string", "messages": MESSAGES, "source_file": "string"}


def as_items(df: DataFrame, item_id: str, **fields: Column) -> DataFrame:
    """Items from the given columns; fields that are not given are null."""
    columns = [fields[name].cast(kind) if name in fields else F.lit(None).cast(kind) for name, kind in ITEM_FIELDS.items()]
    return df.select(F.col(item_id).alias("item_id"), *(c.alias(n) for c, n in zip(columns, ITEM_FIELDS, strict=True)))


def text_items(docs: DataFrame) -> DataFrame:
    """A text item for each document."""
    return as_items(docs, "doc_id", format=F.lit("text"), text=F.col("text"), source_file=F.col("source"))


def chat_items(turns: DataFrame) -> DataFrame:
    """A chat item for each conversation, its messages in the order of turns."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    grouped = turns.groupBy("conv_id").agg(rows.alias("rows"))
    messages = F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["content"].alias("content")))
    return as_items(grouped, "conv_id", format=F.lit("chatml"), messages=messages)


def said_by(role: str) -> Column:
    """The messages of a role."""
    return F.filter("messages", lambda m: m["role"] == role)


def contents(messages: Column, sep: str = " ") -> Column:
    """Messages' contents in one text."""
    return F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), sep)


def dedup_text() -> Column:
    """The text that duplicates are looked for in: output, messages, text, else the item as JSON."""
    rest = F.to_json(F.struct("format", "instruction", "input", "output", "text", "messages"))
    return F.coalesce(filled(F.col("output")), F.when(F.col("messages").isNotNull(), contents(F.col("messages"))), filled(F.col("text")), rest)


def answer_text() -> Column:
    """The text that validators look at: output, the first assistant message with content, text."""
    first = F.get(F.filter("messages", lambda m: (m["role"] == "assistant") & (m["content"] != "")), 0)["content"]
    return F.coalesce(filled(F.col("output")), first, filled(F.col("text")), F.lit(""))


def question_text() -> Column:
    """The question: instruction and input, else the last user message with content."""
    asked = F.concat_ws(" ", filled(F.col("instruction")), filled(F.col("input")))
    last = F.element_at(F.filter("messages", lambda m: (m["role"] == "user") & (m["content"] != "")), -1)["content"]
    return F.coalesce(filled(asked), F.when(F.size("messages") > 0, last), F.lit(""))


def display_text() -> Column:
    """The text that is shown: output, instruction, input, messages, text."""
    return F.coalesce(filled(F.col("output")), filled(F.col("instruction")), filled(F.col("input")), filled(contents(F.col("messages"))), filled(F.col("text")), F.lit(""))


def export_text() -> Column:
    """A line of the text export: text, output, messages, instruction, input."""
    return F.coalesce(filled(F.col("text")), filled(F.col("output")), filled(contents(F.col("messages"))), filled(F.col("instruction")), filled(F.col("input")), F.lit(""))


def all_messages() -> Column:
    """An item as messages: its own, or question and answer, or its text as a user's."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    own = F.transform(F.filter("messages", lambda m: m["role"].isin("system", "user", "assistant") & m["content"].isNotNull()), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    asked = filled(F.concat_ws("\n", filled(F.col("instruction")), filled(F.col("input"))))
    pair = F.filter(F.array(F.when(asked.isNotNull(), message("user", asked)), F.when(F.col("output").isNotNull(), message("assistant", F.col("output")))), lambda m: m.isNotNull())
    any_part = F.col("instruction").isNotNull() | F.col("input").isNotNull() | F.col("output").isNotNull()
    return F.when(F.size("messages") > 0, own).when(any_part, pair).when(F.col("text").isNotNull(), F.array(message("user", F.col("text")))).otherwise(F.array().cast(MESSAGES))
