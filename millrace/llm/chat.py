"""Chat formatting with Spark expressions only.

Method. The turns of a conversation are collected as structs and sorted; adjacent turns of one
role become one block; blocks are concatenated under a template that marks them::

    <turn user>
    first text<next/>second text of the same role</turn>

Texts and roles are escaped so that ``<`` occurs in markers alone: a backslash becomes ``\\s``,
``<`` becomes ``\\l`` and, in roles, ``>`` becomes ``\\g``. Reading back splits at the markers and
undoes the escapes, so formatting loses nothing. The loss mask is a list of runs (number of UTF-8
bytes of the output, whether they count), and covers exactly the texts of assistant turns;
:func:`masked` cuts what counts out of the output again.

Defined cases: null text and null role are empty; a conversation's turns are ordered by turn
(null first), role and text, so ties and repeated rows have one order, and each row is a turn; a
null conversation id is a conversation like any other. Other columns are ignored. A row of the
result holds a whole conversation, which is the one group that is collected, so very long texts are
processed whole as long as a conversation fits a row (2 GiB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's fixed strings.
OPEN, OPEN_END, NEXT, CLOSE = "<turn ", ">\n", "<next/>", "</turn>\n"


def escape(text: Column) -> Column:
    """Text without ``<``; see the module."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`: a backslash always begins an escape, so the order is free."""
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\g"), F.lit(">")))


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """A row per conversation: its id, ``formatted`` and ``loss_runs``, array of (n, counts), n in UTF-8 bytes."""
    empty = F.lit("")
    rows = turns.select(
        F.col(conv_col),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), empty).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), empty).alias("text"),
        ).alias("row"),
    )
    ordered = rows.groupBy(conv_col).agg(F.array_sort(F.collect_list("row")).alias("turns"))
    starts = F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]),
    )
    ordered = ordered.withColumn("starts", starts)
    end = lambda k: F.coalesce(F.get("starts", k + 1), F.size("turns") + 1)
    blocks = F.transform(
        "starts",
        lambda at, k: F.struct(
            F.element_at("turns", at)["role"].alias("role"),
            F.transform(F.slice("turns", at, end(k) - at), lambda t: escape(t["text"])).alias("texts"),
        ),
    )
    ordered = ordered.select(conv_col, blocks.alias("blocks"))
    head = lambda b: F.concat(F.lit(OPEN), _escape_role(b["role"]), F.lit(OPEN_END))
    formatted = F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], NEXT), F.lit(CLOSE)))
    run = lambda n, counts: F.struct(n.cast("bigint").alias("n"), counts.alias("counts"))
    runs = F.transform(
        "blocks",
        lambda b: F.concat(
            F.array(run(F.octet_length(head(b)), F.lit(False))),
            F.flatten(
                F.transform(
                    b["texts"],
                    lambda t, i: F.array(
                        run(F.when(i == 0, 0).otherwise(len(NEXT)), F.lit(False)),
                        run(F.octet_length(t), b["role"] == loss_role),
                    ),
                )
            ),
            F.array(run(F.lit(len(CLOSE)), F.lit(False))),
        ),
    )
    return ordered.select(conv_col, F.array_join(formatted, "").alias("formatted"), F.filter(F.flatten(runs), lambda r: r["n"] > 0).alias("loss_runs"))


def read_chats(formatted: DataFrame, *, conv_col: str = "conv_id", carried: tuple[str, ...] = ()) -> DataFrame:
    """Reads ``formatted`` back: the id, ``formatted``, ``carried`` columns and ``turns``, array of (role, text)."""
    parts = F.split("formatted", CLOSE)
    block = lambda b: F.substring_index(b, OPEN_END, 1)
    turns = F.flatten(
        F.transform(
            F.slice(parts, 1, F.size(parts) - 1),
            lambda b: F.transform(
                F.split(F.substr(b, F.length(block(b)) + len(OPEN_END) + 1), NEXT),
                lambda t: F.struct(_unescape_role(F.substr(block(b), F.lit(len(OPEN) + 1))).alias("role"), unescape(t).alias("text")),
            ),
        )
    )
    return formatted.select(conv_col, "formatted", *carried, turns.alias("turns"))


def masked(formatted: Column, runs: Column) -> Column:
    """The texts under the loss mask, unescaped, in order and with nothing between.

    The ends of the runs are their running sums, by doubling steps, and runs are cut from bytes, so
    that the cost grows little faster than a conversation's length.
    """
    nothing = F.lit(0).cast("bigint")
    distances = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(runs) + 1)).cast("int")), lambda d: F.pow(F.lit(2), d).cast("int"))
    step = lambda s, d: F.transform(s, lambda x, i: x + F.when(i >= d, F.coalesce(F.get(s, i - d), nothing)).otherwise(nothing))
    sums = F.aggregate(distances, F.transform(runs, lambda r: r["n"]), step)
    shown = lambda ends: F.filter(F.zip_with(runs, ends, lambda r, e: F.struct(r["counts"].alias("counts"), (e - r["n"] + 1).alias("at"), r["n"].alias("n"))), lambda r: r["counts"])
    cut = lambda body, spans: F.transform(spans, lambda r: F.substr(body, r["at"].cast("int"), r["n"].cast("int")).cast("string"))
    # The bytes and the spans are bound once, by lambdas, and not evaluated again for each run.
    pieces = F.flatten(F.transform(F.array(F.struct(formatted.cast("binary").alias("body"), sums.alias("ends"))), lambda x: cut(x["body"], shown(x["ends"]))))
    return unescape(F.array_join(pieces, ""))


def chat_digests(formatted: DataFrame, *, conv_col: str = "conv_id") -> DataFrame:
    """Digests of the turns that :func:`read_chats` reads back and of the text under the loss mask; see the query of this operator."""
    back = read_chats(formatted.select(conv_col, "formatted", "loss_runs"), conv_col=conv_col, carried=("loss_runs",))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        conv_col,
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        masked(F.col("formatted"), F.col("loss_runs")).alias("loss"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    ).select(conv_col, "n_turns", "turns_sha256", F.length("loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
