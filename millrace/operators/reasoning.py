"""Answers that reason: tagged chains of thought, trees of thought, questions over several chunks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import js_trim

#: Levels of a tree that are read.
DEPTH = 10


def chain_of_thought(response: Column) -> Column:
    """Struct (reasoning, answer) of the tags of these names; without either the whole response is the answer."""
    text = F.coalesce(response, F.lit(""))
    tagged = lambda tag: js_trim(F.regexp_extract(text, rf"(?is)<{tag}>(.*?)</{tag}>", 1))
    reasoning, answer = tagged("reasoning"), tagged("answer")
    neither = (reasoning == "") & (answer == "")
    return F.struct(reasoning.alias("reasoning"), F.when(neither, js_trim(text)).otherwise(answer).alias("answer"))


def best_path(response: str | None) -> list[str]:
    """The thoughts from a tree's root down the best branches, to a solution or a leaf; text that isn't JSON is its own path.

    The best branch is the first with the greatest score of at least 0.
    """
    try:
        node = json.loads(response or "")
    except ValueError:
        return [response or ""]
    path: list[str] = []
    for depth in range(DEPTH + 1):
        node = node if isinstance(node, dict) else {}
        thought = node.get("thought")
        path.append("" if thought in (None, "", 0, False) else str(thought))
        branches = next((node[k] for k in ("branches", "sub_branches", "children") if node.get(k)), [])
        if node.get("is_solution") or node.get("isSolution") or not isinstance(branches, list) or not branches or depth == DEPTH:
            break
        scored = [(_number(b.get("score")) if isinstance(b, dict) else 0.0, -i, b) for i, b in enumerate(branches)]
        top = max(scored, key=lambda x: x[:2])
        if top[0] <= -1:
            break
        node = top[2]
    return path


def _number(value: object) -> float:
    try:
        return float(value or 0)
    except (TypeError, ValueError):
        return 0.0


def tree_of_thought(response: Column) -> Column:
    """Struct (path, solution) of :func:`best_path`; the solution is the path's end."""

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(best_path)

    path = run(response)
    return F.struct(path.alias("path"), F.element_at(path, -1).alias("solution"))


def multi_hop(response: Column) -> Column:
    """Struct (question, answer, hops, source_chunks, reasoning) of a JSON answer; of other text the question is the text."""
    row = F.from_json(response, "question string, answer string, hops double, source_chunks array<double>, reasoning string")
    valid = F.try_parse_json(response).isNotNull()
    text = lambda name: F.coalesce(row[name], F.lit(""))
    none = F.array().cast("array<bigint>")
    return F.struct(
        F.when(valid, text("question")).otherwise(F.coalesce(response, F.lit(""))).alias("question"),
        F.when(valid, text("answer")).otherwise("").alias("answer"),
        F.when(valid, F.coalesce(F.nullif(row["hops"], F.lit(0.0)), F.lit(1.0))).otherwise(1.0).cast("bigint").alias("hops"),
        F.when(valid, F.coalesce(row["source_chunks"].cast("array<bigint>"), none)).otherwise(none).alias("source_chunks"),
        F.when(valid, text("reasoning")).otherwise("").alias("reasoning"),
    )


def multi_hop_fault(question: Column, least: int = 2) -> Column:
    """Why a question over several chunks is no good, the first reason that holds; empty if none does."""
    q = question
    short = F.concat(F.lit("Only "), q["hops"].cast("string"), F.lit(f" hops, minimum is {least}"))
    few = F.concat(F.lit("Only "), F.size(q["source_chunks"]).cast("string"), F.lit(f" source chunks, need at least {least}"))
    return (
        F.when(q["hops"] < least, short)
        .when(F.size(q["source_chunks"]) < least, few)
        .when((q["question"] == "") | (q["answer"] == ""), "Missing question or answer")
        .when(F.exists(q["source_chunks"], lambda i: i < 0), "Negative chunk index in sourceChunks")
        .otherwise("")
    )


def chunk_prompt(chunks: Column) -> Column:
    """Chunks (index, label, text) as the text of a prompt."""
    return F.array_join(F.transform(chunks, lambda c: F.concat(F.lit("[Chunk "), c["index"].cast("string"), F.lit("] "), c["label"], F.lit(":\n"), c["text"])), "\n\n")


def improved(first: DataFrame, second: DataFrame, key: str, score: str = "score") -> DataFrame:
    """(key, score, improved): the better of two attempts at each item, the first of equals."""
    again = second.select(F.col(key).alias("_key"), F.col(score).alias("_again"))
    both = first.join(again, F.col(key) == F.col("_key"), "left")
    better = F.coalesce(F.col("_again") > F.col(score), F.lit(False))
    return both.select(key, F.when(better, F.col("_again")).otherwise(F.col(score)).alias(score), better.alias("improved"))


def regeneration_summary(first: DataFrame, second: DataFrame, key: str, score: str = "score") -> DataFrame:
    """One row: items, mean score before and after, and how many got better."""
    after = improved(first, second, key, score).select(F.col(key), F.col(score).alias("after"), "improved")
    both = first.select(F.col(key), F.col(score).alias("before")).join(after, key)
    return both.agg(F.count("*").alias("items"), F.avg("before").alias("mean_before"), F.avg("after").alias("mean_after"), F.count_if("improved").alias("improved"))
