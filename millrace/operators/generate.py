"""Generation: prompts to responses by a provider, cache first, in Arrow batches.

A provider is any object with ``generate(prompt, options) -> (text, tokens)``; it must be
picklable, as each task uses its own copy. Calls retry with waiting times that double, and a
failed call gives an error row rather than a failed job.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.planning import cache_key, uncached


class Provider(Protocol):
    """What generates."""

    name: str

    def generate(self, prompt: str, options: dict) -> tuple[str, int]: ...


@dataclass(frozen=True)
class Offline:
    """A provider without a model: the same answer to the same prompt, for tests and dry runs."""

    name: str = "offline"

    def generate(self, prompt: str, options: dict) -> tuple[str, int]:
        words = prompt.split()
        topic = " ".join(words[-6:])
        return f"Question: What is said about {topic}?\nAnswer: {' '.join(words[-12:])}", -(-len(prompt) // 4)


@dataclass(frozen=True)
class Failover:
    """Providers in order of priority; the next is asked where one fails."""

    providers: tuple
    name: str = "failover"

    def generate(self, prompt: str, options: dict) -> tuple[str, int]:
        errors = []
        for p in self.providers:
            try:
                return p.generate(prompt, options)
            except Exception as e:  # noqa: BLE001  any failure moves on to the next provider
                errors.append(f"{p.name}: {e}")
        raise RuntimeError("; ".join(errors))


class Refused(Exception):
    """A call that no retry can help, such as one without permission."""


def with_retries(provider: Provider, prompt: str, options: dict, retries: int = 3, wait: float = 1.0) -> tuple[str, int]:
    """A call that is repeated up to ``retries`` times, after ``wait`` seconds, doubled each time."""
    for n in range(retries + 1):
        try:
            return provider.generate(prompt, options)
        except Refused:
            raise
        except Exception:  # noqa: BLE001  a provider may raise anything
            if n == retries:
                raise
            time.sleep(wait * 2**n)
    raise AssertionError


#: Options by kind of work: the temperature and how far probabilities are cut.
OPTIONS = {"instruction": (0.3, 0.9), "conversation": (0.7, 0.9), "chunking": (0.2, 0.9), "custom": (0.5, 0.95)}


def prompt_of(template: str, text: Column) -> Column:
    """A template with the text in the place of its mark."""
    marked = F.lit(template)
    for mark in ("{{text}}", "{text}"):
        marked = F.replace(marked, F.lit(mark), text)
    return marked


def generate(requests: DataFrame, provider: Provider, options: dict | None = None, cache: DataFrame | None = None, wait: float = 1.0) -> DataFrame:
    """Adds response, tokens, error and from_cache to ``requests`` (with prompt and model).

    Requests whose key the cache has are not generated.
    """
    keyed = requests.withColumn("key", cache_key(F.lit(provider.name), F.col("model"), F.col("prompt")))
    todo = keyed if cache is None else uncached(keyed, cache)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema) + ", response string, tokens bigint, error string"

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def call(prompt: str) -> tuple:
            try:
                return (*with_retries(provider, prompt or "", options or {}, wait=wait), None)
            except Exception as e:  # noqa: BLE001  becomes the row's error
                return None, 0, str(e)

        for part in parts:
            found = [call(p) for p in part["prompt"]]
            yield part.assign(response=[x[0] for x in found], tokens=[x[1] for x in found], error=[x[2] for x in found])

    made = todo.mapInPandas(work, schema).withColumn("from_cache", F.lit(False))
    if cache is None:
        return made
    known = keyed.join(cache.select("key", "response"), "key").select(*keyed.columns, "response", F.lit(0).cast("bigint").alias("tokens"), F.lit(None).cast("string").alias("error"), F.lit(True).alias("from_cache"))
    return made.unionByName(known)


def run_chain(df: DataFrame, steps: list[tuple[str, str, list[str]]], provider: Provider, model: str = "default") -> DataFrame:
    """Steps (name, template, earlier steps): each prompts with the text and the answers of those before, as {{name}}."""
    seen: list[str] = []
    for name, template, needs in steps:
        if missing := [n for n in needs if n not in seen]:
            raise ValueError(f"step {name!r} needs {missing}, which come later or not at all")
        prompt = prompt_of(template, F.col("text"))
        for n in needs:
            prompt = F.replace(prompt, F.lit("{{" + n + "}}"), F.coalesce(n, F.lit("")))
        out = generate(df.withColumn("prompt", prompt).withColumn("model", F.lit(model)), provider)
        df = out.withColumn(name, F.col("response")).select(*df.columns, name)
        seen.append(name)
    return df
