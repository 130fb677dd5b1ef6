"""Pipelines of steps from DataFrame to DataFrame, and the registry for extensions.

Steps only compose; Spark plans the whole. A step may be checkpointed to cut a long lineage.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


def keep(condition: Column) -> Step:
    """Rows that meet a condition."""
    return lambda df: df.where(condition)


def with_columns(**columns: Column) -> Step:
    """Columns added or replaced."""
    return lambda df: df.withColumns(columns)


def in_batches(work, schema) -> Step:
    """Pandas batches mapped by ``work``."""
    return lambda df: df.mapInPandas(work, schema)


def validated(result: Column, remove: bool = True) -> Step:
    """Rows that pass a validator; or all, with the flags of those that fail added to ``tags``."""

    def run(df: DataFrame) -> DataFrame:
        if remove:
            return df.where(result["passed"])
        own = F.coalesce("tags", F.array().cast("array<string>")) if "tags" in df.columns else F.array().cast("array<string>")
        return df.withColumn("tags", F.when(result["passed"], own).otherwise(F.concat(own, F.array(F.lit("validation_failed")), result["flags"])))

    return run


@dataclass
class Pipeline:
    """Named steps in order; ``before`` and ``after`` see every step's name and frame."""

    steps: list[tuple[str, Step]] = field(default_factory=list)
    before: list[Callable[[str, DataFrame], None]] = field(default_factory=list)
    after: list[Callable[[str, DataFrame], None]] = field(default_factory=list)

    def add(self, name: str, step: Step) -> Pipeline:
        if any(n == name for n, _ in self.steps):
            raise ValueError(f"a step is already named {name!r}")
        self.steps.append((name, step))
        return self

    def run(self, df: DataFrame) -> DataFrame:
        for name, step in self.steps:
            for hook in self.before:
                hook(name, df)
            df = df.transform(step)
            for hook in self.after:
                hook(name, df)
        return df


@dataclass
class Registry:
    """Processors, validators, layouts and providers by name."""

    kinds: dict[str, dict[str, object]] = field(default_factory=lambda: {k: {} for k in ("processor", "validator", "layout", "provider")})

    def register(self, kind: str, name: str, what: object) -> None:
        if kind not in self.kinds:
            raise ValueError(f"nothing of kind {kind!r} can be registered")
        self.kinds[kind][name] = what

    def get(self, kind: str, name: str) -> object:
        if name not in self.kinds.get(kind, {}):
            raise KeyError(f"no {kind} is named {name!r}")
        return self.kinds[kind][name]
