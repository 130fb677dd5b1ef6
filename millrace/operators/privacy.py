"""Personal data and secrets: detection, redaction, classification, quarantine, retention."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import ascii_bounded, matches

#: What personal data looks like; word boundaries and classes are ASCII.
PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone": r"\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?){1,2}\d{4}\b",
    "ssn": r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b",
    "credit_card": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "address": r"(?i)\b\d+\s+(?:[A-Za-z0-9.-]+\s+)*(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Way|Court|Ct|Plaza|Plz|Suite|Ste|Apartment|Apt)\b",
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "url": r"\bhttps?://[^\s]+\b",
    "date_of_birth": r"\b(?:0[1-9]|1[0-2])[/-](?:0[1-9]|[12]\d|3[01])[/-](?:19|20)\d{2}\b",
}
#: Classes with their patterns, greatest risk, days of retention and priority.
CLASSES = {
    "pii": (("email", "phone", "ssn", "passport"), 0.8, 30, 1),
    "health": ((), 0.7, 30, 2),
    "financial": (("credit_card",), 0.9, 60, 3),
    "secret": (("api_key", "password"), 1.0, 90, 4),
}
CLASS_PATTERNS = {
    **{k: PATTERNS[k] for k in ("email", "phone", "ssn", "credit_card")},
    "api_key": r"""(?i)\b(?:api[_-]?key|apikey)\s*[:=]\s*['"]?[a-zA-Z0-9_\-]{16,}['"]?""",
    "password": r"""(?i)\b(?:password|passwd|pwd)\s*[:=]\s*['"]?[^\s'"]{8,}['"]?""",
    "passport": r"\b[A-Za-z]\d{7,}\b",
}
_STREETS = "Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Way|Court|Ct|Plaza|Plz|Suite|Ste|Apartment|Apt"
#: What a text must hold for a pattern to occur in it: patterns that are cheap and that most texts lack.
NEEDED = {
    "email": ("@",),
    "phone": ("[0-9]{4}",),
    "ssn": ("[0-9]{4}",),
    "credit_card": ("[0-9]{4}",),
    "address": (r"[0-9]\s", rf"(?i)\s(?:{_STREETS})(?![A-Za-z0-9_])"),
    "ip_address": (r"[0-9]\.[0-9]",),
    "url": ("://",),
    "date_of_birth": ("[/-](?:19|20)[0-9]{2}",),
    "api_key": (r"(?i)key\s*[:=]",),
    "password": (r"(?i)(?:password|passwd|pwd)\s*[:=]",),
    "passport": ("[0-9]{7}",),
}
#: Words in the name of a custom pattern, by the class that they suggest, first to last.
NAMED_CLASSES = {
    "pii": ("ssn", "email", "phone", "passport"),
    "financial": ("credit", "card", "bank", "iban"),
    "secret": ("api", "key", "password", "secret", "token"),
    "health": ("health", "medical", "patient", "diagnosis"),
}
MATCHES = "array<struct<type:string,start:int,end:int,value:string>>"


def may_hold(text: Column, kind: str) -> Column:
    """Whether a text can hold the kind at all; see ``NEEDED``."""
    return reduce(Column.__and__, (F.rlike(text, F.lit(p)) for p in NEEDED[kind]))


def pii_counts(text: Column) -> dict[str, Column]:
    """How often each kind occurs, overlaps included."""
    return {kind: F.when(may_hold(text, kind), matches(text, p)).otherwise(0).cast("bigint") for kind, p in PATTERNS.items()}


def compiled(patterns: dict[str, str] | None = None) -> list[tuple]:
    """(kind, Python pattern); classes and boundaries are ASCII."""
    import re

    return [(kind, re.compile(p, re.ASCII)) for kind, p in (patterns or PATTERNS).items()]


def spans(text: str, patterns: list[tuple]) -> list[tuple[str, int, int, str]]:
    """Matches without overlaps: the first, and of those that begin together the longest."""
    found = [(m.start(), -m.end(), n, kind, m.group()) for n, (kind, p) in enumerate(patterns) for m in p.finditer(text)]
    out, end = [], -1
    for start, stop, _, kind, value in sorted(found):
        if start >= end:
            out.append((kind, start, -stop, value))
            end = -stop
    return out


def redacted(text: str, patterns: list[tuple]) -> str:
    """Text with each match replaced by its kind in brackets."""
    return without(text, spans(text, patterns))


def without(text: str, found: list[tuple[str, int, int, str]]) -> str:
    """Text with the given matches replaced by their kinds in brackets."""
    out, at = [], 0
    for kind, start, end, _ in found:
        out += [text[at:start], f"[{kind.upper()}_REDACTED]"]
        at = end
    return "".join([*out, text[at:]])


def inspect(patterns: dict[str, str] | None = None):
    """An Arrow function of a text column, one pass a text: its matches (type, start, end, value), the text without them, and a score.

    A null text has no matches and stays null. The score is a tenth off for each match.
    """

    @F.pandas_udf(f"matches {MATCHES}, redacted string, score double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = compiled(patterns)
        for s in parts:
            found = [spans(t or "", known) for t in s]
            yield pd.DataFrame(
                {
                    "matches": [[{"type": k, "start": a, "end": b, "value": v} for k, a, b, v in x] for x in found],
                    "redacted": [None if t is None else without(t, x) for t, x in zip(s, found, strict=True)],
                    "score": [max(0.0, 1 - 0.1 * len(x)) for x in found],
                }
            )

    return run


def detect(patterns: dict[str, str] | None = None):
    """The matches alone of :func:`inspect`."""
    return lambda text: inspect(patterns)(text)["matches"]


def redact(patterns: dict[str, str] | None = None):
    """The redacted text alone of :func:`inspect`."""
    return lambda text: inspect(patterns)(text)["redacted"]


def redaction_log(inspected: DataFrame, id_col: str, matches: Column, at: Column) -> DataFrame:
    """(item, type, start, end, value_sha256, redacted_at): an entry a match, by the hash of the item's id, without the values."""
    rows = inspected.select(F.sha2(F.col(id_col).cast("string"), 256).alias("item"), F.explode(matches).alias("m"))
    return rows.select("item", "m.type", "m.start", "m.end", F.sha2("m.value", 256).alias("value_sha256"), at.alias("redacted_at"))


def kind_of_name(name: Column) -> Column:
    """The class that a custom pattern's name suggests."""
    low = F.lower(name)
    out = F.when(F.lit(False), "")
    for kind, words in NAMED_CLASSES.items():
        for word in words:
            out = out.when(F.contains(low, F.lit(word)), kind)
    return out.otherwise("pii")


def class_counts(text: Column) -> dict[str, Column]:
    """How many different matches of its patterns each class has."""
    found = lambda k: F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(ascii_bounded(CLASS_PATTERNS[k])), F.lit(0))))
    distinct = lambda k: F.when(may_hold(text, k), found(k)).otherwise(0)
    out = {}
    for name, (kinds, *_) in CLASSES.items():
        counts = [distinct(k) for k in kinds]
        out[name] = sum(counts[1:], counts[0]) if counts else F.lit(0)
    return out


def classify(df: DataFrame, text: Column) -> DataFrame:
    """Adds risk (greatest of the classes' risks), class (of the greatest risk, then priority) and retention_days."""
    counts = class_counts(F.coalesce(text, F.lit("")))
    rows = df.select("*", *(c.alias(f"n_{name}") for name, c in counts.items()))
    entry = lambda name: F.struct(F.least(F.lit(CLASSES[name][1]), F.least(F.lit(1.0), F.col(f"n_{name}") * 0.25)).alias("risk"), F.lit(CLASSES[name][3]).alias("priority"), F.lit(name).alias("class"), F.lit(CLASSES[name][2]).alias("days"))
    all_of = F.filter(F.array(*(F.when(F.col(f"n_{n}") > 0, entry(n)) for n in CLASSES)), lambda x: x.isNotNull())
    top = F.array_max(all_of)
    return rows.select(
        *df.columns,
        *(F.col(f"n_{n}").cast("bigint").alias(f"n_{n}") for n in CLASSES),
        F.coalesce(top["risk"], F.lit(0.0)).alias("risk"),
        F.coalesce(top["class"], F.lit("none")).alias("risk_class"),
        F.coalesce(top["days"], F.lit(0)).cast("bigint").alias("retention_days"),
    )


def quarantine(df: DataFrame, least_risk: float, at: Column) -> DataFrame:
    """Rows whose risk reaches ``least_risk``, with reason and time; see :func:`classify`."""
    return df.where(F.col("risk") >= least_risk).withColumn("reason", F.concat(F.lit("risk:"), F.col("risk_class"))).withColumn("quarantined_at", at)


def purge(quarantined: DataFrame, now: Column, days: int) -> DataFrame:
    """Quarantined rows that are not older than ``days``."""
    return quarantined.where(F.col("quarantined_at") >= now - F.expr(f"INTERVAL {days} DAYS"))


def retained(df: DataFrame, deleted_at: str, cutoff: int) -> DataFrame:
    """Rows that are not deleted, or not before ``cutoff`` (epoch milliseconds)."""
    return df.where(F.col(deleted_at).isNull() | (F.col(deleted_at) >= cutoff))


def scrub(properties: Column, words: str = "password|token|secret|email|key|auth|path|user") -> Column:
    """A map without entries whose key has one of the words as a part (camel case and underscores split)."""
    parts = lambda k: F.split(F.lower(F.regexp_replace(k, "([a-z0-9])([A-Z])", "$1_$2")), r"[_\-.\s]+")
    listed = F.array(*map(F.lit, words.split("|")))
    return F.map_filter(properties, lambda k, v: ~F.arrays_overlap(parts(k), listed))


def released(quarantined: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Quarantined rows without those whose ids are released."""
    return quarantined.join(ids.select(id_col).distinct(), id_col, "left_anti")


def listed(quarantined: DataFrame, id_col: str) -> DataFrame:
    """Quarantined rows, the latest first, then by id downwards."""
    return quarantined.orderBy(F.desc("quarantined_at"), F.desc(id_col))
