"""Segmentation: sentences, semantic units and chunks of bounded size, in Arrow batches.

Texts are processed whole. ``Limits`` may bound the characters and chunks of one text; none are set
unless a caller asks for them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """The most characters that are read of a text and the most chunks that are made of it; None for all."""

    chars: int | None = None
    chunks: int | None = None


#: No limits, and those that an interactive program would set.
WHOLE, GUARDED = Limits(), Limits(10 * 1024 * 1024, 100_000)
#: Words whose full stop ends no sentence.
ABBREVIATIONS = frozenset(
    "mr mrs ms dr prof sr jr vs etc eg ie inc ltd corp llc st ave blvd rd pl no vol vols pp pg cf et al approx dept univ fig figs eq eqs ch chs sec secs".split()
)
_WIDE = "。！？"
_CJK = re.compile("[一-鿿㐀-䶿豈-﫿぀-ゟ゠-ヿ가-힯]")
_BREAK = re.compile(r"\r\n|[\n\r]")
_STOP = re.compile(r"[.!?](?=\s|[\"'”»]|\Z)|\r\n|[\n\r]")
_ITEM = re.compile(r"\s*(?:[-*+]|\d+[.)])\s")


def _kept(parts: list[str], text: str) -> list[str]:
    found = [p for p in map(str.strip, parts) if p]
    return found or [text]


def sentences(text: str | None) -> list[str]:
    """Sentences of a text: by full-width punctuation, by 200 characters, or by stops, as its script asks for."""
    if not text:
        return []
    if any(c in text for c in _WIDE):
        return _kept(re.findall(rf"[^{_WIDE}\r\n]*(?:[{_WIDE}]|\r\n|[\r\n]|\Z)", text), text)
    if _CJK.search(text) and not re.search(r"[.!?\n\r]", text):
        return _kept([text[i : i + 200] for i in range(0, len(text), 200)], text)
    parts, start = [], 0
    for m in _STOP.finditer(text):
        if m.group() in ".!?":
            word = re.search(r"\S*\Z", text[max(start, m.start() - 80) : m.start()]).group()
            bare = re.sub(r"[^a-zA-Z0-9]", "", word).lower()
            if bare in ABBREVIATIONS or bare[-1:].isdigit():
                continue
        parts.append(text[start : m.end()])
        start = m.end()
    return _kept([*parts, text[start:]], text)


@dataclass(frozen=True)
class Unit:
    """A part of a text that stays together: code, a table or a list."""

    start: int
    end: int
    kind: str


def units(text: str) -> list[Unit]:
    """Fenced and indented code, tables (lines with two bars) and lists, with their continuations."""
    lines = text.split("\n")
    at = [0]
    for line in lines:
        at.append(at[-1] + len(line) + 1)
    at[-1] -= 1
    bars = lambda s: s.count("|") >= 2
    indented = lambda s: s.startswith("    ")
    out, i = [], 0

    def run(j: int, holds) -> int:
        while j < len(lines) and holds(lines[j]):
            j += 1
        return j

    while i < len(lines):
        line, j, kind = lines[i], i + 1, None
        if line.lstrip().startswith("```"):
            kind = "code_block"
            j = min(run(j, lambda s: not s.lstrip().startswith("```")) + 1, len(lines))
        elif bars(line):
            kind, j = "table", run(j, bars)
        elif indented(line) and line.strip(" ")[:1] not in ("", "\t", "\r"):
            kind, j = "code_block", run(j, lambda s: indented(s) or not s.strip())
        elif _ITEM.match(line):
            kind = "list"
            while j < len(lines):
                if not lines[j].strip():
                    j += 1
                    if j >= len(lines) or not _ITEM.match(lines[j]):
                        break
                elif _ITEM.match(lines[j]) or re.match(r" {2,}\S", lines[j]):
                    j += 1
                else:
                    break
        if kind:
            out.append(Unit(at[i], at[j], kind))
        i = j
    return out


def pieces(text: str, size: int) -> list[str]:
    """A text cut to ``size``, at white space in the back half of each piece where there is some."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            cut = max((m.start() for m in re.finditer(r"\s", text[start + size // 2 + 1 : end])), default=-1)
            end = end if cut < 0 else start + size // 2 + 1 + cut
        if part := text[start:end].strip():
            out.append(part)
        start = max(end, start + 1)
    return out


def density(text: str) -> float:
    """Words a character times the mean sentence length, over 50; 1 at most."""
    n = len(sentences(text))
    if not text or not n:
        return 0.5
    return min(1.0, len(re.split(r"\s+", text)) / len(text) * (len(text) / n) / 50)


class _Chunker:
    """Collects sentences and units into chunks; what a chunk begins with comes from the one before."""

    def __init__(self, size: int, overlap: int):
        self.size, self.overlap, self.out, self.now = size, overlap, [], ""

    def lead(self) -> str:
        """The end of the chunk before: ``overlap`` characters, or its last two sentences under a label."""
        before = self.out[-1] if self.out else ""
        if not before:
            return ""
        if self.overlap > 0:
            return before[-self.overlap :] + " "
        return "[CONTEXT FROM PREVIOUS CHUNK:] " + " ".join(sentences(before)[-2:]) + " "

    def close(self, rest: str = "") -> None:
        self.out.append(self.now.strip())
        self.now = self.lead() + rest

    def add(self, text: str, sep: str) -> None:
        self.now += (sep if self.now else "") + text

    def sentence(self, text: str) -> None:
        if self.now and len(self.now) + len(text) > self.size:
            # A word that begins within the last 20 characters goes on to the next chunk.
            tail = re.search(r"\s(\S{0,18})\Z", self.now)
            word = tail.group(1) if tail else ""
            if tail:
                self.now = self.now[: tail.start()].rstrip()
            self.close((word + " " if word else "") + text)
        elif not self.now and len(text) > 2 * self.size:
            self.out += [p for p in pieces(text, self.size) if p]
        else:
            self.add(text, " ")

    def unit(self, text: str, kind: str) -> None:
        if len(text) <= 2 * self.size:
            if self.now and len(self.now) + len(text) > self.size:
                self.close(text)
            else:
                self.add(text, " ")
            return
        rows = text.split("\n")
        if kind == "list":
            grouped: list[str] = []
            for row in rows:
                if grouped and not _ITEM.match(row):
                    grouped[-1] += "\n" + row
                else:
                    grouped.append(row)
            rows = grouped
        if self.now:
            self.close()
        for row in rows:
            if self.now and len(self.now) + len(row) > self.size:
                self.close(row)
            else:
                self.add(row, "\n")


def semantic_chunks(text: str | None, size: int = 2000, overlap: int = 100, smart: bool = False, limits: Limits = WHOLE) -> list[str]:
    """Chunks of whole sentences and units, about ``size`` characters; null or blank text has none.

    A unit up to twice the size stays whole; a longer one is cut between rows or items. A chunk
    over ten times the size is cut anyway. ``smart`` makes chunks larger for sparse text.
    """
    if not text or not text.strip():
        return []
    text = text[: limits.chars]
    size = min(max(size, 1), 50_000)
    overlap = min(max(overlap, 0), size // 2)
    if smart:
        d = density(text)
        size = size * 2 if d < 0.3 else int(size * 1.5) if d < 0.6 else size
    if len(text) <= size:
        return [text]
    found, at = [], 0
    for s in sentences(text):
        start = text.find(s, at)
        if start >= 0:
            found.append((s, start, start + len(s)))
            at = start + len(s)
    whole, starts = units(text), []
    starts = [u.start for u in whole]
    chunker, i = _Chunker(size, overlap), 0
    while i < len(found) and (limits.chunks is None or len(chunker.out) < limits.chunks):
        s, start, _ = found[i]
        k = bisect_right(starts, start) - 1
        i += 1
        if k < 0 or start >= whole[k].end:
            chunker.sentence(s)
            continue
        chunker.unit(text[whole[k].start : whole[k].end].strip(), whole[k].kind)
        while i < len(found) and found[i][2] <= whole[k].end:
            i += 1
    if chunker.now.strip():
        chunker.out.append(chunker.now.strip())
    return [p for c in chunker.out if c for p in (pieces(c, size) if len(c) > 10 * size else [c])]


def simple_chunks(text: str | None, size: int = 2000, limits: Limits = WHOLE) -> list[str]:
    """Chunks of ``size`` characters that end at the last white space, sentence or unit in their back half."""
    if not text or not text.strip():
        return []
    text = text[: limits.chars]
    size = min(max(size, 1), 50_000)
    if len(text) <= size:
        return [text]
    whole, out, start = units(text), [], 0
    starts = [u.start for u in whole]

    def within(lo: int, hi: int) -> list[Unit]:
        """The units that begin in the range, and the one before these."""
        return whole[max(0, bisect_right(starts, lo) - 1) : bisect_right(starts, hi)]

    while start < len(text) and (limits.chunks is None or len(out) < limits.chunks):
        end = start + size
        if end < len(text):
            half = int(start + size / 2)
            back = text[half:end]
            spots = [half + m.start() for m in re.finditer(r"\s", back)]
            spots += [half + m.end() for m in re.finditer(rf"[{_WIDE}\n\r]|[.!?](?=\s)", text[half : end + 1]) if half + m.start() < end]
            spots += [u.start for u in within(start, end) if u.start < end < u.end]
            end = max((p for p in spots if p > start + size / 2), default=end)
        out.append(text[start:end].strip())
        start = end
    return [c for c in out if c]


def _each(work):
    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: work(t or ""))

    return run


def chunked(docs: DataFrame, chunks: Column, id_col: str = "doc_id", most: int | None = None) -> DataFrame:
    """(id, chunk_index, chunk) from a column of chunk arrays; ``most`` chunks of each text at most."""
    rows = docs.select(id_col, F.posexplode(chunks).alias("chunk_index", "chunk"))
    return rows if most is None else rows.where(F.col("chunk_index") < most)


def semantic(text: Column, size: int = 2000, overlap: int = 100, smart: bool = False, limits: Limits = WHOLE) -> Column:
    """:func:`semantic_chunks` of a column."""
    return _each(lambda t: semantic_chunks(t, size, overlap, smart, limits))(text)


def simple(text: Column, size: int = 2000, limits: Limits = WHOLE) -> Column:
    """:func:`simple_chunks` of a column."""
    return _each(lambda t: simple_chunks(t, size, limits))(text)


def document_chunks(text: str | None, size: int | None = None, smart: bool = False, most: int | None = None, limits: Limits = WHOLE) -> list[str]:
    """Chunks of a document: semantic ones with an overlap of 100, the size within 500 and 10,000 (8,000 if unset).

    Simple chunks take the place of semantic ones that fail or of which there are none; ``most`` cuts the list.
    """
    width = min(10_000, max(500, size or 8000))
    try:
        found = semantic_chunks(text, width, 100, smart, limits)
    except (ValueError, re.error, RecursionError):
        found = []
    return (found or simple_chunks(text, width, limits))[: most or None]


def documents(text: Column, size: int | None = None, smart: bool = False, most: int | None = None) -> Column:
    """:func:`document_chunks` of a column."""
    return _each(lambda t: document_chunks(t, size, smart, most))(text)


def split_sentences(text: Column) -> Column:
    """:func:`sentences` of a column."""
    return _each(sentences)(text)


def density_of(text: Column) -> Column:
    """:func:`density` of a column."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: density(t or ""))

    return run(text)
