"""Source code as chunks: imports, definitions and blocks, and its type declarations.

A definition reaches as far as its braces do (strings and comments skipped) or, in Python, as long as
lines are indented deeper. Everything works line by line; very long files are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Languages by extension.
EXTENSIONS = {
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "typescript",
    "py": "python", "pyi": "python", "rs": "rust", "go": "go", "java": "java",
}
#: Lines that import, by language.
IMPORTS = {
    "javascript": r"^\s*(import\s+|(const|let|var)\s+.*=\s*require\()",
    "typescript": r"^\s*(import\s+|(const|let|var)\s+.*=\s*require\()",
    "python": r"^\s*(import\s+|from\s+\S+\s+import)",
    "rust": r"^\s*(use\s+|mod\s+|extern\s+crate)",
    "go": r'^\s*import\s*\(|^\s*import\s+"',
    "java": r"^\s*import\s+",
}
#: Lines that open a type declaration, by language.
TYPES = {
    "typescript": r"^\s*(interface|type|enum)\s+\w+",
    "python": r"^\s*class\s+\w+",
    "rust": r"^\s*(struct|enum|trait|type)\s+\w+",
    "go": r"^\s*type\s+\w+",
    "java": r"^\s*(class|interface|enum)\s+\w+.*\{",
}
_SCRIPT = (
    ("function", r"^(export\s+)?(async\s+)?function\s+(\w+)"),
    ("class", r"^(export\s+)?class\s+(\w+)"),
    ("function", r"^(export\s+)?(const|let|var)\s+(\w+)\s*=.*=>"),
    ("function", r"(?!(?:if|for|while|switch|catch)\b)(\w+)\(.*\)\s*\{"),
)
#: Lines that open a definition, by language; the last group is its name.
DEFINITIONS = {
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "python": (("function", r"^\s*def\s+(\w+)"), ("class", r"^\s*class\s+(\w+)")),
    "rust": (("function", r"^\s*(fn|impl|pub\s+fn|pub\s+impl)\s+(\w+)"), ("class", r"^\s*(struct|enum|trait)\s+(\w+)")),
    "go": (("function", r"^\s*func\s+(?:\([^)]*\)\s+)?(\w+)"), ("class", r"^\s*type\s+(\w+)")),
    "java": (
        ("function", r"^\s*(public|private|protected|static|\s)*(?!(?:if|for|while|switch|catch|synchronized|return|new|throw)\s)(class|interface|enum|void|[A-Za-z0-9_<>]+)\s+(\w+)\s*\("),
        ("class", r"^\s*(public|private|protected)?\s*class\s+(\w+)"),
    ),
}
#: Words that open a block and are no function.
CONTROL = ("if", "for", "while", "switch", "catch")
CHUNK = "array<struct<type:string,name:string,text:string,start_line:int,end_line:int>>"
_TOKEN = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|([\"'`])(?:\\.|(?!\1).)*(?:\1|\Z)|[{}]", re.S)


@dataclass(frozen=True)
class Source:
    """The lines of a file and where each begins."""

    text: str
    lines: list[str]
    starts: list[int]
    language: str

    @classmethod
    def of(cls, text: str, language: str) -> Source:
        whole = text.replace("\r\n", "\n")
        lines, starts, at = whole.split("\n"), [], 0
        for line in lines:
            starts.append(at)
            at += len(line) + 1
        return cls(whole, lines, starts, language)

    def comment(self, i: int) -> bool:
        return re.match(r"\s*#" if self.language == "python" else r"\s*(//|/\*|\*)", self.lines[i]) is not None

    def definition(self, i: int) -> tuple[str, str] | None:
        """Kind and name of the definition that a line opens."""
        for kind, pattern in DEFINITIONS.get(self.language, ()):
            m = re.search(pattern, self.lines[i])
            if m and not (kind == "function" and m[m.lastindex] in CONTROL):
                return kind, m[len(m.groups())]
        return None

    def braced_end(self, i: int) -> int:
        """The line on which the first brace from line ``i`` on is closed; ``i`` itself without one, the last line if it isn't."""
        brace = self.text.find("{", self.starts[i])
        if brace < 0:
            return i
        depth = 0
        for m in _TOKEN.finditer(self.text, brace):
            depth += {"{": 1, "}": -1}.get(m.group(), 0)
            if depth == 0:
                return self.text.count("\n", 0, m.start())
        return len(self.lines) - 1

    def indented_end(self, i: int) -> int:
        """The last line before one that is indented no deeper than line ``i``."""
        deep = lambda line: len(re.match(r"[ \t]*", line).group().replace("\t", "    "))
        j = i + 1
        while j < len(self.lines) and (not self.lines[j].strip() or deep(self.lines[j]) > deep(self.lines[i])):
            j += 1
        return j - 1

    def end(self, i: int) -> int:
        return self.indented_end(i) if self.language == "python" else self.braced_end(i)

    def imports(self) -> list[int]:
        """The lines that import; in Go those of a list in brackets as well."""
        pattern = IMPORTS.get(self.language)
        out, listed = [], False
        for i, line in enumerate(self.lines if pattern else ()):
            if listed:
                out.append(i)
                listed = re.match(r"\s*\)", line) is None
            elif re.match(pattern, line):
                out.append(i)
                listed = self.language == "go" and re.match(r"\s*import\s*\(", line) is not None
        return out


def language_of(path: str | None) -> str | None:
    """The language of a file by its extension."""
    return EXTENSIONS.get((path or "").rpartition(".")[2].lower()) if "." in (path or "") else None


def chunks(text: str | None, language: str) -> list[dict]:
    """All imports as one chunk, then definitions and blocks in order; lines of comment and blank ones between them go."""
    source = Source.of(text or "", language)
    lines, taken = source.lines, source.imports()
    cut = lambda kind, name, i, j: {"type": kind, "name": name, "text": "\n".join(lines[i : j + 1]), "start_line": i + 1, "end_line": j + 1}
    out = [{**cut("import", None, taken[0], taken[-1]), "text": "\n".join(lines[i] for i in taken)}] if taken else []
    skipped, i, block = set(taken), 0, None
    while i <= len(lines):
        ends = i == len(lines) or i in skipped or not lines[i].strip() or source.comment(i)
        found = None if ends else source.definition(i)
        if block is not None and (ends or found):
            out.append(cut("block", None, block, i - 1))
            block = None
        if found:
            end = source.end(i)
            out.append(cut(*found, i, end))
            i = end
        elif not ends and block is None:
            block = i
        i += 1
    return out


def declarations(text: str | None, language: str) -> str:
    """Type declarations of a file; in TypeScript their first lines alone."""
    source, out, i = Source.of(text or "", language), [], 0
    pattern = TYPES.get(language)
    while pattern and i < len(source.lines):
        end = i
        if re.match(pattern, source.lines[i]):
            whole = language in ("python", "java") or (language != "typescript" and "{" in source.lines[i])
            end = source.end(i) if whole else i
            out += source.lines[i : end + 1]
        i = end + 1
    return "\n".join(out)


def imports(text: str | None, language: str) -> str:
    """The lines of a file that import."""
    source = Source.of(text or "", language)
    return "\n".join(source.lines[i] for i in source.imports())


def parsed(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(path, language, imports, declarations, chunks, error): a row a file; one of another kind has an error."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, text in zip(part["path"], part["text"], strict=True):
                language = language_of(path)
                rows.append((path, language, imports(text, language), declarations(text, language), chunks(text, language), None) if language else (path, None, None, None, [], f"unsupported code file: {path}"))
            yield pd.DataFrame(rows, columns=["path", "language", "imports", "declarations", "chunks", "error"])

    rows = files.select(F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(work, f"path string, language string, imports string, declarations string, chunks {CHUNK}, error string")


def is_code(path: Column) -> Column:
    """Whether a path has the extension of a known language."""
    return F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1)).isin(*EXTENSIONS)
