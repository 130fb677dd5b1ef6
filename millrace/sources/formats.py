"""Parsers of single files, from bytes to text; each is plain Python that runs in Arrow batches."""

from __future__ import annotations

import base64
import csv
import html
import io
import json
import quopri
import re
import zipfile
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

#: Limits of archives: entries, bytes of one, bytes of all.
MOST_ENTRIES, MOST_ENTRY, MOST_ALL = 10_000, 50 << 20, 200 << 20


def decoded(content: bytes) -> str:
    """UTF-8 text without a byte-order mark, line feeds alone between lines."""
    return re.sub(r"\r\n?", "\n", content.decode("utf-8", "replace").removeprefix("\ufeff"))


def archive(content: bytes) -> dict[str, bytes]:
    """The files of a ZIP archive, within limits."""
    out, total = {}, 0
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        infos = z.infolist()
        if len(infos) > MOST_ENTRIES:
            raise ValueError("the archive has too many entries")
        for info in infos:
            total += info.file_size
            if info.file_size > MOST_ENTRY or total > MOST_ALL:
                raise ValueError("the archive is too large")
            if not info.is_dir():
                out[info.filename] = z.read(info)
    return out


class _Text(HTMLParser):
    """Text of HTML, with line feeds at the ends of blocks."""

    BLOCKS = frozenset("p div li tr h1 h2 h3 h4 h5 h6 section article blockquote table ul ol br title".split())
    HIDDEN = frozenset(("script", "style", "head", "noscript"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self._hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self._hidden += tag in self.HIDDEN
        if tag == "br":
            self.parts.append("\n")

    def handle_endtag(self, tag):
        self._hidden -= tag in self.HIDDEN and self._hidden > 0
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self._hidden:
            self.parts.append(data)


def html_text(text: str) -> str:
    """Text of HTML without links' targets and images."""
    parser = _Text()
    parser.feed(text)
    parser.close()
    joined = re.sub(r"[ \t]+", " ", "".join(parser.parts))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" ?\n ?", "\n", joined)).strip()


def rtf_text(text: str) -> str:
    """Text of RTF: escapes decoded, control words and groups of settings removed."""
    text = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info|\*)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", text)
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), text)
    text = re.sub(r"\\u(-?\d+)\??", lambda m: chr(int(m[1]) % 65536), text)
    text = re.sub(r"\\(?:par|line)\b ?", "\n", text)
    return re.sub(r"\\[a-zA-Z]+-?\d* ?|[{}]|\\[^a-zA-Z]", "", text).strip()


def _xml(data: bytes) -> ElementTree.Element:
    if b"<!ENTITY" in data:
        raise ValueError("entity definitions are not read")
    return ElementTree.fromstring(data)


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _named(root: ElementTree.Element, *names: str) -> Iterator[ElementTree.Element]:
    return (e for e in root.iter() if _local(e) in names)


def _content(e: ElementTree.Element, leaf: str = "t") -> str:
    return "".join(x.text or "" for x in _named(e, leaf))


def _attr(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def table(rows: list[list]) -> str:
    """A Markdown table, its first row the head."""
    width = max(map(len, rows), default=0)
    if not width:
        return ""
    cell = lambda v: ("null" if v is None else str(v)).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(map(cell, [*r, *[""] * (width - len(r))])) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def docx_text(content: bytes) -> str:
    """Paragraphs of a word-processing document."""
    root = _xml(archive(content)["word/document.xml"])
    return "\n".join(_content(p) for p in _named(root, "p")).strip()


def column_index(name: str) -> int:
    """A spreadsheet column's place, from 0."""
    n = 0
    for c in name.upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def sheets(content: bytes) -> list[tuple[str, list[list]]]:
    """(name, rows) of a workbook: workbook, relations and shared strings joined."""
    files = archive(content)
    shared = [_content(s) for s in _named(_xml(files["xl/sharedStrings.xml"]), "si")] if "xl/sharedStrings.xml" in files else []
    targets = {_attr(r, "Id"): _attr(r, "Target") for r in _named(_xml(files["xl/_rels/workbook.xml.rels"]), "Relationship")}
    out = []
    for s in _named(_xml(files["xl/workbook.xml"]), "sheet"):
        target = targets.get(s.attrib.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")) or ""
        data = files.get(target.lstrip("/") if target.startswith("/") else f"xl/{target}")
        if data is None:
            continue
        rows = []
        for r in _named(_xml(data), "row"):
            cells: list = []
            for c in (x for x in r if _local(x) == "c"):
                at = column_index(re.match(r"[A-Za-z]*", _attr(c, "r") or "").group() or "A") if _attr(c, "r") else len(cells)
                value = next((x.text or "" for x in c if _local(x) == "v"), "")
                kind = _attr(c, "t") or "n"
                if kind == "s":
                    value = shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
                elif kind == "inlineStr":
                    value = _content(c)
                elif kind == "b":
                    value = "true" if value == "1" else "false"
                cells += [""] * (at - len(cells)) + [value]
            rows.append(cells)
        out.append((_attr(s, "name") or "", rows))
    return out


def slides(content: bytes) -> list[dict]:
    """number, title, body, tables and notes of each slide, by number."""
    files = archive(content)
    number = lambda kind: {int(m[1]): n for n in files if (m := re.fullmatch(rf"ppt/{kind}(\d+)\.xml", n))}
    notes = {k: " ".join(filter(None, (_content(p) for p in _named(_xml(files[n]), "p")))) for k, n in number("notesSlides/notesSlide").items()}
    out = []
    for k, name in sorted(number("slides/slide").items()):
        root, title, body = _xml(files[name]), "", []
        for shape in _named(root, "sp"):
            text = "\n".join(filter(None, (_content(p) for p in _named(shape, "p"))))
            if text and not title and any(_attr(p, "type") in ("title", "ctrTitle") for p in _named(shape, "ph")):
                title = text
            elif text:
                body.append(text)
        tables = [[[_content(c) for c in _named(r, "tc")] for r in _named(t, "tr")] for t in _named(root, "tbl")]
        out.append({"number": k, "title": title, "body": "\n".join(body), "tables": tables, "notes": notes.get(k, "")})
    return out


def chapters(content: bytes) -> list[tuple[str, str]]:
    """(title, text) of a book's chapters, in reading order."""
    files = archive(content)
    opf = _attr(next(_named(_xml(files["META-INF/container.xml"]), "rootfile")), "full-path")
    package = _xml(files[opf])
    base = opf.rpartition("/")[0]
    manifest = {_attr(i, "id"): (_attr(i, "href"), _attr(i, "media-type") or "") for i in _named(package, "item")}
    out = []
    for ref in _named(package, "itemref"):
        href, kind = manifest.get(_attr(ref, "idref"), (None, ""))
        data = files.get(f"{base}/{href}" if base else href or "")
        if data is None or "html" not in kind:
            continue
        text = decoded(data)
        head = re.search(r"(?is)<h[123]\b[^>]*>(.*?)</h[123]>", text)
        out.append((html.unescape(re.sub(r"<[^>]+>", "", head[1])).strip() if head else "", html_text(text)))
    return out


def open_document(content: bytes, kind: str) -> str:
    """Text of an open document: headings and paragraphs, tables, or slides between rules."""
    root = _xml(archive(content)["content.xml"])
    whole = lambda e: "".join(e.itertext())
    if kind == "ods":
        return "\n\n".join(table([[whole(c) for c in _named(r, "table-cell")] for r in _named(t, "table-row")]) for t in _named(root, "table"))
    if kind == "odp":
        return "\n---\n".join("\n".join(filter(None, map(whole, _named(p, "p")))) for p in _named(root, "page"))
    return "\n".join(filter(None, (*map(whole, _named(root, "h")), *map(whole, _named(root, "p")))))


def visio_text(content: bytes) -> str:
    """Texts of a drawing's pages."""
    files = archive(content)
    return "\n".join("".join(t.itertext()).strip() for n in sorted(files) if re.fullmatch(r"visio/pages/page\d+\.xml", n) for t in _named(_xml(files[n]), "Text"))


def outline(content: bytes) -> str:
    """A mind map as lines, four blanks a level."""
    out: list[str] = []

    def walk(e: ElementTree.Element, depth: int) -> None:
        if _local(e) == "node":
            out.append("    " * depth + (_attr(e, "TEXT") or ""))
            depth += 1
        for child in e:
            walk(child, depth)

    walk(_xml(content), 0)
    return "\n".join(out)


def latex_text(text: str) -> str:
    """Title, author and body of LaTeX without comments and commands, formulas as a mark."""
    text = re.sub(r"(?<!\\)%.*", "", text)
    heads = [m[1] for k in ("title", "author", "date") if (m := re.search(rf"\\{k}\{{([^{{}}]*)\}}", text))]
    body = re.search(r"\\begin\{document\}(.*?)(?:\\end\{document\}|\Z)", text, re.S)
    t = body[1] if body else text
    t = re.sub(r"\\(?:sub)*section\*?\{([^{}]*)\}", r"\n\n\1\n\n", t)
    t = re.sub(r"\$\$.*?\$\$|\\\[.*?\\\]|\\\(.*?\\\)|\$[^$]*\$", " [MATH] ", t, flags=re.S)
    t = re.sub(r"\\(?:textbf|textit|emph|underline|texttt)\{([^{}]*)\}", r"\1", t)
    t = re.sub(r"\\[a-zA-Z]+\*?(?:\{[^{}]*\})?|[{}]", " ", t)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", "\n".join([*heads, t]))).strip()


def email_text(text: str) -> str:
    """Subject and plain text of a message; of alternatives the plain one."""
    head, _, body = text.partition("\n\n")
    fields = dict((m[1].lower(), m[2].strip()) for m in re.finditer(r"(?m)^([\w-]+):(.*)$", re.sub(r"\n[ \t]+", " ", head)))

    def part(kind: str, encoding: str, data: str) -> str:
        if encoding.lower() == "base64":
            data = base64.b64decode(re.sub(r"\s", "", data)).decode("utf-8", "replace")
        elif encoding.lower() == "quoted-printable":
            data = quopri.decodestring(data.encode()).decode("utf-8", "replace")
        return html_text(data) if "html" in kind else data.strip()

    kind = fields.get("content-type", "text/plain")
    if bound := re.search(r'boundary="?([^";]+)"?', kind):
        parts = []
        for p in body.split("--" + bound[1])[1:]:
            h, _, d = p.lstrip("\n").partition("\n\n")
            own = dict((m[1].lower(), m[2].strip()) for m in re.finditer(r"(?m)^([\w-]+):(.*)$", h))
            parts.append((own.get("content-type", "text/plain"), own.get("content-transfer-encoding", ""), d))
        texts = [p for p in parts if "text/plain" in p[0]] or [p for p in parts if "text/" in p[0]]
        shown = part(*texts[0]) if texts else ""
    else:
        shown = part(kind, fields.get("content-transfer-encoding", ""), body)
    return "\n\n".join(filter(None, (fields.get("subject", ""), shown)))


def feed_entries(content: bytes) -> list[tuple[str, str, str]]:
    """(title, link, text) of a feed's items or entries."""
    root = _xml(content)
    out = []
    for e in [*_named(root, "item"), *_named(root, "entry")]:
        child = {_local(c): c for c in reversed(list(e))}
        text = next((("".join(child[k].itertext())) for k in ("description", "summary", "content") if k in child), "")
        link = child.get("link")
        out.append(("".join(child["title"].itertext()).strip() if "title" in child else "", (link.text or _attr(link, "href") or "").strip() if link is not None else "", html_text(text)))
    return out


def captions(text: str) -> list[str]:
    """Captions of SRT or VTT: what stands below a line of times, to the next blank line."""
    out: list[list[str]] = []
    inside = False
    for line in map(str.strip, text.split("\n")):
        if re.match(r"\d{2}:\d{2}:\d{2}[.,]\d{3}", line):
            out.append([])
            inside = True
        elif not line:
            inside = False
        elif inside:
            out[-1].append(line)
    return [" ".join(c) for c in out if c]


def _pdf_streams(content: bytes) -> Iterator[bytes]:
    """A PDF's streams, inflated where their dictionaries say so; streams that don't inflate are skipped."""
    for m in re.finditer(rb"<<((?:[^<>]|<(?!<)|>(?!>)|<<(?:[^<>]|<(?!<)|>(?!>))*>>)*)>>\s*stream\r?\n", content):
        end = content.find(b"endstream", m.end())
        data = content[m.end() : end if end >= 0 else len(content)]
        if b"FlateDecode" not in m[1]:
            yield data
            continue
        try:
            yield zlib.decompressobj().decompress(data)
        except zlib.error:
            continue


def _pdf_shown(stream: str) -> list[str]:
    """The strings that text blocks show, by Tj, ' and \" or by the parts of a TJ array."""
    escapes = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
    plain = lambda x: re.sub(r"\\([0-7]{1,3}|.)", lambda m: chr(int(m[1], 8)) if m[1][0] in "01234567" else escapes.get(m[1], m[1]), x, flags=re.S)
    out = []
    for block in re.findall(r"\bBT\b(.*?)\bET\b", stream, re.S):
        for array, one in re.findall(r"\[((?:\((?:\\.|[^\\()])*\)|[^\]()])*)\]\s*TJ|\(((?:\\.|[^\\()])*)\)\s*(?:Tj|'|\")", block, re.S):
            out.append(plain("".join(re.findall(r"\(((?:\\.|[^\\()])*)\)", array, re.S)) if array else one))
    return out


def pdf_text(content: bytes, most: int | None = None) -> str:
    """Readable text of a PDF's text blocks, compressed or not; else of its bytes, of ``most`` of them if that is set."""
    found = [x for data in _pdf_streams(content) for x in _pdf_shown(data.decode("latin-1"))] or _pdf_shown(content.decode("latin-1"))
    if found:
        return " ".join(found)
    raw = content.decode("latin-1")
    return re.sub(r"\s+", " ", re.sub(r"[^\x20-\x7e\n]", " ", raw[:most])).strip()


def image_only_pdf(content: bytes, least: int = 20) -> bool:
    """Whether a PDF has images and hardly any text: fewer than ``least`` characters are shown."""
    shown = sum(len(x.strip()) for data in _pdf_streams(content) for x in _pdf_shown(data.decode("latin-1")))
    return re.search(rb"/Subtype\s*/Image", content) is not None and shown < least


def fields(text: str | None) -> list[tuple[str, str, str | None]]:
    """(path, type, value as JSON) of all that an object holds; nothing of other JSON and of what isn't JSON."""
    try:
        data = json.loads(text or "")
    except ValueError:
        return []
    out: list[tuple[str, str, str | None]] = []

    def walk(obj: dict, prefix: str) -> None:
        for key, v in obj.items():
            kind = "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"
            out.append((prefix + key, kind, None if v is None else json.dumps(v, ensure_ascii=False)))
            if kind == "object":
                walk(v, prefix + key + ".")

    for item in data if isinstance(data, list) else [data]:
        if isinstance(item, dict):
            walk(item, "")
    return out


def flattened(obj: dict, prefix: str = "") -> dict:
    """An object's leaves by dotted key."""
    out = {}
    for key, v in obj.items():
        out |= flattened(v, f"{prefix}{key}.") if isinstance(v, dict) else {prefix + key: v}
    return out


def json_table(text: str, lines: bool = False) -> str:
    """JSON, or JSON lines, as a Markdown table of flattened objects."""
    if lines:
        data = []
        for line in filter(str.strip, text.split("\n")):
            try:
                data.append(json.loads(line))
            except ValueError:
                continue
    else:
        data = json.loads(text)
    if isinstance(data, dict) and not lines:
        return table([["key", "value"], *([k, _shown(v)] for k, v in flattened(data).items())])
    rows = [flattened(x) if isinstance(x, dict) else {"value": x} for x in (data if isinstance(data, list) else [data])]
    heads = list(dict.fromkeys(k for r in rows for k in r))
    return table([heads, *([_shown(r[h]) if h in r else "" for h in heads] for r in rows)])


def _shown(v):
    if v is None or isinstance(v, str):
        return v
    return json.dumps(v, ensure_ascii=False)


def csv_table(text: str, delimiter: str = ",", quote: str = '"') -> str:
    """CSV as a Markdown table."""
    return table([r for r in csv.reader(io.StringIO(text), delimiter=delimiter, quotechar=quote) if r])


def csv_schema(rows: list[list[str]]) -> list[tuple[str, str, bool]]:
    """(name, type, nullable) of a CSV's columns, from all rows below its head."""
    out = []
    for i, name in enumerate(rows[0] if rows else []):
        values = [r[i] if i < len(r) else "" for r in rows[1:]]
        full = [v for v in values if v != ""]
        number = re.compile(r"\s*(?:[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[-+]?Infinity|0[xX][0-9a-fA-F]+)?\s*")
        kind = "null" if not full else "number" if all(number.fullmatch(v) for v in full) else "boolean" if all(v in ("true", "false") for v in full) else "string"
        out.append((name, kind, len(full) < len(values) or not full))
    return out


def text_of(kind: str, content: bytes) -> tuple[str | None, str | None]:
    """(text, error) of a file of a known kind."""
    try:
        return _PARSERS[kind](bytes(content)), None
    except Exception as e:  # noqa: BLE001  a file that can't be read becomes an error row
        return None, f"{type(e).__name__}: {e}"


_PARSERS = {
    "text": decoded,
    "html": lambda b: html_text(decoded(b)),
    "rtf": lambda b: rtf_text(decoded(b)),
    "docx": docx_text,
    "pdf": pdf_text,
    "epub": lambda b: "\n\n".join(t for _, t in chapters(b)),
    "xlsx": lambda b: "\n\n".join(f"{n}\n{table(r)}" for n, r in sheets(b)),
    "pptx": lambda b: "\n\n".join("\n".join(filter(None, (s["title"], s["body"], *map(table, s["tables"]), s["notes"]))) for s in slides(b)),
    "odt": lambda b: open_document(b, "odt"),
    "ods": lambda b: open_document(b, "ods"),
    "odp": lambda b: open_document(b, "odp"),
    "visio": visio_text,
    "mindmap": outline,
    "latex": lambda b: latex_text(decoded(b)),
    "email": lambda b: email_text(decoded(b)),
    "feed": lambda b: "\n\n".join(f"{t}\n{x}".strip() for t, _, x in feed_entries(b)),
    "srt": lambda b: " ".join(captions(decoded(b))),
    "vtt": lambda b: " ".join(captions(decoded(b))),
    "json": lambda b: json_table(decoded(b)),
    "ndjson": lambda b: json_table(decoded(b), lines=True),
    "csv": lambda b: csv_table(decoded(b)),
}
