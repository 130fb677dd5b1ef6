"""BPE encoding and decoding by dynamic programming over prefixes.

Method. A prefix of a word has exactly one BPE encoding, so it has exactly one last token. An
automaton over the vocabulary lists the tokens that end at each position; the last token of the
prefix is the one whose predecessor (the last token of the prefix before it) forms a compatible
pair with it, meaning that BPE would not have merged across their border. Last tokens and
back-pointers are kept for every prefix, and following them from the end emits the ids. Work is
linear in the word's length, also for words of many thousand letters.

Words repeat, so encodings of white-space-separated pieces are kept in two generations of a
dictionary of bounded size per worker. They only save time and never change a result.

Defined cases: null text counts as empty (0 tokens, digests of nothing); rows are mapped one by
one, so repeated ids and rows stay; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import id_type, releasing, slices

#: Fixed values of the vocabulary's format: the mark of a word's last symbol, and the pieces
#: that its pre-tokenizer takes.
WORD_END = "</w>"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Controls that Python counts as white space and the vocabulary's normalizer does not.
ODD_SPACES = "\x1c\x1d\x1e\x1f"
#: White space of Unicode, on which the normalizer works.
SPACES = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: All of these are assigned in every version of Unicode in use.
SETTLED = frozenset(map(chr, range(0x250)))
#: Symbols that end a word are shifted by this, out of the way of those that do not.
SHIFT = 0x1000


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return [table[b] for b in range(256)]


class PrefixBpe:
    """Encoder and decoder of a BPE vocabulary with word ends, as in a ``tokenizers`` file."""

    def __init__(self, path: str, kept: int = 300_000):
        import ahocorasick

        self._path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        size = 1 + max(names)
        self.names = [names.get(i, "") for i in range(size)]
        self.rank, self.left, self.right = [-1] * size, [0] * size, [0] * size
        self.pair: dict[int, int] = {}
        symbols: dict[int, str] = {}
        for r, (a, b) in enumerate(spec["model"]["merges"]):
            x, y, t = vocab[a], vocab[b], vocab[a + b]
            self.rank[t], self.left[t], self.right[t] = r, x, y
            self.pair[x << 16 | y] = r
        sound = [True] * size
        for t in sorted((i for i in vocab.values()), key=self.rank.__getitem__):
            if self.rank[t] < 0:
                name = self.names[t]
                symbols[t] = name if len(name) == 1 else chr(ord(name.removesuffix(WORD_END)) + SHIFT)
            else:
                x, y = self.left[t], self.right[t]
                symbols[t] = symbols[x] + symbols[y]
                sound[t] = sound[x] and sound[y] and self._apart(x, y, self.rank[t])
        automaton = ahocorasick.Automaton()
        for t, s in symbols.items():
            if sound[t]:
                automaton.add_word(s, (len(s), t))
        automaton.make_automaton()
        self._matches = automaton.iter
        self._symbol = {b: s for b, s in enumerate(byte_symbols()) if s != chr(b)}
        self._pairs: dict[int, bool] = {}
        self._words: dict[str, bytes] = {}
        self._pieces = regex.compile(PIECES)
        self._marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._mark = min((m[:2] for m in self.special), default=None)
        self._kept = kept
        self._ids = _Chunks(self, {})

    def _apart(self, u: int, t: int, limit: int = 1 << 30) -> bool:
        """Whether BPE, by merges ranked below ``limit``, never merges across the border of u and t.

        It undoes the merges inside u and t from the last to the first. While two pieces touch the
        border, a merge of just these two would have happened if it ranks before the merge that
        took one of them away; of equal ranks the left one comes first.
        """
        rank, pair = self.rank, self.pair
        while True:
            m = pair.get(u << 16 | t)
            if m is not None and m < limit:
                return False
            if rank[u] > rank[t]:
                limit, u = rank[u], self.right[u]
            elif rank[t] >= 0:
                limit, t = rank[t] + 1, self.left[t]
            else:
                return True

    def word(self, symbols: str) -> list[int]:
        """Ids of one word, given as symbols of which the last is shifted."""
        n = len(symbols)
        last, back, done, pairs = [0] * (n + 1), [0] * (n + 1), -1, self._pairs
        for e, (size, t) in self._matches(symbols):
            if e == done:
                continue
            i = e + 1 - size
            if i:
                key = last[i] << 16 | t
                fits = pairs.get(key)
                if fits is None:
                    fits = pairs[key] = self._apart(last[i], t)
                if not fits:
                    continue
            last[e + 1], back[e + 1], done = t, i, e
        ids = []
        while n:
            ids.append(last[n])
            n = back[n]
        return ids[::-1]

    def _parts(self, raw: str) -> list[str]:
        """The words of text without white space, as symbols."""
        if raw.isascii():
            s = raw.lower()
            if s.isalpha():
                return [s]
            if s.isprintable():
                return self._pieces.findall(s)
        s = unicodedata.normalize("NFC", raw)
        if not SETTLED.issuperset(s):
            if any(unicodedata.category(c) == "Cn" for c in s):
                return self._by_library(raw)
            s = s.replace("Σ", "σ")  # Python alone would look at what follows it
        return [p.encode().decode("latin-1").translate(self._symbol) for p in self._pieces.findall(s.lower())]

    def _by_library(self, raw: str) -> list[str]:
        """As _parts, for characters on which versions of Unicode differ: as the library has them."""
        from tokenizers import Tokenizer

        self._library = self._library or Tokenizer.from_file(self._path)
        s = self._library.normalizer.normalize_str(raw)
        return [p for p, _ in self._library.pre_tokenizer.pre_tokenize_str(s)]

    def chunk(self, raw: str) -> bytes:
        """Ids, little-endian, of text without white space."""
        found = []
        for s in self._parts(raw):
            ids = self._words.get(s)
            if ids is None:
                ids = array("I", self.word(s[:-1] + chr(ord(s[-1]) + SHIFT))).tobytes()
                if len(s) <= 60:
                    self._words[s] = ids
            found.append(ids)
        return found[0] if len(found) == 1 else b"".join(found)

    def _plain(self, text: str) -> bytes:
        odd = any(c in text for c in ODD_SPACES)
        chunks = [c for c in SPACES.split(text) if c] if odd else text.split()
        return b"".join(map(self._ids.__getitem__, chunks))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self._ids) > self._kept:
            self._ids = _Chunks(self, dict(self._ids))
        for kept in (self._pairs, self._words):
            if len(kept) > self._kept:
                kept.clear()
        if self._mark is None or self._mark not in text:
            return self._plain(text)
        parts = self._marks.split(text)
        return b"".join(array("I", [self.special[p]]).tobytes() if p in self.special else self._plain(p) for p in parts if p)

    def decode(self, ids: bytes) -> str:
        """Names of the tokens, joined by a space: the file names no decoder."""
        return " ".join(map(self.names.__getitem__, memoryview(ids).cast("I")))


class _Chunks(dict):
    """Encodings by piece of raw text, computed when first asked for; ``older`` is the generation before."""

    def __init__(self, of: PrefixBpe, older: dict[str, bytes]):
        self._of, self._older = of, older

    def __missing__(self, raw: str) -> bytes:
        ids = self._older.get(raw)
        if ids is None:
            ids = self._of.chunk(raw)
        if len(raw) <= 60:
            self[raw] = ids
        return ids


_LOADED: dict[tuple[str, int], PrefixBpe] = {}


def loaded(path: str, kept: int) -> PrefixBpe:
    """The vocabulary, built once in a worker process and used by all of its tasks."""
    key = (path, kept)
    if key not in _LOADED:
        _LOADED[key] = PrefixBpe(path, kept)
    return _LOADED[key]


def encode_decode(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", with_tokens: bool = False, kept: int = 300_000) -> DataFrame:
    """Encodes whole texts and decodes the ids again.

    Returns the id, n_tokens, and SHA-256 digests of the ids and of the decoded text;
    ``with_tokens`` adds the ids (array of int) and the decoded text themselves. ``kept`` bounds each
    of a worker's dictionaries of encodings, which only save time.
    """
    schema = f"`{id_col}` {id_type(docs, id_col)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if with_tokens:
        schema += ", ids array<int>, decoded string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer_path, kept)
        sha = hashlib.sha256
        for batch in slices(batches, text_col, 4 << 20):
            n, ids_sha, text_sha, ids, texts = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                found = bpe.encode(text or "")
                decoded = bpe.decode(found)
                n.append(len(found) // 4)
                ids_sha.append(sha(found).hexdigest())
                text_sha.append(sha(decoded.encode()).hexdigest())
                if with_tokens:
                    ids.append(memoryview(found).cast("i").tolist())
                    texts.append(decoded)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_tokens:
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(releasing(work), schema)
