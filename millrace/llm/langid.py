"""Language identification by rank-order profiles.

Method. A profile is the list of the most frequent n-grams of letters (1 to 3, with word borders),
in order of frequency. Each language's profile comes from the counts of all documents to learn
from; a document's profile from its whole text. The out-of-place distance of a document to a
language adds up, over the document's n-grams, how far the ranks are apart, and the profile's
length for those that the language's profile lacks; the least distance wins.

Text is lower-cased; letters are what Unicode calls letters, and any run of other characters is a
word border. N-grams are counted in numpy, as integers that hold up to three code points, for many
documents at once. Ties of counts go by code points, ties of distances to the smaller language
name, so results don't depend on partitions.

Defined cases: null text and text without a letter is ``und`` with score 0, as is everything if
there is nothing to learn from; a null language is not learned from; a null id counts as an empty
one where ids split the data; repeated rows are learned from and predicted one by one; very long
texts are counted whole, one at a time; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import id_type, releasing, slices, stored

#: What stands for a word border in an n-gram, and the bits of a code point.
BORDER, BITS = 1, 21
UNDETERMINED = "und"
#: Bytes of text that are counted at once.
SLICE = 1 << 18


@cache
def letters() -> np.ndarray:
    """The code point itself for letters, BORDER for all else."""
    table = np.full(0x110000, BORDER, np.uint32)
    found = [c for c in range(0x110000) if chr(c).isalpha()]
    table[found] = found
    return table


class Grams:
    """The n-grams of some texts: ``doc`` (index of the text) and ``code`` of each occurrence.

    Codes are dense: digits of ``width`` bits, from the border and the letters that occur, in
    order of code points; 0 where an n-gram is shorter than three. So they sort as n-grams do.
    """

    def __init__(self, texts: list[str]):
        low = [t.lower() for t in texts]
        raw = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        doc = np.repeat(np.arange(len(low), dtype=np.int64), [len(t) + 1 for t in low])
        doc = np.concatenate((doc[:1], doc)) if len(doc) else np.zeros(1, np.int64)
        chars = letters()[raw]
        keep = np.ones(len(chars), bool)
        keep[1:] = (chars[1:] != BORDER) | (chars[:-1] != BORDER)
        chars, doc = chars[keep], doc[: len(keep)][keep]
        self.alphabet = np.unique(chars)
        digit = np.searchsorted(self.alphabet, chars).astype(np.int64) + 1
        self.width = int(len(self.alphabet)).bit_length()
        w, letter = self.width, chars != BORDER
        two = np.flatnonzero(letter[1:] | letter[:-1]) + 1
        three = np.flatnonzero(letter[1:-1]) + 2
        self.code = np.concatenate((digit[letter], digit[two - 1] << w | digit[two], (digit[three - 2] << w | digit[three - 1]) << w | digit[three]))
        self.doc = np.concatenate((doc[letter], np.where(letter[two], doc[two], doc[two - 1]), doc[three - 1]))

    def points(self, code: np.ndarray) -> np.ndarray:
        """Dense codes as codes of whole code points, which mean the same in every batch."""
        mask, out = (1 << self.width) - 1, np.zeros(len(code), np.int64)
        table = np.concatenate(([0], self.alphabet.astype(np.int64)))
        for k in (2, 1, 0):
            out = out << BITS | table[code >> (k * self.width) & mask]
        return out


def counted(group: np.ndarray, code: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, code) in order, and how often each occurs; codes have ``bits`` bits."""
    if int(group.max(initial=0)).bit_length() + bits < 63:
        key = np.sort(group << bits | code)
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        found = key[first]
        return found >> bits, found & ((1 << bits) - 1), np.diff(np.append(first, len(key)))
    order = np.lexsort((code, group))
    group, code = group[order], code[order]
    first = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (code[1:] != code[:-1]))))
    return group[first], code[first], np.diff(np.append(first, len(code)))


def language_profiles(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", length: int = 300) -> DataFrame:
    """(lang, gram, rank): the ``length`` most frequent n-grams of every language, over all ``docs``."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                code, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(code), np.int32))), pa.array(code), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        for batch in slices(batches, "text", SLICE):
            langs = batch.column(0).to_pylist()
            names = sorted(set(langs))
            grams = Grams(batch.column(1).to_pylist())
            number = np.array([names.index(x) for x in langs], np.int64)
            group, code, n = counted(number[grams.doc], grams.code, 3 * grams.width)
            points = grams.points(code)
            for k, lang in enumerate(names):
                own = group == k
                held.setdefault(lang, []).append((points[own], n[own]))
            size += len(code)
            if size > 1_000_000:
                yield from flush()
                size = 0
        yield from flush()

    counts = rows.mapInArrow(releasing(work), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", rank - 1).where(F.col("rank") < length).select("lang", "gram", "rank")


def predict(docs: DataFrame, profiles: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 300, carried: tuple[str, ...] = ()) -> DataFrame:
    """(id, lang_pred, score) of every row, and the columns ``carried``.

    The score is 1 less the distance to the language as a share of the greatest possible one.
    ``profiles`` is gathered: ``length`` rows a language.
    """
    table: dict[str, list[tuple[int, int]]] = {}
    for row in profiles.collect():
        table.setdefault(row["lang"], []).append((row["gram"], row["rank"]))
    names = sorted(table)
    known = [np.array(sorted(table[x]), np.int64) for x in names]
    # The text itself is carried by the column that is judged, so that no batch holds it twice.
    others = [c for c in carried if c != text_col or id_type(docs, c) != "string"]
    place = {c: 2 + i for i, c in enumerate(others)}
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"), *(F.col(c).alias(f"c_{i}") for i, c in enumerate(others)))
    schema = f"`{id_col}` {id_type(rows, 'id')}, lang_pred string, score double" + "".join(f", `{c}` {id_type(docs, c)}" for c in carried)

    def judged(texts: list[str]) -> tuple[list[str], list[float]]:
        grams = Grams(texts)
        bits = 3 * grams.width
        doc, code, n = counted(grams.doc, grams.code, bits)
        most = int(n.max(initial=0))
        place, count_bits = most - n, most.bit_length()
        if len(texts).bit_length() + count_bits + bits < 63:
            key = np.sort((doc << count_bits | place) << bits | code)
            doc, code = key >> (bits + count_bits), key & ((1 << bits) - 1)
        else:
            order = np.lexsort((code, place, doc))
            doc, code = doc[order], code[order]
        start = np.searchsorted(doc, np.arange(len(texts)))
        rank = np.arange(len(doc)) - start[doc]
        kept = rank < length
        doc, code, rank = doc[kept], code[kept], rank[kept]
        distinct, at = np.unique(code, return_inverse=True)
        points = grams.points(distinct)
        size = np.bincount(doc, minlength=len(texts))
        best, pred = np.full(len(texts), np.inf), np.full(len(texts), -1)
        for k, profile in enumerate(known):
            i = np.minimum(np.searchsorted(profile[:, 0], points), len(profile) - 1)
            place = np.where(profile[i, 0] == points, profile[i, 1], -1)[at]
            out = np.where(place >= 0, np.abs(rank - place), length)
            distance = np.bincount(doc, out, minlength=len(texts))
            better = distance < best
            best[better], pred[better] = distance[better], k
        sure = (size > 0) & (pred >= 0)
        score = np.where(sure, 1 - best / (length * np.maximum(size, 1)), 0.0)
        return [names[p] if s else UNDETERMINED for p, s in zip(pred, sure, strict=True)], score.tolist()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            pred, score = judged([t or "" for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(pred), pa.array(score, pa.float64()), *(batch.column(place.get(c, 0)) for c in carried)], names=[id_col, "lang_pred", "score", *carried])

    return rows.mapInArrow(releasing(work), schema)


def fold(id_col: str = "doc_id", folds: int = 3) -> Column:
    """CRC-32 of the id as text, modulo ``folds``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", length: int = 300, carried: tuple[str, ...] = ()) -> DataFrame:
    """Learns from the rows whose :func:`fold` is not 1 and predicts all."""
    profiles = language_profiles(docs.where(fold(id_col) != 1), text_col=text_col, lang_col=lang_col, length=length)
    return predict(docs, profiles, id_col=id_col, text_col=text_col, length=length, carried=carried)


def told(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", length: int = 300) -> DataFrame:
    """The rows of ``docs`` whose language can be told: their score is at least the bound of the learned rows.

    The bound is half of what 99 of 100 learned rows reach, of those whose language is predicted
    as given, so short and odd texts of a known language stay. Scores are rounded to four digits
    for it, so that the exact percentile takes a bounded table. Where there is nothing to learn
    from, rows with a letter stay.
    """
    learned = docs.where(fold(id_col) != 1)
    profiles = stored(language_profiles(learned, text_col=text_col, lang_col=lang_col, length=length), "language-profiles")
    if profiles.isEmpty():
        return docs.where(F.rlike(F.col(text_col).cast("string"), F.lit(r"\p{L}")))
    right = predict(learned, profiles, id_col=id_col, text_col=text_col, length=length, carried=(lang_col,)).where(F.col("lang_pred") == F.col(lang_col))
    bound = (right.agg(F.percentile(F.round("score", 4), 0.01)).first()[0] or 0.0) / 2
    others = tuple(c for c in docs.columns if c != id_col)
    found = predict(docs, profiles, id_col=id_col, text_col=text_col, length=length, carried=others)
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= bound)).select(*docs.columns)
