"""Line deduplication over range-partitioned hashes.

Method. Every line's key (see :func:`line_keys`) becomes a 128-bit hash. The hashes, with document
and position, are range-partitioned and sorted by hash, document and position, and each partition
is streamed once: a run of equal hashes says in how many documents the line is and which
occurrence is the first. Bounds may fall inside a run but not inside one document's part of it, so
a line that a third of all documents share is spread over as many partitions as it needs. A run
that touches its partition's border leaves a summary (two a partition at most), and these are
added up afterwards. What comes out is a compressed bitmap a document (bit i: keep line i), not
text; :func:`apply_bitmaps` turns bitmaps into text or digests.

Defined cases: null or empty text is one empty line, which stays; keys shorter than ``min_chars``
code points stay; a document is an (id, text) pair, so an exactly repeated row is the same
document and rows that share only an id are different ones; a null id is an id like any other; a very long text is cut into lines by one task,
and its lines are rows like others; ties in the order of occurrences are between equal rows alone.
Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import id_type, releasing, slices, stored, text_bytes

#: Kinds of rows that the streaming pass returns.
DROP, IF_FREQUENT, SUMMARY = 0, 1, 2


def identified(docs: DataFrame, id_col: str, text_col: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc, sig, body): the id, a hash of the text that tells rows with equal ids apart, the bytes."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("sig"), text_bytes(text).alias("body"), *(F.col(c).alias(f"c_{i}") for i, c in enumerate(carried)))


def line_keys(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """A row for each line of at least ``min_chars`` code points: hash (k1, k2), doc, sig, pos.

    A key is the line without ASCII white space at its ends, with A-Z in lower case.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            hashes, rows, places = [], [], []
            for row, body in enumerate(batch.column(2).to_pylist()):
                for pos, line in enumerate(body.lower().split(b"\n")):
                    key = line.strip()
                    if key and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars):
                        hashes.append(hashlib.blake2b(key, digest_size=16).digest())
                        rows.append(row)
                        places.append(pos)
            both = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
            at = pa.array(rows, pa.int32())
            columns = [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), batch.column(0).take(at), batch.column(1).take(at), pa.array(places, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "doc", "sig", "pos"])

    return docs.mapInArrow(releasing(work), f"k1 bigint, k2 bigint, doc {id_type(docs, 'doc')}, sig bigint, pos int")


def _stream(min_docs: int, keep_first: bool):
    """The pass over sorted lines: drops that are certain, drops that depend on other partitions, summaries."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def decide(lines: Iterator[tuple]) -> Iterator[tuple]:
        first = True
        runs = itertools.groupby(lines, lambda r: r[:2])
        run = next(runs, None)
        while run is not None:
            key, members = run
            held, docs, last, head = [], 0, None, None
            for _, _, doc, sig, pos in members:
                if docs == 0 or (doc, sig) != last:
                    docs, last = docs + 1, (doc, sig)
                    if docs == min_docs:
                        yield from ((DROP, *key, *x, 0) for x in held)
                        held = []
                if head is None:
                    head = (doc, sig, pos)
                    if keep_first:
                        continue
                if docs >= min_docs:
                    yield (DROP, *key, doc, sig, pos, 0)
                else:
                    held.append((doc, sig, pos))
            run = next(runs, None)
            if first or run is None:
                yield from ((IF_FREQUENT, *key, *x, 0) for x in held)
                yield (SUMMARY, *key, *head, docs)
            first = False

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = kind or batch.schema.field("doc").type
                yield batch

        found = decide(rows(seen()))
        while part := list(itertools.islice(found, 20_000)):
            types = [pa.int32(), pa.int64(), pa.int64(), kind, pa.int64(), pa.int32(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["kind", "k1", "k2", "doc", "sig", "pos", "n"])

    return work


def line_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """Which lines of which documents stay: (doc, sig, keep), for documents that lose any.

    A line goes if its key is in at least ``min_docs`` documents; with ``keep_first`` its first
    occurrence, by document and position, stays. ``keep`` is a zlib-compressed bitmap of packed
    bits, most significant first; lines beyond its end stay.
    """
    lines = stored(line_keys(identified(docs, id_col, text_col), min_chars), "lines")
    ordered = lines.repartitionByRange("k1", "k2", "doc", "sig").sortWithinPartitions("k1", "k2", "doc", "sig", "pos")
    found = stored(
        ordered.mapInArrow(releasing(_stream(min_docs, keep_first)), f"kind int, k1 bigint, k2 bigint, doc {id_type(lines, 'doc')}, sig bigint, pos int, n bigint"),
        "line-runs",
    )
    place = F.struct("doc", "sig", "pos")
    # Two rows of a few dozen bytes a partition at most: 10 MB for 100,000 partitions.
    summaries = found.where(F.col("kind") == SUMMARY)
    frequent = F.broadcast(summaries.groupBy("k1", "k2").agg(F.sum("n").alias("docs"), F.min(place).alias("head")).where(F.col("docs") >= min_docs).drop("docs"))
    drops = found.where(F.col("kind") == DROP).select("doc", "sig", "pos")
    later = found.where(F.col("kind") == IF_FREQUENT).join(frequent, ["k1", "k2"], "left_semi").select("doc", "sig", "pos")
    drops = drops.unionByName(later)
    if keep_first:
        others = summaries.join(frequent, ["k1", "k2"]).where(place > F.col("head")).select("doc", "sig", "pos")
        drops = drops.unionByName(others)
    grouped = drops.groupBy("doc", "sig").agg(F.collect_set("pos").alias("gone"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for gone in batch.column(2).to_pylist():
                bits = np.ones((max(gone) // 8 + 1) * 8, dtype=bool)
                bits[gone] = False
                maps.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], names=["doc", "sig", "keep"])

    return grouped.mapInArrow(releasing(pack), f"doc {id_type(lines, 'doc')}, sig bigint, keep binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """A row per document: id, n_lines (before), n_dropped, kept_sha256, with ``with_text`` kept_text, and ``carried`` columns.

    The lines that stay are joined by a line feed; a document that loses all of them is empty.
    """
    left = identified(docs, id_col, text_col, carried).alias("l")
    right = bitmaps.hint("shuffle_hash").alias("r")
    joined = left.join(right, F.col("l.doc").eqNullSafe(F.col("r.doc")) & (F.col("l.sig") == F.col("r.sig")), "left").select("l.doc", "l.body", "r.keep", *(f"l.c_{i}" for i in range(len(carried))))
    schema = f"`{id_col}` {id_type(left, 'doc')}, n_lines bigint, n_dropped bigint, kept_sha256 string" + ", kept_text string" * with_text + "".join(f", `{c}` {id_type(left, f'c_{i}')}" for i, c in enumerate(carried))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "body"):
            n, gone, digests, texts = [], [], [], []
            for body, keep in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                total, lost = body.count(b"\n") + 1, 0
                if keep is not None:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[:total].astype(bool).tolist()
                    lost = len(bits) - sum(bits)
                    body = b"\n".join(itertools.compress(body.split(b"\n"), itertools.chain(bits, itertools.repeat(True))))
                n.append(total)
                gone.append(lost)
                digests.append(hashlib.sha256(body).hexdigest())
                if with_text:
                    texts.append(body.decode("utf-8", "replace"))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())]
            names = [id_col, "n_lines", "n_dropped", "kept_sha256"]
            if with_text:
                columns.append(pa.array(texts, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[3:]], names=[*names, *carried])

    return joined.mapInArrow(releasing(work), schema)


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, with_text: bool = False) -> DataFrame:
    """:func:`line_bitmaps` and :func:`apply_bitmaps` in one."""
    bitmaps = line_bitmaps(docs, id_col=id_col, text_col=text_col, min_docs=min_docs, min_chars=min_chars, keep_first=keep_first)
    return apply_bitmaps(docs, bitmaps, id_col=id_col, text_col=text_col, with_text=with_text)
