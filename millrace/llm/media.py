"""Media columns in a store of content-defined chunks.

Method. A payload becomes the samples of a WAV file (8-bit unsigned PCM, one channel). Its data is
cut where a rolling gear hash of the last 32 bytes ends in zero bits, so equal passages give equal
chunks wherever they stand. Workers append chunks, in compressed frames, to pack files in the
shared folder and return recipes: the file's header, the digests of payload and file, and the
ordered digests and sizes of its chunks. A task names each digest's place once; Spark joins these
names with one place per digest over all tasks (the first), and the recipes with the names of their
own task, so that a chunk that a third of all rows share is spread over all tasks. That makes the
store address each chunk once. Reading fetches the chunks of a list in order, puts them behind the
stored header and verifies both digests.

Packs are written under names that no other attempt uses, and only places that a committed list
names are read, so lost executors and repeated tasks leave at worst an unused file.

Defined cases: null text is empty; an empty payload is one unit of fill; rows are kept one by one,
so repeated rows stay, and equal texts get equal values; a very long text is one payload of many
chunks, held whole by the task that cuts or reads it (4 GiB at most, as WAV has 32-bit sizes); a
null id is carried on; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import id_type, releasing, shared_path, slices, stored, text_bytes
from millrace.llm.files import opened

#: Fill byte and unit of payloads, and the sample rate that the WAV header names.
FILL, UNIT, RATE = 255, 576, 8000
#: Chunk sizes in bytes (least, most) and the hash bits that are zero at a cut.
LEAST, MOST, MASK = 512, 8192, (1 << 11) - 1 << 21
#: Bytes of chunks in a compressed frame of a pack.
FRAME = 128 << 10
#: Bytes of payloads that a task reads back, about.
READ_BYTES = 64 << 20
#: One pseudorandom number a byte value.
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


def payload_of(body: bytes, fill: int = FILL, unit: int = UNIT) -> bytes:
    """``body`` filled up to a positive multiple of ``unit``."""
    return body + bytes([fill]) * ((-len(body)) % unit or (0 if body else unit))


def wav_header(n: int) -> bytes:
    """Header of a WAV file with ``n`` samples of 8 bits."""
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n)


def gear_hashes(data: bytes) -> np.ndarray:
    """The gear hash h[i] = 2 * h[i-1] + GEAR[data[i]] (mod 2^32) at every byte, by doubling windows."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8, 16):
        if len(h) <= width:
            break
        older = h[:-width] << np.uint32(width)
        h = h.copy() if width == 1 else h
        h[width:] += older
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``; the last is its length."""
    n, ends, at = len(data), [], 0
    found = np.flatnonzero((gear_hashes(data) & np.uint32(MASK)) == 0) + 1
    while n - at > LEAST:
        k = np.searchsorted(found, at + LEAST)
        end = int(found[k]) if k < len(found) else n
        at = min(end, at + MOST, n)
        ends.append(at)
    if at < n or not ends:
        ends.append(n)
    return ends


class _Pack:
    """A pack file that a task writes: frames of [length, zstd data]."""

    def __init__(self, folder: str):
        import zstandard

        self.name = uuid.uuid4().hex
        self._store, path = opened(f"{folder}/{self.name}.pack")
        self._file = self._store.open_output_stream(path)
        self._press = zstandard.ZstdCompressor(level=3)
        self._at, self._held, self._size = 0, [], 0

    def add(self, chunk: bytes) -> tuple[str, int, int]:
        """Where the chunk is: pack, start of the frame, start within the frame's data."""
        if self._size + len(chunk) > FRAME:
            self.flush()
        place = (self.name, self._at, self._size)
        self._held.append(chunk)
        self._size += len(chunk)
        return place

    def flush(self) -> None:
        if self._held:
            data = self._press.compress(b"".join(self._held))
            self._file.write(struct.pack("<I", len(data)) + data)
            self._at += 4 + len(data)
            self._held, self._size = [], 0

    def close(self) -> None:
        self.flush()
        self._file.close()


class _Reader:
    """Frames of packs, the latest of which stay in memory."""

    def __init__(self, folder: str, frames: int = 128, files: int = 32):
        import zstandard

        self._folder, self._press = folder, zstandard.ZstdDecompressor()
        self._frames: OrderedDict[tuple[str, int], bytes] = OrderedDict()
        self._files: OrderedDict[str, pa.NativeFile] = OrderedDict()
        self._most = frames, files

    def frame(self, pack: str, at: int) -> bytes:
        key = (pack, at)
        if key in self._frames:
            self._frames.move_to_end(key)
            return self._frames[key]
        if pack not in self._files:
            store, path = opened(f"{self._folder}/{pack}.pack")
            self._files[pack] = store.open_input_file(path)
            if len(self._files) > self._most[1]:
                self._files.popitem(last=False)[1].close()
        file = self._files[pack]
        self._files.move_to_end(pack)
        (size,) = struct.unpack("<I", file.read_at(4, at))
        self._frames[key] = data = self._press.decompress(file.read_at(size, at + 4))
        if len(self._frames) > self._most[0]:
            self._frames.popitem(last=False)
        return data

    def close(self) -> None:
        for file in self._files.values():
            file.close()


PLACE = "struct<pack: string, frame: bigint, start: int>"


def write_media(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks every payload into packs under ``folder`` and returns the recipes.

    Columns: rid (a number of the row, in the order of the packs), part (its task), doc, n_bytes,
    header, payload_sha and media_sha, digests and sizes of the chunks in order, and the places of
    those that this row wrote.
    """
    rows = docs.select(F.col(id_col).alias("doc"), text_bytes(F.col(text_col).cast("string")).alias("body"))
    schema = f"rid bigint, part int, doc {id_type(rows, 'doc')}, n_bytes bigint, header binary, payload_sha binary, media_sha binary, digests array<binary>, sizes array<int>, new array<struct<digest: binary, place: {PLACE}>>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rid, pack, seen = part << 33, None, set()
        place_type = pa.struct([("pack", pa.string()), ("frame", pa.int64()), ("start", pa.int32())])
        new_type = pa.list_(pa.struct([("digest", pa.binary()), ("place", place_type)]))
        try:
            for batch in slices(batches, "body"):
                pack = pack or _Pack(folder)
                n_bytes, heads, shas, wholes, digests, sizes, new = [], [], [], [], [], [], []
                for body in batch.column(1).to_pylist():
                    data, at, own, lengths, written = payload_of(body), 0, [], [], []
                    for end in cuts(data):
                        chunk = data[at:end]
                        digest = hashlib.blake2b(chunk, digest_size=16).digest()
                        if digest not in seen:
                            seen.add(digest)
                            name, frame, start = pack.add(chunk)
                            written.append({"digest": digest, "place": {"pack": name, "frame": frame, "start": start}})
                        own.append(digest)
                        lengths.append(end - at)
                        at = end
                    n_bytes.append(len(body))
                    heads.append(wav_header(len(data)))
                    shas.append(hashlib.sha256(data).digest())
                    wholes.append(hashlib.sha256(heads[-1] + data).digest())
                    digests.append(own)
                    sizes.append(lengths)
                    new.append(written)
                ids = pa.array(np.arange(rid, rid + batch.num_rows))
                rid += batch.num_rows
                binary = lambda values: pa.array(values, pa.binary())
                arrays = [ids, pa.array([part] * batch.num_rows, pa.int32()), batch.column(0), pa.array(n_bytes, pa.int64()), binary(heads), binary(shas), binary(wholes), pa.array(digests, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int32())), pa.array(new, new_type)]
                yield pa.RecordBatch.from_arrays(arrays, names=["rid", "part", "doc", "n_bytes", "header", "payload_sha", "media_sha", "digests", "sizes", "new"])
        finally:
            if pack is not None:
                pack.close()

    return stored(rows.mapInArrow(releasing(work), schema), "media-recipes")


#: What a recipe has besides its chunks.
STORED = ("rid", "doc", "n_bytes", "header", "payload_sha", "media_sha")


def chunk_lists(recipes: DataFrame) -> DataFrame:
    """Recipes with one place for each digest: the columns of ``STORED`` and chunks (place, size) in order.

    A task has a digest's place at most once, so the rows of one digest are at most as many as the
    tasks, and the rows of one (part, digest) at most those of a task.
    """
    named = recipes.select("part", F.explode("new").alias("n")).groupBy("part", "n.digest").agg(F.min("n.place").alias("own"))
    first = named.groupBy("digest").agg(F.min("own").alias("place"))
    places = named.select("part", "digest").join(first, "digest")
    parts = recipes.select("rid", "part", F.posexplode(F.arrays_zip("digests", "sizes")).alias("seq", "c")).select("rid", "part", "seq", F.col("c.digests").alias("digest"), F.col("c.sizes").alias("size"))
    placed = parts.join(places, ["part", "digest"]).select("rid", F.struct("seq", "place", "size").alias("chunk"))
    lists = placed.groupBy("rid").agg(F.array_sort(F.collect_list("chunk")).alias("chunks"))
    return recipes.select(*STORED).join(lists, "rid")


def read_media(recipes: DataFrame, folder: str, *, id_col: str = "doc_id", with_media: bool = False) -> DataFrame:
    """Rebuilds and verifies each file of the recipes; returns what is computed from the bytes read.

    Columns: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature (mean level, root mean square and a histogram of 16 levels), and with ``with_media``
    the file itself. A file or payload that does not match its digest raises an error. Readers get
    rows by their places in the packs, about READ_BYTES each.
    """
    lists = chunk_lists(recipes)
    schema = f"`{id_col}` {id_type(lists, 'doc')}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string" + ", media binary" * with_media
    sized = recipes.agg(F.coalesce(F.sum(F.col("n_bytes") + UNIT), F.lit(0)).alias("n")).first()["n"]
    readers = max(lists.sparkSession.sparkContext.defaultParallelism, -(-sized // READ_BYTES))
    ordered = lists.repartitionByRange(readers, "rid").sortWithinPartitions("rid").select("doc", "n_bytes", "header", "payload_sha", "media_sha", F.col("chunks.place.pack").alias("packs"), F.col("chunks.place.frame").alias("frames"), F.col("chunks.place.start").alias("starts"), F.col("chunks.size").alias("sizes"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(folder)
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    yield rebuilt(batch.slice(at, 1000), reader)
        finally:
            reader.close()

    def rebuilt(batch: pa.RecordBatch, reader: _Reader) -> pa.RecordBatch:
        out: list[tuple] = []
        for header, sha, whole, *chunks in zip(*(batch.column(i).to_pylist() for i in range(2, 9)), strict=True):
            data = b"".join([reader.frame(p, f)[s : s + n] for p, f, s, n in zip(*chunks, strict=True)])
            digest = hashlib.sha256(data)
            media = header + data
            stored_sha = hashlib.sha256(media)
            if digest.digest() != sha or stored_sha.digest() != whole:
                raise ValueError("a media file read back differs from its digest")
            samples = np.frombuffer(media, np.uint8, offset=len(header))
            counts = np.bincount(samples, minlength=256)
            levels = np.arange(256)
            mean, power = counts @ levels / len(data), counts @ (levels - 128) ** 2 / len(data)
            feature = f"mean={mean:.3f};rms={power**0.5:.3f};hist=" + ",".join(map(str, counts.reshape(16, 16).sum(axis=1).tolist()))
            row = (len(data), digest.hexdigest(), zlib.crc32(data[-32:]), len(media), stored_sha.hexdigest(), feature)
            out.append((*row, media) if with_media else row)
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * with_media
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media"] * with_media
        arrays = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=[id_col, "n_bytes", *names])

    return ordered.mapInArrow(releasing(work), schema)


def media_columns(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """Stores every whole text as media and reads it back: :func:`write_media` to :func:`read_media`."""
    folder = shared_path(docs.sparkSession, "media")
    store, path = opened(folder)
    store.create_dir(path, recursive=True)
    return read_media(write_media(docs, folder, id_col=id_col, text_col=text_col), folder, id_col=id_col, with_media=with_media)
