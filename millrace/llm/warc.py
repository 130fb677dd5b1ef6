"""A deterministic, sharded WARC writer and its reader.

Method. Records are range-partitioned and sorted by id; each partition is written as files that
roll over at a compressed size. Every record is a gzip member of its own; headers (ids, dates,
lengths, digests) are made from the content alone, so a repeated task writes the same bytes. A
file is written under a temporary name of its attempt, renamed when complete, and listed in a
manifest; only what the manifest lists is read.

Of records with equal payloads of at least ``least_revisit`` bytes, the one with the smallest id
is a response and the others are revisits that refer to it. Digests are grouped without payloads,
and the references reach the writer as extra rows that sort right before their records.

Defined cases: null html is an empty payload; null url writes no target; a null id is written as
no id, sorts first, and refers but is never referred to; of rows that repeat id and payload the
first is the one described above and the others revisit it. A very long payload is one record, held
whole by its task; of equal ids with other urls or payloads the smaller url, then payload, comes
first. Other columns are ignored.

A payload that a third of all pages share is one row a task in the grouping of digests; the join that
gives each of its pages the reference has no payloads and is left to Spark's handling of skewed joins.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import id_type, shared_path, stored, text_bytes
from millrace.llm.files import commit, opened

#: Fixed values of the format.
VERSION, PROFILE = b"WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def _record(kind: str, page: str | None, url: str | None, payload: bytes, digest: str, first: str | None) -> bytes:
    """One record, uncompressed."""
    block = HTTP + payload if kind == "response" else HTTP
    name = lambda x, d: uuid.uuid5(uuid.NAMESPACE_OID, f"{x}/{d}").urn
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{name(page, digest)}>"), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="/:?#[]@!$&'()*+,;=%-._~")))
    if page is not None:
        head.append(("WARC-Page-ID", quote(page, safe="")))
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("WARC-Payload-Length", str(len(payload)))]
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{name(first, digest)}>")]
        if first is not None:
            head.append(("WARC-Refers-To-Page-ID", quote(first, safe="")))
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(record: bytes, level: int) -> bytes:
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    return press.compress(record) + press.flush()


class _Shard:
    """The files of one partition, rolled over by compressed size."""

    def __init__(self, folder: str, part: int, roll_bytes: int, level: int):
        self._store, self._folder = opened(folder)
        self._part, self._roll, self._level, self._n = part, roll_bytes, level, 0
        self._attempt = uuid.uuid4().hex
        self._file = None
        self.done: list[dict] = []

    def add(self, record: bytes) -> None:
        data = _member(record, self._level)
        if self._file is not None and self._size + len(data) > self._roll:
            self.close()
        if self._file is None:
            self._temporary = f"{self._folder}/_temporary/{self._attempt}-{self._n:05d}"
            self._file = self._store.open_output_stream(self._temporary)
            self._size, self._records, self._sha = 0, 0, hashlib.sha256()
        self._file.write(data)
        self._sha.update(data)
        self._size += len(data)
        self._records += 1

    def close(self) -> None:
        if self._file is None:
            return
        self._file.close()
        self._file = None
        name = f"part-{self._part:06d}-{self._n:05d}.warc.gz"
        commit(self._store, self._temporary, f"{self._folder}/{name}")
        self.done.append({"name": name, "bytes": self._size, "records": self._records, "sha256": self._sha.hexdigest()})
        self._n += 1


def write_warc(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_revisit: int = 100, roll_bytes: int = 256 << 20, level: int = 4) -> DataFrame:
    """Writes the archives and returns their manifest: name, bytes, records, sha256 of each file."""
    store, path = opened(folder)
    store.create_dir(f"{path}/_temporary", recursive=True)
    body = text_bytes(F.col(html_col).cast("string"))
    light = stored(pages.select(F.col(id_col).alias("id"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("n")), "warc-digests")
    large = light.where(F.col("n") >= least_revisit)
    # Counts and minima are combined before the shuffle, so a payload of many copies costs a row a task.
    groups = large.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1 AND first IS NOT NULL").drop("copies")
    notes = large.join(groups, "digest").select("id", F.lit(0).alias("kind"), "digest", "first").distinct()
    rows = pages.select(F.col(id_col).alias("id"), F.lit(1).alias("kind"), F.col(url_col).cast("string").alias("url"), body.alias("body"))
    both = notes.unionByName(rows, allowMissingColumns=True).select("id", "kind", F.col("id").cast("string").alias("page"), "digest", F.col("first").cast("string").alias("first"), "url", "body")
    ordered = both.repartitionByRange("id").sortWithinPartitions("id", "kind", "url", "body").select("page", "kind", "digest", "first", "url", "body")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(folder, TaskContext.get().partitionId(), roll_bytes, level)
        page, notes, seen = object(), {}, set()
        for batch in batches:
            for now, kind, digest, first, url, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != page:
                    page, notes, seen = now, {}, set()
                if kind == 0:
                    notes[digest] = first
                    continue
                digest = hashlib.sha256(data).hexdigest()
                known = digest in notes
                revisit = known and (notes[digest] != page or digest in seen)
                if known:
                    seen.add(digest)
                shard.add(_record("revisit" if revisit else "response", page, url, data, digest, notes.get(digest)))
        shard.close()
        yield pa.RecordBatch.from_pylist(shard.done, pa.schema([("name", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha256", pa.string())]))

    return stored(ordered.mapInArrow(work, "name string, bytes bigint, records bigint, sha256 string"), "warc-manifest")


def records(stream: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file of gzip members."""
    pending, out, press = b"", bytearray(), zlib.decompressobj(31)
    while True:
        data = pending or stream.read(1 << 20)
        if not data:
            break
        out += press.decompress(data)
        pending = press.unused_data
        if press.eof:
            head, _, rest = bytes(out).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if lines[0].encode() != VERSION:
                raise ValueError("not a WARC record")
            fields = dict(x.split(": ", 1) for x in lines[1:])
            block = rest[: int(fields["Content-Length"])]
            if len(rest) != len(block) + 4 or f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["WARC-Block-Digest"]:
                raise ValueError("a WARC record differs from its headers")
            yield fields, block
            out, press = bytearray(), zlib.decompressobj(31)
    if out:
        raise ValueError("a WARC file ends within a record")


def read_warc(manifest: DataFrame, folder: str, *, id_type_name: str = "bigint", id_col: str = "page_id", with_payload: bool = False) -> DataFrame:
    """Records of the files that the manifest lists, verified.

    Columns: id, payload_bytes, payload_digest, record_type, refers_to, and with ``with_payload``
    the payload of responses (null for revisits).
    """
    from urllib.parse import unquote

    schema = "page string, payload_bytes bigint, payload_digest string, record_type string, refers string" + ", payload binary" * with_payload

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(folder)
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()] + [pa.binary()] * with_payload
        names = ["page", "payload_bytes", "payload_digest", "record_type", "refers"] + ["payload"] * with_payload

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for name, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, n, held = [], 0, 0
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for fields, block in records(stream):
                        payload = block[len(HTTP) :]
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        if fields["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError("a payload differs from its digest")
                        page, first = (unquote(v) if (v := fields.get(k)) is not None else None for k in ("WARC-Page-ID", "WARC-Refers-To-Page-ID"))
                        row = (page, int(fields["WARC-Payload-Length"]), digest, fields["WARC-Type"], first)
                        rows.append((*row, payload if row[3] == "response" else None) if with_payload else row)
                        n, held = n + 1, held + 200 + len(payload) * with_payload
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if n != expected:
                    raise ValueError(f"{name} has {n} records, its manifest {expected}")
                if rows:
                    yield batch_of(rows)

    # One file a task, by range of names and with a fixed number of tasks, as a file is a small row
    # that would otherwise be coalesced with others; files are bounded in size.
    files = manifest.select("name", "records").repartitionByRange(max(1, manifest.count()), "name")
    found = files.mapInArrow(work, schema)
    extra = [F.col("payload")] if with_payload else []
    return found.select(F.col("page").cast(id_type_name).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers").cast(id_type_name).alias("refers_to"), *extra)


def warc_round_trip(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes all pages and reads them back from the archives."""
    folder = shared_path(pages.sparkSession, "warc")
    manifest = write_warc(pages, folder, id_col=id_col, url_col=url_col, html_col=html_col)
    return read_warc(manifest, folder, id_type_name=id_type(pages, id_col), id_col=id_col)
