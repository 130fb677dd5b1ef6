"""Jaccard join of documents as sets of word n-grams, size-aware with light and heavy sets.

Method. A document is the set of its distinct n-word shingles; documents with equal sets are one
class from the start. Shingles have a global order, rare ones first. Two sets that overlap enough
share at least k shingles among the first ones of each (as many as may be missing, plus k), so

* light sets enumerate all subsets of two of their first shingles, and meet where a subset is equal;
* heavy sets put each of their first shingles (k = 1) into inverted lists, which are scanned; light
  sets that are large enough to link with a heavy one are in the lists too.

The size at which sets become heavy minimises the cost over the corpus' sizes: rows that subsets
would take against rows and scans that lists would take.

A list is scanned in a stream. Each member is compared with one pivot of about its size, and a
member without such a pivot becomes one, so candidates are linear in the lists even if a third of
all documents are near copies of each other. Parity sketches (how many of 1,024 bits differ is at
most how many shingles differ) rule out most candidates, and the rest is verified exactly from the
whole texts. After the components of these links are known, members of a list that are still in
different components are compared with each other as well, sketches first and within the task, so
that only pairs near enough leave it. That makes the components those of all links; only pairs that
are already connected are left out.

Hashes: shingles 64 bits, sets 128 bits. Which shingles count as frequent only affects the order,
never the result.

Defined cases: null or empty text and text without words has the empty set, which links with
nothing; fewer than n words are one shingle; equal rows are in one class; null ids belong to the
component of their text, and are its id only if it has no other; a very long text is one set, held
whole by the task that reads it; ties (rows of one id) are told apart by their texts; other columns
are ignored.

Limits. Inside lists a set goes by the first 64 bits of its hash; two sets whose names collide would
have to be in one list to hide a link, which is far less likely than a collision of 64 bits. Lists of
many sets that look alike but stay below the threshold cost a comparison of sketches a pair, in blocks
of a bounded size that are dealt over all tasks; no pair leaves a task unless its sketches allow a link.
The filter that finds the texts to verify has a fixed size; when more sets are needed than it can tell
apart, up to three further passes over all texts are made, and the result is the same.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WORD, id_type, releasing, slices, stored, text_bytes
from millrace.llm.graph import components

#: Bits of a parity sketch, in words of 64; large sets have a wide one besides.
SKETCH, WIDE, LARGE = 16, 256, 1024
#: Bits of the filter that says whose texts are needed.
FILTER_BITS = 1 << 23
#: A shingle that is this often in one slice of a task's texts is reported; of those, so many are
#: ordered last. Both only affect the order.
OFTEN, FREQUENT = 3, 200_000
#: Members of a list that are compared in one task with as many others.
BLOCK = 1024
#: Pairs that a task remembers, so as to give a pair of many lists once; they only save rows.
GIVEN = 200_000
#: Words whose hashes a worker keeps while a task runs; they only save time.
CACHED = 100_000
#: What scanning costs an entry of an inverted list, in rows of a subset.
SCAN = 8


class _Words(dict):
    """64-bit hashes of words, computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_CACHE = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(bodies: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    if len(_CACHE) > CACHED:
        _CACHE.clear()
    split = [b.lower().split() for b in bodies]
    words = np.fromiter((h for s in split for h in map(_CACHE.__getitem__, s)), np.uint64, sum(map(len, split)))
    rolled = words[: max(0, len(words) - n + 1)]
    for k in range(1, n):
        rolled = _mixed(rolled) + words[k : len(words) - n + 1 + k]
    rolled, out, at = _mixed(rolled), [], 0
    for s in split:
        m = len(s)
        if m >= n:
            h = np.sort(rolled[at : at + m - n + 1])
            out.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
        else:
            x = np.full(1, m, np.uint64)
            for h in words[at : at + m]:
                x = _mixed(x) + h
            out.append(_mixed(x)[: int(m > 0)])
        at += m
    return out


def sketch(shingles: np.ndarray, size: int = SKETCH) -> bytes:
    """Parity of the number of shingles in each of ``size`` * 64 buckets, as packed bits."""
    bucket = (shingles >> np.uint64(20)).astype(np.int64) & (size * 64 - 1)
    return np.packbits(np.bincount(bucket, minlength=size * 64).astype(np.uint8) & 1).tobytes()


@dataclass(frozen=True)
class Threshold:
    """Sets link when ``den`` * intersection >= ``num`` * union."""

    num: int = 85
    den: int = 100

    def overlap(self, a: int, b: int) -> int:
        """The least intersection with which sets of these sizes link."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def spare(self, a: int) -> int:
        """How many of its shingles a set of size ``a`` may lack in one it links with."""
        return a - -(-self.num * a // self.den)

    def fits(self, a: Column, b: Column) -> Column:
        """Whether sizes ``a`` <= ``b`` are near enough to link."""
        return self.den * a >= self.num * b


def boundary(sizes: dict[int, int], limit: Threshold) -> int:
    """The greatest light size: the cheapest cut between subsets and lists for these sizes."""
    order = sorted(sizes)
    light = np.cumsum([0.0, *(sizes[n] * math.comb(limit.spare(n) + 2, 2) for n in order)])
    heavy = np.cumsum([0.0, *((1 + SCAN) * sizes[n] * (limit.spare(n) + 1) for n in order)])
    best, least = 0, math.inf
    for i in range(len(order) + 1):
        x = order[i - 1] if i else 0
        listed = np.searchsorted(order, limit.num * (x + 1) / limit.den)
        cost = light[i] + heavy[-1] - heavy[min(listed, i)]
        if cost < least:
            best, least = x, cost
    return best


class NgramJoin:
    """The join of ``docs`` with itself."""

    def __init__(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 4, limit: Threshold | None = None):
        self.id_col, self.n, self.limit = id_col, n, limit or Threshold()
        self.rows = docs.select(F.col(id_col).alias("doc"), text_bytes(F.col(text_col).cast("string")).alias("body"))
        self.kind = id_type(self.rows, "doc")
        found = stored(self._scan(), "ngram-sets")
        self.sets = found.where("tok IS NULL").select("doc", "node", "size", "sketch", "wide", "sig")
        self._frequent = self._order(found.where("tok IS NOT NULL"))
        classes = self.sets.where("size > 0").groupBy("node").agg(F.min("doc").alias("least"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide"))
        self.classes = stored(classes.withColumn("k", _key("node")), "ngram-classes")
        histogram = self.classes.groupBy("size").count().collect()
        self.light = boundary({r["size"]: r["count"] for r in histogram}, self.limit)

    def _scan(self) -> DataFrame:
        """A row a document (its set's hash, size and sketch), and rows of often-seen shingles."""
        n = self.n

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[bytes] = set()
            kind = None
            for batch in slices(batches, "body"):
                kind = kind or batch.schema.field("doc").type
                sets = shingle_sets(batch.column(1).to_pylist(), n)
                nodes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                fresh = []
                for node, s in zip(nodes, sets, strict=True):
                    if node is not None and node not in seen:
                        seen.add(node)
                        fresh.append(s)
                if len(seen) > 500_000:
                    seen.clear()
                tok, times = np.unique(np.concatenate(fresh), return_counts=True) if fresh else (np.zeros(0, np.uint64),) * 2
                tok, times = tok[times >= OFTEN].view(np.int64), times[times >= OFTEN].astype(np.int32)
                m = len(tok)
                nothing = lambda t, k: pa.nulls(k, t)
                arrays = [
                    pa.concat_arrays([batch.column(0), nothing(kind, m)]),
                    pa.concat_arrays([pa.array(nodes, pa.binary()), nothing(pa.binary(), m)]),
                    pa.concat_arrays([pa.array([len(s) for s in sets], pa.int32()), pa.array(times, pa.int32())]),
                    pa.concat_arrays([pa.array([sketch(s) if len(s) else None for s in sets], pa.binary()), nothing(pa.binary(), m)]),
                    pa.concat_arrays([pa.array([sketch(s, WIDE) if len(s) >= LARGE else None for s in sets], pa.binary()), nothing(pa.binary(), m)]),
                    pa.concat_arrays([nothing(pa.int64(), len(sets)), pa.array(tok, pa.int64())]),
                    pa.concat_arrays([pa.array([hashlib.md5(b).digest() for b in batch.column(1).to_pylist()], pa.binary()), nothing(pa.binary(), m)]),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc", "node", "size", "sketch", "wide", "tok", "sig"])
            _CACHE.clear()

        return self.rows.mapInArrow(releasing(work), f"doc {self.kind}, node binary, size int, sketch binary, wide binary, tok bigint, sig binary")

    def _order(self, often: DataFrame) -> np.ndarray:
        """The most frequent shingles, sorted by hash, with their counts (bounded: FREQUENT rows)."""
        rows = often.groupBy("tok").agg(F.sum("size").alias("n")).orderBy(F.desc("n"), "tok").limit(FREQUENT).collect()
        table = np.array(sorted((r["tok"] & (1 << 64) - 1, r["n"]) for r in rows), np.uint64).reshape(-1, 2)
        return table

    def lists(self) -> DataFrame:
        """(key, k, size): for each key (a shingle, or a subset of two), the sets that have it.

        A task emits a set once; equal sets of other tasks are dropped when lists are scanned.
        """
        n, limit, light = self.n, self.limit, self.light
        shared = self.rows.sparkSession.sparkContext.broadcast(self._frequent)

        def firsts(s: np.ndarray) -> Iterator[np.ndarray]:
            table = shared.value
            m = len(s)
            spare = limit.spare(m)
            if len(table):
                at = np.minimum(np.searchsorted(table[:, 0], s), len(table) - 1)
                count = np.where(table[at, 0] == s, table[at, 1], 0)
                s = s[np.argsort(count, kind="stable")[: spare + 2]]
            if m <= light:
                i, j = np.triu_indices(min(m, spare + 2), 1)
                a, b = np.minimum(s[i], s[j]), np.maximum(s[i], s[j])
                yield _mixed(_mixed(a) + b + np.uint64(1))
            if m > light or limit.den * m >= limit.num * (light + 1):
                yield s[: spare + 1]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[bytes] = set()
            for batch in slices(batches, "body"):
                keys, nodes, sizes, counts = [], [], [], []
                for s in shingle_sets(batch.column(0).to_pylist(), n):
                    # A set so small that it may lack nothing links with equal sets alone, but one
                    # that is part of it may still be larger.
                    if len(s) == 0 or limit.overlap(len(s), len(s) + 1) > len(s):
                        continue
                    node = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    if node in seen:
                        continue
                    seen.add(node)
                    own = np.concatenate(list(firsts(s)))
                    keys.append(own)
                    counts.append(len(own))
                    nodes.append(int.from_bytes(node[:8], "big", signed=True))
                    sizes.append(len(s))
                if len(seen) > 500_000:
                    seen.clear()
                if not keys:
                    continue
                arrays = [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), counts)), pa.array(np.repeat(np.array(sizes, np.int32), counts))]
                for at in range(0, len(arrays[0]), 100_000):
                    yield pa.RecordBatch.from_arrays([a.slice(at, 100_000) for a in arrays], names=["key", "k", "size"])
            _CACHE.clear()

        return self.rows.select("body").mapInArrow(releasing(work), "key bigint, k bigint, size int")

    def _scanned(self) -> DataFrame:
        """The lists with more than one set, and for each member the pivot it is compared with."""
        limit = self.limit
        # Pivots are first in an order by hash, one of four, so that not all lists of a group of
        # near copies have the same.
        order = F.xxhash64("k", F.pmod("key", F.lit(4)))
        rows = self.lists().repartition("key").sortWithinPartitions("key", order, "k")

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state: list = [0, [], False, None]  # the key, its pivots as (k, size), whether there is one, the last set

            def scan(key: np.ndarray, k: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
                keep, pivot = [], []
                now, pivots, begun, before = state
                for i, (x, a, m) in enumerate(zip(key.tolist(), k.tolist(), size.tolist(), strict=True)):
                    if x != now or not begun:
                        now, pivots, begun, before = x, [], True, None
                    if a == before:
                        continue
                    before = a
                    found = None
                    for p, q in pivots:
                        if p == a or limit.den * min(m, q) >= limit.num * max(m, q):
                            found = p
                            break
                    if found is None:
                        pivots.append((a, m))
                    keep.append(i)
                    pivot.append(found)
                state[:] = [now, pivots, begun, before]
                at = np.array(keep, np.int64)
                return pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(k[at]), pa.array(size[at]), pa.array(pivot, pa.int64())], names=["key", "k", "size", "pivot"])

            held = None
            for batch in batches:
                key, k, size = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                if held is not None:
                    key, k, size = (np.concatenate(x) for x in zip(held, (key, k, size), strict=True))
                # Most lists have one set; these go at once. The last row waits for its successor.
                same = np.flatnonzero(key[1:] == key[:-1])
                many = np.zeros(len(key), bool)
                many[same], many[same + 1] = True, True
                many |= (key == state[0]) & state[2]
                held = tuple(x[-1:] for x in (key, k, size))
                many[-1] = False
                if many.any():
                    # A held row that turns out to begin a list is scanned with its batch.
                    yield scan(key[many], k[many], size[many])
                if (state[2] and key[-1] == state[0]) or (len(key) > 1 and key[-1] == key[-2]):
                    yield scan(*held)
                    held = None
            return

        return rows.mapInArrow(releasing(work), "key bigint, k bigint, size int, pivot bigint")

    def _near(self, pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (a, b) of keys of sets, those whose sizes and sketches allow a link."""
        word = lambda c, i: F.conv(F.hex(F.substring(c, 1 + 8 * i, 8)), 16, -10).cast("bigint")
        wide = F.when(F.col("wide").isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(WIDE - 1)), lambda i: F.conv(F.hex(F.substring("wide", 1 + 8 * i, F.lit(8))), 16, -10).cast("bigint")))
        known = self.classes.select("k", "node", "size", F.array(*(word("sketch", i) for i in range(SKETCH))).alias("bits"), wide.alias("wide"))
        side = lambda x: known.select(*(F.col(c).alias(f"{x}_{c}") for c in known.columns))
        both = pairs.join(side("a"), F.col("a") == F.col("a_k")).join(side("b"), F.col("b") == F.col("b_k"))
        total = F.col("a_size") + F.col("b_size")
        overlap = F.ceil(self.limit.num * total / (self.limit.num + self.limit.den))
        apart = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
        differ = F.greatest(apart("a_bits", "b_bits"), apart("a_wide", "b_wide"))
        fits = self.limit.fits(F.least("a_size", "b_size"), F.greatest("a_size", "b_size"))
        return both.where(fits & (differ <= total - 2 * overlap)).select("a_node", "b_node")

    def _across(self, members: DataFrame, nearest: bool) -> DataFrame:
        """Pairs (a, b) of members (key, k, size, root, n of the list) in different components that size and sketch allow.

        With ``nearest`` only the pair with the nearest sketches for each component of a list.

        Only these pairs leave a task, and a pair that is in several of its lists leaves it once, but
        for tasks with more than GIVEN pairs. A list is dealt out in blocks of about BLOCK members, and
        each pair of blocks is compared by itself, so that no task holds more than two.
        """
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        rows = members.join(self.classes.select("k", "sketch"), "k").select("key", "k", "size", "root", "sketch", blocks.alias("blocks"), F.pmod(F.xxhash64("k"), blocks).cast("int").alias("own"))
        dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "k", "size", "root", "sketch")
        ordered = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
        limit = self.limit

        def fresh(pairs: set[tuple[int, int]], given: set[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            new = sorted(pairs - given)
            if len(given) + len(new) > GIVEN:
                given.clear()
            given.update(new[:GIVEN])
            if new:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in new], pa.int64()), pa.array([b for _, b in new], pa.int64())], names=["a", "b"])

        def compare(part: list[pa.RecordBatch], given: set[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            own, k, size, root = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in part]) for i in (3, 4, 5, 6))
            lo, hi = part[0].column(1)[0].as_py(), part[0].column(2)[0].as_py()
            bits = np.frombuffer(b"".join(x for b in part for x in b.column(7).to_pylist()), np.uint64).reshape(len(k), SKETCH)
            size = size.astype(np.int64)
            left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
            best: dict[int, tuple[int, int, int]] = {}
            for at in range(0, len(left), 128):
                i = left[at : at + 128]
                total = size[i][:, None] + size[right][None, :]
                small = np.minimum(size[i][:, None], size[right][None, :])
                fits = (root[i][:, None] != root[right][None, :]) & (limit.den * small >= limit.num * (total - small))
                x, y = np.nonzero(fits)
                if not len(x):
                    continue
                i, j, total = i[x], right[y], total[x, y]
                overlap = -(-limit.num * total // (limit.num + limit.den))
                apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1).astype(np.int64)
                near = apart <= total - 2 * overlap
                if nearest:
                    for one, other in ((i, j), (j, i)):
                        order = np.flatnonzero(near)
                        order = order[np.lexsort((k[other[order]], k[one[order]], apart[order], root[one[order]]))]
                        first = np.concatenate(([True], np.diff(root[one[order]]) != 0)) if len(order) else order.astype(bool)
                        for x in order[first].tolist():
                            pair = (int(apart[x]), *sorted((int(k[i[x]]), int(k[j[x]]))))
                            of = int(root[one[x]])
                            best[of] = min(best.get(of, pair), pair)
                    continue
                a, b = np.minimum(k[i], k[j])[near], np.maximum(k[i], k[j])[near]
                yield from fresh(set(zip(a.tolist(), b.tolist(), strict=True)), given)
            yield from fresh({(a, b) for _, a, b in best.values()}, given)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            given: set[tuple[int, int]] = set()
            last = None
            for batch in batches:
                names = list(zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), strict=True))
                starts = [i for i in range(len(names)) if names[i] != (names[i - 1] if i else last)]
                for start, end in zip([0, *starts], [*starts, len(names)], strict=True):
                    if start in starts and held:
                        yield from compare(held, given)
                        held = []
                    if end > start:
                        held.append(batch.slice(start, end - start))
                last = names[-1] if names else last
            if held:
                yield from compare(held, given)

        return ordered.mapInArrow(releasing(work), "a bigint, b bigint")

    def _verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs of sets that do link, from their whole texts."""
        n, limit = self.n, self.limit
        pairs = stored(pairs.distinct(), f"{name}-pairs")
        needed = pairs.select(F.col("a_node").alias("node")).unionByName(pairs.select(F.col("b_node").alias("node"))).distinct()
        # One document a set has the text. A filter of fixed size, by hashes of ids, finds these
        # documents without moving any text; what passes it by chance meets no pair below.
        bit = F.pmod(F.xxhash64("doc"), F.lit(FILTER_BITS))
        ids = needed.join(self.classes, "node").select(F.col("least").alias("doc")).select(bit.alias("bit"))
        wanted = np.zeros(FILTER_BITS // 8, np.uint8)
        number = F.col("bit") + 1  # Spark's bitmaps count from 1
        for r in ids.groupBy(F.bitmap_bucket_number(number).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits")).collect():
            at = (r["n"] - 1) * len(r["bits"])
            piece = np.frombuffer(bytes(r["bits"]), np.uint8)[: max(0, len(wanted) - at)]
            wanted[at : at + len(piece)] |= piece
        shared = self.rows.sparkSession.sparkContext.broadcast(wanted)

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[bytes] = set()
            for batch in slices(batches, "body"):
                bits = batch.column(0).to_numpy()
                hit = (shared.value[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 1
                found = [(hashlib.blake2b(d, digest_size=16).digest(), d) for d in (s.tobytes() for s in shingle_sets(batch.column(1).filter(pa.array(hit)).to_pylist(), n))]
                fresh = {node: d for node, d in found if node not in seen}
                seen.update(fresh)
                if len(seen) > 500_000:
                    seen.clear()
                if fresh:
                    yield pa.RecordBatch.from_arrays([pa.array(list(fresh), pa.binary()), pa.array(list(fresh.values()), pa.binary())], names=["node", "data"])
            _CACHE.clear()

        read = self.rows.select(bit.alias("bit"), "body").mapInArrow(releasing(hashed), "node binary, data binary")
        data = stored(read.join(needed, "node", "left_semi").dropDuplicates(["node"]), f"{name}-data")
        both = pairs.join(data.select(F.col("node").alias("a_node"), F.col("data").alias("a_data")), "a_node").join(data.select(F.col("node").alias("b_node"), F.col("data").alias("b_data")), "b_node")

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = []
                for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(limit.den * common >= limit.num * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good))

        return stored(both.select("a_node", "b_node", "a_data", "b_data").mapInArrow(releasing(work), "u binary, v binary"), f"{name}-links")

    def roots(self) -> DataFrame:
        """(node, root) of every set that links with another: the components of all links."""
        scanned = stored(self._scanned(), "ngram-lists")
        ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        tested = scanned.where("pivot IS NOT NULL AND pivot <> k").select(*ordered("k", "pivot")).distinct()
        tested = stored(tested, "ngram-tested")
        links = self._verified(self._near(tested), "ngram-first")
        found = stored(components(links), "ngram-components")
        long = scanned.groupBy("key").agg(F.count("*").alias("n")).where("n > 2").select("key")
        listed = scanned.select("key", "k", "size").join(long, "key", "left_semi")
        # Members of a list in different components that have not been compared yet. The nearest of
        # each two components come first, which joins most of what belongs together by few pairs;
        # then all that are left.
        for nearest in (True, False):
            label = found.select(_key("node").alias("l_k"), _key("root").alias("root"))
            members = listed.join(label, F.col("k") == F.col("l_k"), "left").select("key", "k", "size", F.coalesce("root", "k").alias("root"))
            open_lists = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n")
            pairs = self._across(members.join(open_lists, "key"), nearest).distinct().join(tested, ["a", "b"], "left_anti")
            more = self._verified(self._near(pairs), f"ngram-{'nearest' if nearest else 'all'}")
            if not more.isEmpty():
                links = stored(links.unionByName(more), "ngram-links")
                found = stored(components(links), "ngram-components")
        return found

    def components(self) -> DataFrame:
        """A row a document: id, n_shingles, component_id (the least id that links reach), class_id (the least id with an equal set, its own without words).

        Besides ``root`` and ``sig``, for :func:`keep_one`: the component itself, as ids may be null or
        used again, and the MD5 of the text.
        """
        roots = stored(self.roots(), "ngram-roots")
        labelled = self.classes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
        least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
        named = labelled.join(least, "root").select("node", "root", "component_id", F.col("least").alias("class_id"))
        out = self.sets.join(named, "node", "left")
        component = F.when(F.col("size") == 0, F.col("doc")).otherwise(F.col("component_id"))
        return out.select(F.col("doc").alias(self.id_col), F.col("size").cast("bigint").alias("n_shingles"), component.alias("component_id"), F.when(F.col("size") == 0, F.col("doc")).otherwise(F.col("class_id")).alias("class_id"), "root", "sig")


def _key(node: str) -> Column:
    """The first 64 bits of a set's hash, as a signed number."""
    return F.conv(F.hex(F.substring(node, 1, 8)), 16, -10).cast("bigint")


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each component of ``found`` (see :meth:`NgramJoin.components`); rows without words stay.

    The row is told by its id and text, the least id first and null last. Rows that are equal in
    both are one, the least of them.
    """
    text = text_bytes(F.col(text_col).cast("string"))
    worded = F.rlike(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD))
    order = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), "sig")
    chosen = found.where("n_shingles > 0").groupBy("root").agg(F.min(order).alias("least")).select(F.col("least.id").alias("chosen_id"), F.col("least.sig").alias("chosen_sig"))
    signed = docs.where(worded).select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("own_id"), F.unhex(F.md5(text)).alias("own_sig"))
    kept = signed.join(chosen, F.col("own_id").eqNullSafe(F.col("chosen_id")) & (F.col("own_sig") == F.col("chosen_sig")), "left_semi")
    one = kept.groupBy("own_id", "own_sig").agg(F.min("row").alias("row")).select("row.*")
    return one.unionByName(docs.where(~worded))
