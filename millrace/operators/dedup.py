"""Near-duplicate removal by similarity hashes in bands, first occurrence wins.

A text's 64-bit similarity hash is made of two 32-bit halves of its tokens' hashes, all in native
expressions. Candidates share one of four 16-bit bands; they link by length, script, Hamming
distance and token overlap. A text goes if it links to an earlier one that stays, which is decided
in rounds: whoever has no undecided earlier neighbour stays, and its later neighbours go.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import CJK, script, utf16_length
from millrace.storage import cut

#: Fixed values of the token hash: its start as two 32-bit halves, and the low part of its
#: multiplier, which is 2 ** 40 + 435.
START_HI, START_LO, FACTOR = 1469598103934665603 >> 32, 1469598103934665603 & 0xFFFFFFFF, 435
LOW32 = 0xFFFFFFFF
TOKEN = f"[a-zA-Z0-9{CJK}]+"


def tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and CJK; three-character windows if there are none."""
    runs = F.transform(F.regexp_extract_all(c, F.lit(f"({TOKEN})"), F.lit(0)), F.lower)
    windows = F.when(F.length(c) >= 3, F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.lower(F.substr(c, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(runs) > 0, runs).otherwise(windows)


def token_hash(c: Column) -> Column:
    """64-bit hash of a token as a struct of halves (hi, lo), by 32-bit arithmetic that can't overflow."""

    def step(h: Column, ch: Column) -> Column:
        x = h["lo"].bitwiseXOR(F.ascii(ch).cast("bigint"))
        low = x * FACTOR
        high = h["hi"] * FACTOR + F.shiftright(low, 32) + F.shiftleft(x, 8)
        return F.struct(high.bitwiseAND(F.lit(LOW32)).alias("hi"), low.bitwiseAND(F.lit(LOW32)).alias("lo"))

    start = F.struct(F.lit(START_HI).cast("bigint").alias("hi"), F.lit(START_LO).cast("bigint").alias("lo"))
    return F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), start, step)


#: Bits of the filter that says whose words are needed; token hashes that a worker keeps, which only save time.
FILTER_BITS, CACHED = 1 << 23, 200_000
#: Buckets of a sketch; a bucket's number is ten bits of a hash.
SKETCH = 1024


class _TokenHashes(dict):
    """The 64-bit hashes of tokens, see :func:`token_hash`, computed when first asked for."""

    def __missing__(self, token: str) -> int:
        h = START_HI << 32 | START_LO
        for ch in token:
            h = ((h ^ ord(ch)) * ((1 << 40) + FACTOR)) & 0xFFFFFFFFFFFFFFFF
        if len(self) >= CACHED:
            self.clear()
        self[token] = h
        return h


_HASHES = _TokenHashes()
_RUNS = re.compile(TOKEN)


def _windows(text: Column) -> Column:
    """The tokens of a text without runs of letters, else null: see :func:`tokens`."""
    return F.when(~F.rlike(text, F.lit(TOKEN)), tokens(text))


def _token_lists(texts: pa.Array, windows: pa.Array) -> Iterator[list[str]]:
    """The tokens of each text. Runs hold no letters but ASCII ones and CJK, which has no case."""
    for text, other in zip(texts.to_pylist(), windows.to_pylist(), strict=True):
        yield [t.lower() for t in _RUNS.findall(text)] if other is None else other


def _hashes(found: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, len, script, sim, n, sketch) of (key, id, len, script, text, windows).

    The similarity hash, the number of distinct tokens, and for each of SKETCH buckets of these whether
    their number is odd: at most as many buckets differ between texts as tokens do.
    """
    for batch in batches:
        sims, sizes, sketches = [], [], []
        for found in _token_lists(batch.column(4), batch.column(5)):
            counted = Counter(found)
            h = _hashes(counted)
            times = np.fromiter(counted.values(), np.int64, len(counted))
            bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones = (times @ bits) * 2 >= times.sum()
            sims.append(int.from_bytes(np.packbits(ones).tobytes(), "big", signed=True) if counted else 0)
            sizes.append(len(counted))
            # The low bits of a product depend on few bits of a token; mixed ones name the bucket.
            bucket = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(54)).astype(np.int64)
            sketches.append(np.packbits(np.bincount(bucket, minlength=SKETCH) & 1 == 1).tobytes())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sims, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary())], names=["key", "id", "len", "script", "sim", "n", "sketch"])


def _bits(numbers: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS bits in which those of the column ``bit`` are set."""
    wanted = np.zeros(FILTER_BITS // 8, np.uint8)
    number = F.col("bit") + 1  # Spark's bitmaps count from 1
    for r in numbers.groupBy(F.bitmap_bucket_number(number).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits")).collect():
        at = (r["n"] - 1) * len(r["bits"])
        piece = np.frombuffer(bytes(r["bits"]), np.uint8)[: max(0, len(wanted) - at)]
        wanted[at : at + len(piece)] |= piece
    return wanted


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hi, lo): the halves of each text's similarity hash; 0 for text without tokens.

    Words are hashed once each, and their hashes are joined with the words' counts by text.
    """
    words = docs.select(id_col, F.explode(tokens(F.coalesce(text_col, F.lit("")))).alias("w"))
    counts = words.groupBy(id_col, "w").agg(F.count("*").alias("n"))
    hashes = counts.select("w").distinct().select("w", token_hash(F.col("w")).alias("h"))
    joined = counts.join(hashes, "w").select(id_col, "n", F.col("h.hi").alias("hi"), F.col("h.lo").alias("lo"))
    bit = lambda half, i: F.sum(F.when(F.col(half).bitwiseAND(F.lit(1 << i)) != 0, F.col("n")).otherwise(-F.col("n"))).alias(f"{half}{i}")
    sums = joined.groupBy(id_col).agg(*(bit(half, i) for half in ("hi", "lo") for i in range(32)))
    whole = lambda half: sum((F.when(F.col(f"{half}{i}") >= 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i in range(1, 32)), F.when(F.col(f"{half}0") >= 0, 1).otherwise(0).cast("bigint"))
    found = sums.select(id_col, whole("hi").alias("hi"), whole("lo").alias("lo"))
    zero = F.lit(0).cast("bigint")
    return docs.select(id_col).join(found, id_col, "left").select(id_col, F.coalesce("hi", zero).alias("hi"), F.coalesce("lo", zero).alias("lo"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, first): each row and the first row with the same text; null counts as empty."""
    keyed = docs.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("key"))
    return keyed.join(keyed.groupBy("key").agg(F.min("id").alias("first")), "key").select("id", "first")


def kept_ids(docs: DataFrame, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id) of the rows that stay when each row goes that nearly repeats an earlier one that stays.

    Later copies of a text always go, as they link to whatever their first one links to; so the
    decision is among first rows. A threshold of 0 keeps the first row of all.
    """
    if threshold <= 0:
        return docs.agg(F.min(id_col).alias("id")).where("id IS NOT NULL")
    firsts = classes(docs, id_col, text_col).select(F.col("first").alias("id")).distinct()
    return first_kept(firsts, links(docs, min(threshold, 1.0), id_col=id_col, text_col=text_col))


def keepers(docs: DataFrame, kept: DataFrame, edges: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keeper): for each removed row the kept one that it repeats, of several the first."""
    rows = classes(docs, id_col, text_col)
    alive = kept.select(F.col("id").alias("own"))
    near = edges.join(alive, F.col("a") == F.col("own")).groupBy("b").agg(F.min("own").alias("near"))
    home = rows.join(alive, F.col("first") == F.col("own"), "left").join(near, F.col("first") == F.col("b"), "left")
    return home.select("id", F.coalesce("own", "near").alias("keeper")).where("id <> keeper")


def _close(described: DataFrame, threshold: float, skip_cross_script: bool) -> DataFrame:
    """(a, b), a < b: rows of ``described`` that may link, by all that is told of them but their words.

    Similarity hashes of one language are alike, so keys of parts of them would meet in more rows than
    there are texts. Each task holds a slice of the table and streams past it the rows of a number of
    tokens that is within the threshold; what leaves it has sketches that allow a link.
    """
    kind = described.schema["id"].dataType.simpleString()
    # A row a file.
    files = sorted(tuple(r) for r in described.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*"), F.min("n"), F.max("n")).select(F.col("min(n)"), F.col("max(n)"), F.col("file"), F.col("count(1)")).collect())
    rows = min(max(LEAST_SLICE, -(-sum(f[3] for f in files) // 64)), MOST_SLICE)
    # Rows of a file are counted with those that have no id, which are passed over.
    slices = [(i, lo, lo + rows) for i, f in enumerate(files) for lo in range(0, f[3], rows)]
    if not slices:
        return described.select(F.col("id").alias("a"), F.col("id").alias("b")).where("false")
    most, block, held = int(64 * (1 - threshold)), BLOCK, max(BLOCK, HELD_BYTES // 256)
    spare = (1 - threshold) / (1 + threshold)

    def read(file: int, start: int) -> Iterator[tuple]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(files[file][2])
        with store.open_input_file(name) as source:
            at = 0
            for batch in pq.ParquetFile(source).iter_batches(batch_size=held, columns=["id", "len", "script", "sim", "n", "sketch"]):
                batch = batch.filter(pc.is_valid(batch.column(0)))
                skip = min(max(0, start - at), batch.num_rows)
                at, batch = at + batch.num_rows, batch.slice(skip)
                if batch.num_rows:
                    size, sim, n = (batch.column(i).to_numpy() for i in (1, 3, 4))
                    cross = pc.fill_null(pc.index_in(batch.column(2), pa.array(["cjk", "latin"])), -9).to_numpy()
                    bits = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
                    yield at - batch.num_rows, batch.column(0), size, sim.view(np.uint64), n.astype(np.int64), cross, bits

    def apart(n: np.ndarray, m: np.ndarray) -> bool:
        return n.max() < threshold * m.min() or m.max() < threshold * n.min()

    def over(x: tuple, y: tuple, within: bool) -> Iterator[pa.RecordBatch]:
        (px, ix, lx, sx, nx, cx, bx), (py, iy, ly, sy, ny, cy, by) = x, y
        for i in range(0, len(nx), 512):
            for j in range(0, len(ny), block):
                if within and px + i >= py + j + block or apart(nx[i : i + 512], ny[j : j + block]):
                    continue
                r, c = np.nonzero(np.bitwise_count(sx[i : i + 512, None] ^ sy[None, j : j + block]) <= most)
                for k in range(0, len(r), 100_000):
                    p, q = r[k : k + 100_000] + i, c[k : k + 100_000] + j
                    good = np.minimum(nx[p], ny[q]) >= threshold * np.maximum(nx[p], ny[q])
                    if within:
                        good &= px + p < py + q
                    p, q = p[good], q[good]
                    bands = (sx[p] ^ sy[q]).view(np.uint16).reshape(-1, 4)
                    good = (bands == 0).any(axis=1)
                    both = (lx[p] > 0) & (ly[q] > 0)
                    good &= ~both | (np.abs(lx[p] - ly[q]) / np.maximum(1, np.maximum(lx[p], ly[q])) <= 0.5)
                    if skip_cross_script:
                        good &= ~((cx[p] + cy[q] == 1) & both)
                    p, q = p[good], q[good]
                    good = np.bitwise_count(bx[p] ^ by[q]).sum(axis=1) <= (nx[p] + ny[q]) * spare + 1e-6
                    p, q = p[good], q[good]
                    if len(p):
                        a, b = ix.take(pa.array(p)), iy.take(pa.array(q))
                        yield pa.RecordBatch.from_arrays([pc.min_element_wise(a, b), pc.max_element_wise(a, b)], names=["a", "b"]).filter(pc.not_equal(a, b))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                own, lo, hi = slices[number]
                mine, left = [], hi - lo
                for side in read(own, lo):
                    mine.append((side[0], *(z[:left] for z in side[1:])))
                    left -= len(mine[-1][1])
                    if left <= 0:
                        break
                for file in range(own, len(files)):
                    if not mine or apart(np.array(files[own][:2]), np.array(files[file][:2])):
                        continue
                    for side in read(file, lo if file == own else 0):
                        for x in mine:
                            yield from over(x, side, file == own)

    # A task a slice.
    tasks = described.sparkSession.range(0, len(slices), 1, len(slices))
    return tasks.mapInArrow(compared, f"a {kind}, b {kind}")


def links(docs: DataFrame, threshold: float = 0.9, skip_cross_script: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b), a < b: pairs of near-duplicate texts, each by the first id that has the text.

    Equal texts are one class, of which the first row stands for the others, so that a text of many
    copies makes no pairs among them; :func:`classes` has the membership.

    Linked texts share one of four bands of 16 bits of their hashes, differ in few of the others, and
    have numbers of words within the threshold of each other. Pairs of which sketches say that their
    words differ in too many go before any words are moved; the rest is decided by all their words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    # The text itself is never moved: what is told of it is a short row, by the digest of the text.
    rows = docs.select(F.unhex(F.sha2(text, 256)).alias("key"), F.col(id_col).alias("id"), utf16_length(text).alias("len"), script(text).alias("script"), text.alias("text"), _windows(text).alias("windows"))
    told = rows.mapInArrow(_told, f"key binary, id {kind}, len bigint, script string, sim bigint, n int, sketch binary")
    described = cut(told.groupBy("key").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("len", "script", "sim", "n", "sketch"))).repartitionByRange("n").sortWithinPartitions("n"), "described")
    pairs = cut(_close(described.where("id IS NOT NULL"), threshold, skip_cross_script), "pairs")
    # Words of the texts in pairs alone, found by a filter of a fixed size; what passes it by chance meets no pair.
    ends_ = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    needed = described.join(ends_, "id", "left_semi").select("key", "id")
    bit = lambda key: F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    wanted = _bits(needed.select(bit("key").alias("bit")))
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            batch = batch.filter(pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            if batch.num_rows:
                words = [np.unique(_hashes(t)).tobytes() for t in _token_lists(batch.column(2), batch.column(3))]
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(words, pa.binary())], names=["key", "words"])

    read = rows.select(bit("key").alias("bit"), "key", "text", "windows").mapInArrow(asked, "key binary, words binary")
    words = cut(read.join(needed, "key").groupBy("key").agg(F.first("id").alias("id"), F.first("words").alias("words")).select("id", "words"), "words")
    side = lambda x: words.select(F.col("id").alias(x), F.col("words").alias(f"{x}_words"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_words", "b_words")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                total = len(x) + len(y)
                good.append((1.0 if total == 0 else 0.0 if not len(x) or not len(y) else common / (total - common)) >= threshold)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return cut(both.mapInArrow(alike, f"a {kind}, b {kind}"), "links")


def first_kept(nodes: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """The (id) of ``nodes`` that stay: the first independent set in the order of ids.

    ``edges`` are (a, b) with a < b. Each round keeps the nodes without an earlier neighbour among
    the undecided, drops their neighbours, and goes on with what is left, until nothing is; the least
    undecided node is decided in every round, so the rounds end. More than ``rounds`` of them, if that
    is set, are an error.
    """
    left, dropped = cut(edges, "undecided"), []
    while not left.isEmpty():
        if rounds is not None and len(dropped) >= rounds:
            raise RuntimeError(f"first_kept did not settle in {rounds} rounds")
        later = left.select(F.col("b").alias("a")).distinct()
        heads = left.select("a").distinct().join(later, "a", "left_anti")
        gone = cut(left.join(heads, "a").select(F.col("b").alias("id")).distinct(), "dropped")
        dropped.append(gone)
        out = gone.withColumnRenamed("id", "a")
        # Heads whose neighbours are all gone leave with them, as an edge goes with either end.
        left = cut(left.join(out, "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b"), "undecided")
    if not dropped:
        return nodes
    return nodes.join(reduce(DataFrame.unionByName, dropped), "id", "left_anti")


def exact_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key, by ``order``, combined before the shuffle."""
    return df.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*df.columns), order).alias("_row")).select("_row.*")


#: Directions in which vectors are compared first, and vectors that one comparison takes from each side.
PIVOTS, BLOCK = 16, 2048
#: The least and the most vectors that a task compares with all later ones, and bytes of these that it holds at once.
LEAST_SLICE, MOST_SLICE, HELD_BYTES = 512, 32_768, 16 << 20
#: By how much a cosine of single precision may be off.
SLACK = 1e-4


def semantic_pairs(vectors: DataFrame, limit: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(a, b, similarity) of vectors with a cosine over ``limit``: exact.

    Vectors are stored once in the shared folder, and nothing else is: each task holds a slice of them
    and streams those that come later past it, block by block. Two blocks are compared in a few random
    orthogonal directions first. What the rest may add to the cosine is at most the product of the
    lengths there, so a pair whose cosine in these directions plus that product is not over the limit
    is no pair; the others are computed in single precision and, near the limit or over it, in double.

    The number of comparisons is that of all pairs, as vectors that are dense in all directions have no
    regions of their own; a comparison is a column of a matrix product. Disk is that of one copy.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    double = vectors.schema[vector_col].dataType.elementType.simpleString() != "float"
    unit = cut(_packed(vectors, id_col, vector_col, kind, double), "vectors")
    # A row a file.
    files = sorted(tuple(r) for r in unit.groupBy(F.col("_metadata.file_path").alias("file")).count().collect())
    rows = min(max(LEAST_SLICE, -(-sum(n for _, n in files) // 64)), MOST_SLICE)
    slices = [(i, lo, min(lo + rows, n)) for i, (_, n) in enumerate(files) for lo in range(0, n, rows)]
    if not slices:
        return unit.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("similarity")).where("false")
    paths, block, directions, held = [f for f, _ in files], BLOCK, PIVOTS, HELD_BYTES

    def read(file: int, start: int) -> Iterator[tuple]:
        """(place of the first, ids, vectors, lengths, unit vectors, few directions and the length of the rest) from a row on."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(paths[file])
        with store.open_input_file(name) as source:
            at, table, most = 0, pq.ParquetFile(source), None
            for batch in table.iter_batches(batch_size=1024, columns=["v"]):
                most = max(block, held // max(1, batch.column(0).nbytes // batch.num_rows))
                break
            for batch in table.iter_batches(batch_size=most or 1, columns=["id", "v", "norm"]):
                skip = min(max(0, start - at), batch.num_rows)
                at, batch = at + batch.num_rows, batch.slice(skip)
                if not batch.num_rows:
                    continue
                v = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64 if double else np.float32).reshape(batch.num_rows, -1)
                norm = batch.column(2).to_numpy()
                u = (v / norm[:, None]).astype(np.float32)
                if u.shape[1] > directions:
                    turn = np.linalg.qr(np.random.default_rng(0).normal(size=(u.shape[1], directions)))[0].astype(np.float32)
                    few = u @ turn
                    few = np.column_stack([few, np.sqrt(np.maximum(0, 1 - np.square(few).sum(axis=1)))])
                else:
                    few = u
                yield at - batch.num_rows, batch.column(0), v, norm, u, few

    def over(x: tuple, y: tuple, within: bool) -> Iterator[pa.RecordBatch]:
        """Pairs of two sides; ``within`` if both are in one file, where a pair's first is the earlier row."""
        (px, ix, vx, nx, ux, fx), (py, iy, vy, ny, uy, fy) = x, y
        for i in range(0, len(ux), block):
            for j in range(0, len(uy), block):
                if within and px + i >= py + j + block:
                    continue
                near = fx[i : i + block] @ fy[j : j + block].T > limit - SLACK
                n = np.count_nonzero(near)
                if n > near.size // 16:
                    near &= ux[i : i + block] @ uy[j : j + block].T > limit - SLACK
                if not n:
                    continue
                for k in range(0, len(near), 64):
                    r, c = np.nonzero(near[k : k + 64])
                    r, c = r + i + k, c + j
                    if within:
                        r, c = (z[px + r < py + c] for z in (r, c))
                    good = np.einsum("ij,ij->i", ux[r], uy[c]) > limit - SLACK
                    r, c = r[good], c[good]
                    if not len(r):
                        continue
                    dot = np.zeros(len(r))
                    for d in range(vx.shape[1]):
                        dot += vx[r, d].astype(np.float64) * vy[c, d].astype(np.float64)
                    dot /= nx[r] * ny[c]
                    a, b = ix.take(pa.array(r)), iy.take(pa.array(c))
                    found = pa.RecordBatch.from_arrays([pc.min_element_wise(a, b), pc.max_element_wise(a, b), pa.array(dot)], names=["a", "b", "similarity"])
                    yield found.filter(pc.and_(pa.array(dot > limit), pc.not_equal(a, b)))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                own, lo, hi = slices[number]
                mine, left = [], hi - lo
                for side in read(own, lo):
                    mine.append((side[0], *(z[:left] for z in side[1:])))
                    left -= len(mine[-1][1])
                    if left <= 0:
                        break
                for file in range(own, len(paths)):
                    for side in read(file, lo if file == own else 0):
                        for x in mine:
                            yield from over(x, side, file == own)

    # A task a slice.
    tasks = vectors.sparkSession.range(0, len(slices), 1, len(slices))
    return tasks.mapInArrow(compared, f"a {kind}, b {kind}, similarity double")


def _packed(vectors: DataFrame, id_col: str, vector_col: str, kind: str, double: bool) -> DataFrame:
    """(id, v, norm): vectors with a length, as the bytes of their numbers."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>" if double else "array<float>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).where("norm > 0")
    number = np.float64 if double else np.float32

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.array(v, number).tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), batch.column(2)], names=["id", "v", "norm"])

    return rows.mapInArrow(work, f"id {kind}, v binary, norm double")


def semantic_kept(vectors: DataFrame, limit: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id) of the vectors that stay when each goes that is over ``limit`` near to an earlier one that stays.

    Rows without a vector or without a length are near to nothing and stay.
    """
    pairs = semantic_pairs(vectors, limit, id_col, vector_col).select("a", "b")
    return first_kept(vectors.select(F.col(id_col).alias("id")), pairs)


def centroids(vectors: DataFrame, group_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(group, n, centroid): the elementwise mean of each group's vectors."""
    parts = vectors.select(group_col, F.posexplode(vector_col).alias("pos", "x"))
    means = parts.groupBy(group_col, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    return means.groupBy(group_col).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))
