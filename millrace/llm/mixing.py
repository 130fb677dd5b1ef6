"""Mixing sources to target weights, by blocks of fixed length.

Method. The words of each source form one stream (documents in a fixed pseudorandom order) that is
cut into blocks of ``block_words`` words, the last of which may be short. The mix is a sequence of
output shards of a fixed number of slots. Each shard draws how many of its slots every source gets,
multinomially from what the sources have left, so the totals are met exactly. The i-th slot of a
source is mapped to a block by a pseudorandom permutation of the numbers of the source's full blocks
(a Feistel network with cycle walking), one permutation per pass over the source; the short block
ends each pass. The last slot of a source takes only as many words of its block as the target has
left, so that a source of a few words meets its target as well as a large one. Slots and blocks are
then joined on (source, block), and blocks lead to documents, with the words of each that the block
holds.

Targets. Sources, in code-point order with null last, weigh 1, 2, 3, 1, ...; they share
``share`` of all words by weight, no source more than ``most`` times its own words, and what that
frees is shared again by weight. Each source takes its target, rounded to whole words. Passes are
whole permutations, so no block, hence no document, is taken more than ``most`` times.

The driver holds one row a source (the catalogue of the mix) and the draws of groups of shards, of
``GROUP_SHARDS`` each or, where these would need more than ``DRAWS`` numbers, of more; groups draw
for their shards in parallel. All else is distributed, and every choice follows from hashes and
seeds, so reruns agree.

Defined cases: null text has no words, gets a row and is never taken; a null source is a source of
its own; rows with equal ids and texts are documents of their own, which are counted before they are
placed and so never meet in one task as rows; very long texts span many blocks and are never cut
but at words; ties in the order of a stream are between equal rows alone; an empty table gives an
empty result; a source without words has target 0. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.llm.common import WORD, releasing, slices, stored, text_bytes

#: Shards in a group, the least number of groups where there are so many shards, and the most numbers
#: that the driver draws for all groups.
GROUP_SHARDS, GROUPS, DRAWS = 64, 256, 4_000_000
#: Documents in a bucket of the streams, about, and from how many buckets on these grow; offsets are
#: summed within and over buckets.
BUCKET_ROWS, BUCKETS, GROWN_ROWS = 500, 1024, 100_000


@dataclass(frozen=True)
class Source:
    """One row of the catalogue: number, name, weight, words, target, blocks, slots and the words of the last slot."""

    sid: int
    name: object
    weight: int
    size: int
    target: float
    blocks: int
    slots: int
    last: int


def targets(sizes: list[int], weights: list[int], share: float = 1.0, most: int = 3) -> list[float]:
    """Shares of ``share`` of all words by weight, none above ``most`` times its size."""
    out, left = [0.0] * len(sizes), set(range(len(sizes)))
    rest = share * sum(sizes)
    while left:
        weight = sum(weights[i] for i in left)
        full = {i for i in left if rest * weights[i] > most * sizes[i] * weight}
        if not full:
            for i in left:
                out[i] = rest * weights[i] / weight
            break
        for i in full:
            out[i] = float(most * sizes[i])
            rest -= out[i]
        left -= full
    return out


def draw(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` slots each source gets: multinomial by what is left, never more than that."""
    got = np.zeros_like(left)
    while n > 0:
        rest = left - got
        got += np.minimum(rng.multinomial(n, rest / rest.sum()), rest)
        n -= int(got.sum()) - int(left.sum() - rest.sum())
    return got


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The image of each index under the permutation of range(n) that ``key`` selects.

    Four Feistel rounds over the least even number of bits that holds n; images beyond n - 1 are
    mapped again until they fall below n, so each permutation is one of range(n) itself.
    """
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    n = n.astype(np.uint64)
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        hi, lo = out[todo] >> h, out[todo] & m
        for r in range(4):
            x = (lo + k + np.uint64(r * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            hi, lo = lo, hi ^ ((x ^ (x >> np.uint64(32))) & m)
        out[todo] = hi << h | lo
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def _keys(sid: np.ndarray, epoch: np.ndarray, seed: int) -> np.ndarray:
    x = (sid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (epoch.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


class Mix:
    """A mix of ``docs``: its sized documents, catalogue, slots and spans."""

    def __init__(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = 256, shard_slots: int = 4096, share: float = 1.0, most: int = 3, seed: int = 7):
        self.spark: SparkSession = docs.sparkSession
        self.docs, self.id_col, self.text_col = docs, id_col, text_col
        self.block_words, self.shard_slots, self.seed = block_words, shard_slots, seed
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        sized = stored(docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("sig"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size")), "mix-sizes")
        self.catalogue = self._catalogue(sized, share, most)
        self.sized = stored(self._placed(sized), "mix-places")

    def _catalogue(self, sized: DataFrame, share: float, most: int) -> list[Source]:
        rows = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).orderBy(F.asc_nulls_last("source")).collect()
        self.counted = rows
        sizes, weights = [r["size"] for r in rows], [1 + i % 3 for i in range(len(rows))]
        out = []
        for i, (row, size, target) in enumerate(zip(rows, sizes, targets(sizes, weights, share, most), strict=True)):
            blocks = -(-size // self.block_words)
            passes, rest = divmod(min(most * size, math.floor(target + 0.5)), size) if size else (0, 0)
            # The slots of a partial pass are full but the last; that of a whole pass is the short block.
            partial = -(-rest // self.block_words)
            last = rest - (partial - 1) * self.block_words if partial else self.block_words
            out.append(Source(i, row["source"], weights[i], size, target, blocks, passes * blocks + partial, last))
        return out

    def _placed(self, sized: DataFrame) -> DataFrame:
        """Documents with source number and offset: the words before it in its source's stream."""
        schema = "source string, sid int, source_size bigint, target double"
        plan = self.spark.createDataFrame([(s.name, s.sid, s.size, s.target) for s in self.catalogue], schema)
        rows = sum(r["rows"] for r in self.counted)
        buckets = 1 + min(rows // BUCKET_ROWS, BUCKETS + rows // GROWN_ROWS)
        # Equal rows are one run of copies until each has its offset.
        runs = sized.groupBy("doc", "sig", "source", "size").agg(F.count("*").alias("copies"))
        runs = runs.withColumn("bucket", F.pmod(F.xxhash64("doc", "sig"), F.lit(buckets))).withColumn("run", F.col("size") * F.col("copies"))
        totals = runs.groupBy("source", "bucket").agg(F.sum("run").alias("words"))
        before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
        within = Window.partitionBy("source", "bucket").orderBy("doc", "sig", "size").rowsBetween(Window.unboundedPreceding, -1)
        runs = runs.withColumn("inner", F.coalesce(F.sum("run").over(within), F.lit(0)))
        runs = runs.join(totals, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        copy = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy")
        placed = runs.select("doc", "sig", F.col("source").alias("name"), "size", "base", "inner", copy)
        placed = placed.withColumn("offset", F.col("base") + F.col("inner") + F.col("copy") * F.col("size"))
        # A row a source, as the driver has them.
        return placed.join(F.broadcast(plan), F.col("name").eqNullSafe(F.col("source"))).select("doc", "sig", "sid", "size", "offset", "source_size", "target")

    def slots(self) -> DataFrame:
        """The mix as (shard, slot, sid, block, room): which block each slot of each shard holds, and how many of its words."""
        left = np.array([s.slots for s in self.catalogue], dtype=np.int64)
        column = lambda values: np.array(list(values), dtype=np.int64)
        slots, last, blocks = left, column(s.last for s in self.catalogue), column(s.blocks for s in self.catalogue)
        full = column(s.size // self.block_words for s in self.catalogue)
        total, per, seed, words = int(left.sum()), self.shard_slots, self.seed, self.block_words
        shards = -(-total // per)
        groups_wanted = min(shards, max(GROUPS, min(-(-shards // GROUP_SHARDS), DRAWS // max(1, len(left)))))
        bounds = np.linspace(0, shards, groups_wanted + 1).astype(int) if shards else np.zeros(1, int)
        rng, groups, given = np.random.default_rng(seed), [], np.zeros_like(left)
        for first, end in itertools.pairwise(bounds.tolist()):
            got = draw(rng, left - given, min(end * per, total) - first * per)
            groups.append((first, end, got.tolist(), given.tolist()))
            given = given + got
        frame = self.spark.createDataFrame(groups, "first int, last int, counts array<bigint>, given array<bigint>")

        def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for group in (g for f in frames for g in f.itertuples()):
                rest, at = np.array(group.counts, np.int64), np.array(group.given, np.int64)
                for shard in range(group.first, group.last):
                    rng = np.random.default_rng([seed, shard])
                    got = draw(rng, rest, min(per, int(rest.sum())))
                    sid = np.repeat(np.arange(len(got)), got)
                    i = np.concatenate([np.arange(a, a + n) for a, n in zip(at, got, strict=True)])
                    epoch = i // np.maximum(blocks[sid], 1)
                    block = i - epoch * blocks[sid]
                    inner = np.flatnonzero(block < full[sid])
                    block[inner] = permuted(block[inner], full[sid[inner]], _keys(sid[inner], epoch[inner], seed))
                    room = np.where(i == slots[sid] - 1, last[sid], words)
                    rest, at = rest - got, at + got
                    yield pd.DataFrame({"shard": shard, "slot": rng.permutation(len(sid)), "sid": sid, "block": block, "room": room})

        # A group is a few numbers, so each task gets some of them by range: no hash makes a task of many.
        return frame.repartitionByRange(max(1, len(groups)), "first").mapInPandas(work, "shard int, slot int, sid int, block bigint, room bigint")

    def spans(self) -> DataFrame:
        """What each slot takes of which document: slots joined with blocks.

        Columns: shard, slot, sid, block, doc, sig, offset, start (first word taken, from 0), words.
        """
        b = self.block_words
        end = F.col("offset") + F.col("size")
        pieces = self.sized.where("size > 0").select("doc", "sig", "sid", "offset", "size", F.explode(F.sequence(F.floor(F.col("offset") / b), F.floor((end - 1) / b))).alias("block"))
        start = F.greatest(F.col("offset"), F.col("block") * b)
        pieces = pieces.select("doc", "sig", "sid", "offset", "block", (start - F.col("offset")).alias("start"), (start - F.col("block") * b).alias("at"), (F.least(end, (F.col("block") + 1) * b) - start).alias("words"))
        # Slots come from a small table of groups, which says nothing about their number: without
        # the hint Spark would take them for small and broadcast them.
        joined = self.slots().hint("merge").join(pieces, ["sid", "block"]).withColumn("words", F.least("words", F.col("room") - F.col("at")))
        return joined.where("words > 0").drop("room", "at")

    def taken(self) -> DataFrame:
        """A row a document: id, size, source_size, target, taken."""
        sums = self.spans().groupBy("sid", "offset").agg(F.sum("words").alias("taken"))
        # Documents with words have offsets of their own in their source; the others are never taken.
        key = F.when(F.col("size") > 0, F.col("offset"))
        docs = self.sized.withColumn("key", key).alias("d").join(sums.alias("t"), (F.col("d.sid") == F.col("t.sid")) & (F.col("d.key") == F.col("t.offset")), "left")
        return docs.select(F.col("d.doc").alias(self.id_col), "d.size", "d.source_size", "d.target", F.coalesce("t.taken", F.lit(0)).cast("bigint").alias("taken"))

    def texts(self, carried: tuple[str, ...] = ()) -> DataFrame:
        """The documents that the mix takes, with the text that it takes of each, and ``carried`` columns.

        Words taken more than once are repeated: the first pass over the document comes first, then
        the second and so on, each the taken runs of the original text joined by line feeds.
        """
        spans = self.spans().groupBy("doc", "sig", "sid", "offset").agg(F.array_sort(F.collect_list(F.struct("start", "words"))).alias("spans"))
        # Equal rows have equal texts, so which of them gets which span makes no difference: they
        # are numbered on both sides.
        number = lambda order: F.row_number().over(Window.partitionBy("doc", "sig").orderBy(*order))
        placed = self.sized.where("size > 0").withColumn("copy", number(("sid", "offset"))).join(spans.select("sid", "offset", "spans"), ["sid", "offset"]).select("doc", "sig", "copy", "spans")
        text = F.coalesce(F.col(self.text_col).cast("string"), F.lit(""))
        columns = [F.col(c).alias(f"c_{i}") for i, c in enumerate(carried)]
        # Texts without words are never taken; they are left out before rows are numbered, as they may be many.
        source = self.docs.where(F.rlike(text, F.lit(WORD))).select(F.col(self.id_col).alias("doc"), F.xxhash64(text).alias("sig"), text_bytes(text).alias("body"), *columns)
        source = source.withColumn("copy", F.row_number().over(Window.partitionBy("doc", "sig").orderBy(*([f"c_{i}" for i in range(len(carried))] or ["sig"]))))
        same = F.col("l.doc").eqNullSafe(F.col("r.doc")) & (F.col("l.sig") == F.col("r.sig")) & (F.col("l.copy") == F.col("r.copy"))
        joined = source.alias("l").join(placed.hint("shuffle_hash").alias("r"), same).select("l.doc", "l.body", F.col("r.spans.start").alias("starts"), F.col("r.spans.words").alias("words"), *(f"l.c_{i}" for i in range(len(carried))))
        fields = [T.StructField(self.id_col, joined.schema["doc"].dataType), T.StructField("text", T.StringType()), *(T.StructField(c, joined.schema[f"c_{i}"].dataType) for i, c in enumerate(carried))]

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "body"):
                texts = [cut(*row).decode("utf-8", "replace") for row in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *batch.columns[4:]], names=[f.name for f in fields])

        return joined.mapInArrow(releasing(work), T.StructType(fields))


WORDS = re.compile(WORD.encode())


def cut(body: bytes, starts: list[int], words: list[int]) -> bytes:
    """The taken words of a text; see :meth:`Mix.texts`."""
    places = [m.span() for m in WORDS.finditer(body)]
    times = np.zeros(len(places) + 1, np.int64)
    for s, n in zip(starts, words, strict=True):
        times[s] += 1
        times[s + n] -= 1
    times = np.cumsum(times)[:-1]
    out = []
    for k in range(1, int(times.max(initial=0)) + 1):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (times >= k).astype(np.int8), [0]))))
        for first, end in edges.reshape(-1, 2).tolist():
            out.append(body if (first, end) == (0, len(places)) else body[places[first][0] : places[end - 1][1]])
    return b"\n".join(out)


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """How much the mix takes of every document; see :class:`Mix` for the options."""
    return Mix(docs, **options).taken()


__all__ = ["Mix", "Source", "cut", "draw", "mix_sources", "permuted", "targets"]
