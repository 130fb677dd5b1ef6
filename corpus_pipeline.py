"""A corpus pipeline: five stages of the operators for training data, in order, over ``documents``.

``STAGES`` lists (name, function). Each function takes (spark, docs, sf_dir) and returns a
DataFrame; all but the last return the columns of ``documents``. :func:`run` writes each stage's
result to the shared folder as Parquet and reads it as the next one's documents.

Defined for all stages: an empty table gives an empty table; very long texts are processed whole;
columns beside those of ``documents``, whatever their names, are dropped and never read. Each stage
states its nulls, ties and repeated rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, langid, lines, mixing, ngrams
from millrace.llm.common import stored
from millrace.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: those without a letter, and those far from all profiles.

    Null and empty texts go, as they have no letter. Null ids and repeated rows are judged row by row;
    a null language is not learned from. Ties between languages go to the smaller name and drop nothing.
    """
    return langid.told(docs.select(*COLUMNS))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps only the first occurrence of lines that at least 10 documents hold, and drops documents with nothing left.

    The first occurrence stays so that a text of many copies is not lost altogether. Documents are
    ordered by id (null first), then a hash of the text; a repeated row is the same document, so both keep the same
    lines. A null text is empty and stays, as nothing was dropped from it.
    """
    bitmaps = lines.line_bitmaps(docs, min_docs=10, keep_first=True)
    kept = lines.apply_bitmaps(docs, bitmaps, carried=("lang", "source"), with_text=True)
    text = F.col("kept_text").alias("text")
    return kept.where((F.col("n_dropped") == 0) | (F.length("kept_text") > 0)).select("doc_id", text, "lang", "source", F.length("kept_text").cast("bigint").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the least id, of each group that the n-gram Jaccard join links.

    The stage's similarity is 0.8 or more over shingles of five words. Null and empty texts and texts
    without words link with nothing and stay. Null ids come last in the choice; of rows with one id and
    different texts each is a document; repeated rows are one.
    """
    found = ngrams.NgramJoin(docs, n=5, limit=ngrams.Threshold(80, 100)).components()
    return ngrams.keep_one(docs.select(*COLUMNS), found)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes sources to target weights: each document's text becomes what the mix takes of it, repeats included.

    Documents that the mix takes nothing of go, among them all without words. A null source is a source;
    rows with one id, or repeated, are documents of their own.
    """
    taken = mixing.Mix(docs).texts(("lang", "source"))
    return taken.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the mixed texts and decodes them again; row by row, a null text as an empty one."""
    # Smaller dictionaries than alone: the workers of all stages share an executor's memory.
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), kept=100_000)


def _shipped(stage):
    return lambda spark, docs, sf_dir: stage(ship(spark), docs, sf_dir)


STAGES = [
    ("language", _shipped(language)),
    ("line_dedup", _shipped(line_dedup)),
    ("near_duplicates", _shipped(near_duplicates)),
    ("mix", _shipped(mix)),
    ("encode", _shipped(encode)),
]

#: The mix draws pseudorandom numbers, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
