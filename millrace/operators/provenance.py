"""Where items come from: stamps, tags, and the sources of merged items.

Provenance is a struct (source_file, chunk_index, model, prompt_type, timestamp, merged_from). Null
provenance means none. Lists of sources keep the order in which they were first seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROVENANCE = "struct<source_file:string,chunk_index:bigint,model:string,prompt_type:string,timestamp:string,merged_from:array<string>>"
#: Columns that name an item's source, which an export may leave out.
SOURCE_FIELDS = ("source_file", "generated_at", "provenance")


def stamped(items: DataFrame, source_file: Column, generated_at: Column) -> DataFrame:
    """Adds source_file and generated_at where an item has none yet."""
    known = lambda name, kind: F.col(name) if name in items.columns else F.lit(None).cast(kind)
    return items.withColumns({"source_file": F.coalesce(known("source_file", "string"), source_file), "generated_at": F.coalesce(known("generated_at", "string"), generated_at)})


def unstamped(items: DataFrame) -> DataFrame:
    """Items without the columns of ``SOURCE_FIELDS``."""
    return items.drop(*SOURCE_FIELDS)


def tagged(items: DataFrame, **fields: Column) -> DataFrame:
    """Adds provenance from the given fields where an item has none yet."""
    names = ("source_file", "chunk_index", "model", "prompt_type", "timestamp", "merged_from")
    own = F.struct(*(fields.get(n, F.lit(None)).alias(n) for n in names)).cast(PROVENANCE)
    return items.withColumn("provenance", F.coalesce(F.col("provenance"), own) if "provenance" in items.columns else own)


def sources(removed: DataFrame, keeper: str, order: str, provenance: str = "provenance") -> DataFrame:
    """(keeper, merged_from): the sources of the items removed in favour of each kept one, in the order of removal.

    An item's own source comes before those merged into it. Sources are made distinct before they
    are gathered, so a row is no longer than the list of its sources.
    """
    p = F.col(provenance)
    listed = F.concat(F.array(p["source_file"]), F.coalesce(p["merged_from"], F.array().cast("array<string>")))
    rows = removed.where(p.isNotNull()).select(F.col(keeper).alias("keeper"), F.col(order).alias("o"), F.posexplode(listed).alias("at", "source"))
    first = rows.where("source IS NOT NULL").groupBy("keeper", "source").agg(F.min(F.struct("o", "at")).alias("first"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first", "source"))), lambda x: x["source"])
    return first.groupBy("keeper").agg(ordered.alias("merged_from"))


def merged(kept: DataFrame, removed: DataFrame, item_id: str, keeper: str, order: str) -> DataFrame:
    """``kept`` with the sources of ``removed`` added to its provenance; a kept item without provenance takes that of its first removed one."""
    gathered = sources(removed, keeper, order).withColumnRenamed("keeper", "_keeper").withColumnRenamed("merged_from", "_more")
    first = removed.where(F.col("provenance").isNotNull()).groupBy(F.col(keeper).alias("_of")).agg(F.min_by("provenance", order).alias("_first"))
    rows = kept.join(gathered, F.col(item_id) == F.col("_keeper"), "left").join(first, F.col(item_id) == F.col("_of"), "left")
    own = F.coalesce("provenance", "_first")
    union = F.array_distinct(F.concat(F.coalesce(F.col("provenance")["merged_from"], F.array().cast("array<string>")), F.col("_more")))
    return rows.withColumn("provenance", F.when(F.col("_more").isNull(), F.col("provenance")).otherwise(own.withField("merged_from", union))).select(*kept.columns)
