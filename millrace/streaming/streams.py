"""Structured Streaming forms of the batch operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def files(spark: SparkSession, path: str, schema, fmt: str = "parquet", per_trigger: int = 10, **options) -> DataFrame:
    """New files of a folder as a stream; ``per_trigger`` bounds what a micro-batch takes."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_trigger)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(path)


def bucket_averages(samples: DataFrame, ts: str, bucket: str, value: str, *groups: str, late: str = "1 day") -> DataFrame:
    """Averages by tumbling window; rows later than ``late`` are not waited for."""
    timed = samples.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", bucket).alias("w"), *groups).agg(F.count("*").alias("n"), F.avg(value).alias("average"), F.max(value).alias("peak")).select(F.col("w.start").alias("bucket"), *groups, "n", "average", "peak")


def curated(docs: DataFrame, passed: Column) -> DataFrame:
    """Documents of a stream that pass a validator."""
    return docs.where(passed)


def latest_by(rows: DataFrame, key: str, ts: str, *values: str) -> DataFrame:
    """The latest values of each key."""
    return rows.groupBy(key).agg(F.max(ts).alias(ts), *(F.max_by(v, ts).alias(v) for v in values))


def run_available(stream: DataFrame, sink: str, checkpoint: str, fmt: str = "parquet", mode: str = "append") -> StreamingQuery:
    """Processes all there is, once, into files, and resumes from ``checkpoint`` the next time."""
    query = stream.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    query.awaitTermination()
    return query


def run_to_table(stream: DataFrame, sink: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Runs an aggregating stream in update mode and keeps each batch's rows under the batch's number, so a repeated batch replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/batch={number:08d}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return query


def current(spark: SparkSession, sink: str, keys: list[str]) -> DataFrame:
    """The latest state of each key in what :func:`run_to_table` wrote."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(sink)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return latest.select(*keys, "v.*")
