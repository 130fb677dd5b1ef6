"""The folder that driver and executors share, and tables in it that cut a lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, as a URI.

    Where that is unset and all runs in one process (tests on one machine) a temporary folder takes
    its place; a cluster must name one, as its executors see nothing of each other's disks.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="millrace-"))
    return re.sub(r"^file:/(?!//)", "file:///", sc.getCheckpointDir())


def cut(df: DataFrame, what: str = "table") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again; it is computed once and outlives any executor."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
