"""What the operators of this subpackage share: shared storage and Arrow plumbing.

Tables that cut a lineage are written to the folder that the cluster names in
``spark.checkpoint.dir``, so every executor and the driver can read them and a lost
executor costs a retry, never data.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of anything but ASCII white space; Java reads ``\\x0B`` in a class as is.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI.

    It is the one of ``spark.checkpoint.dir``. Where that is unset and all runs in one process (tests
    on one machine) a temporary folder takes its place; a cluster must name one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="millrace-"))
    return re.sub(r"^file:/(?!//)", "file:///", sc.getCheckpointDir())


def shared_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: a cut in the lineage.

    It is the one to use for tables that several later steps read, as it is computed once and
    outlives any executor.
    """
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def releasing(work: Work) -> Work:
    """``work`` that gives the memory it has freed back to the system when a task ends.

    Worker processes live on after a task, beside those of the executor's other tasks; what their
    allocators keep for later would count against the next stage.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that ``column`` (text or binary) holds about ``most`` bytes in each.

    A single value over ``most`` bytes is a slice of its own; no row is lost or split.
    """
    for batch in batches:
        at, n = 0, batch.num_rows
        if batch.nbytes <= most:
            if n:
                yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        while at < n:
            end, held = at, 0
            while end < n and (end == at or held + sizes[end] <= most):
                held += sizes[end]
                end += 1
            yield batch.slice(at, end - at)
            at = end


def id_type(df: DataFrame, column: str) -> str:
    """The SQL type of a column, for output schemas that carry it on."""
    return df.schema[column].dataType.simpleString()


def text_bytes(column) -> F.col:
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(column, F.lit("")).cast("binary")
