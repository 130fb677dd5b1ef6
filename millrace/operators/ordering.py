"""Global order without a single task: rows are dealt by ranges, and ranges are put together by small tables.

A table in ranges is stored, with ``_part`` (the range) and ``_at`` (the row's place, in order of
all rows). What one range has to know of those before it (how many rows, the last value, the
greatest so far) is a row a range, hence a table of as many rows as there are partitions: a window
over all of it and its broadcast are bounded by that number.

Names that begin with an underscore are the engine's own; a column of that name in the input is an
error of the caller. Null values of an order come first, as in Spark's ascending order; equal rows
are in any order. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.storage import cut


def in_ranges(df: DataFrame, order: list) -> DataFrame:
    """``df`` stored in ranges of ``order`` (columns or sort orders), with ``_part`` and ``_at``."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return cut(placed.withColumn("_part", F.shiftright("_at", 33)), "ranges")


def before(placed: DataFrame, **aggregates: tuple[Column, str]) -> DataFrame:
    """A row a range: for each name an aggregate of all ranges before it, put together by ``sum``, ``max`` or ``last``."""
    own = placed.groupBy("_part").agg(*(c.alias(f"_{n}") for n, (c, _) in aggregates.items()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    over = {"sum": lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0)), "max": lambda c: F.max(c).over(earlier), "last": lambda c: F.lag(c).over(Window.orderBy("_part"))}
    return own.select("_part", *(over[how](f"_{n}").alias(n) for n, (_, how) in aggregates.items()))


def with_before(placed: DataFrame, **aggregates: tuple[Column, str]) -> DataFrame:
    """``placed`` with the columns of :func:`before`; a row a partition is broadcast."""
    return placed.join(F.broadcast(before(placed, **aggregates)), "_part")


def numbered(df: DataFrame, order: list, name: str = "number") -> DataFrame:
    """Adds the row's number in ``order``, from 1."""
    placed = with_before(in_ranges(df, order), _rows=(F.count("*"), "sum"))
    return placed.withColumn(name, F.col("_rows") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_rows", "_at", "_part")


def lagged(placed: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the value of ``column`` in the row before, over all ranges; null in the first row."""
    rows = with_before(placed, _last=(F.max_by(F.struct(column), "_at"), "last"))
    within = Window.partitionBy("_part").orderBy("_at")
    first = F.row_number().over(within) == 1
    return rows.withColumn(name, F.when(first, F.col("_last").getField(column)).otherwise(F.lag(column).over(within))).drop("_last")


def running_max(placed: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the greatest value of ``column`` up to each row, over all ranges."""
    rows = with_before(placed, _most=(F.max(column), "max"))
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.greatest(F.col("_most"), F.max(column).over(within))).drop("_most")
