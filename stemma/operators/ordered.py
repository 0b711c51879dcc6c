"""Operators on ordered rows: windows in place of sequential scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_last(rows: DataFrame, keys: Sequence[str], order: str, column: str, out: str) -> DataFrame:
    """The last non-null value so far, as of a caption or header."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(column, ignorenulls=True).over(w))


def hierarchy_fill(rows: DataFrame, keys: Sequence[str], order: str, rank: str, name: str, ranks: Sequence[str]) -> DataFrame:
    """A column for each rank with its current name: a header of one rank ends the names of that rank and those below.

    For each rank the last header at or above it decides; its name counts only if it is of that very rank.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    level = F.array_position(F.array(*map(F.lit, ranks)), F.col(rank))
    out = rows.withColumn("_level", level)
    for i, r in enumerate(ranks, 1):
        last = F.last(F.when(F.col("_level") <= i, F.struct("_level", name)), ignorenulls=True).over(w)
        out = out.withColumn(r, F.when(last["_level"] == i, last[name]))
    return out.drop("_level")


def following(rows: DataFrame, keys: Sequence[str], order: str, column: str, out: str, within: int) -> DataFrame:
    """The next row's value if it lies at most `within` steps of the order ahead."""
    w = Window.partitionBy(*keys).orderBy(order)
    near = F.lead(order).over(w) - F.col(order) <= within
    return rows.withColumn(out, F.when(near, F.lead(column).over(w)))


def run_lengths(rows: DataFrame, keys: Sequence[str], order: str, flag: str, out: str) -> DataFrame:
    """How many rows in a row, up to this one, have the flag."""
    w = Window.partitionBy(*keys).orderBy(order)
    breaks = F.sum(F.when(F.col(flag), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out_rows = rows.withColumn("_run", breaks)
    return out_rows.withColumn(out, F.count_if(F.col(flag)).over(Window.partitionBy(*keys, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))).drop("_run")


def before_end(rows: DataFrame, keys: Sequence[str], order: str, ends: Column) -> DataFrame:
    """Rows before the first that ends the table."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("_end", F.min(F.when(ends, F.col(order))).over(w)).where(F.col("_end").isNull() | (F.col(order) < F.col("_end"))).drop("_end")


def between_captions(rows: DataFrame, keys: Sequence[str], order: str, starts: Column, ends: Column) -> DataFrame:
    """Rows after the first that starts the region and before the next that ends it."""
    w = Window.partitionBy(*keys)
    begun = rows.withColumn("_start", F.min(F.when(starts, F.col(order))).over(w)).where(F.col(order) > F.col("_start"))
    return before_end(begun.drop("_start"), keys, order, ends)


def numbered(rows: DataFrame, order: Sequence[Column | str], out: str) -> DataFrame:
    """Row numbers from 0 in an overall order, without one task seeing all rows: rows are ranged, ranges counted, numbers shifted."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id() % (1 << 33))
    sizes = ranged.groupBy("_part").agg(F.max("_in").alias("n"))
    # One row for each partition.
    before = sizes.withColumn("_base", F.coalesce(F.sum(F.col("n") + 1).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranged.join(F.broadcast(before.drop("n")), "_part").withColumn(out, F.col("_base") + F.col("_in")).drop("_part", "_base", "_in")
