"""Scans over ordered groups of any size: rows are dealt by key ranges, and a row for each range and group says what lies before.

A group, even a single one that holds all rows, is thus spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

PART, PLACE = "_part", "_place"


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left and right's other columns, joined where the keys are the same, null with null."""
    own = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    out = left.join(own, [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys], how)
    return out.drop(*[f"_same_{k}" for k in keys])


def dealt(df: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    """df as a table in the shared folder, by ranges of (by, order): PART is a row's range, PLACE its place there.

    Rows that are equal in all of order lie in one range; add a column that tells them apart where there may be many.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = [*by, *order]
    rows = df.repartitionByRange(n, *ordered).sortWithinPartitions(*ordered)
    # the number within a partition of the sorted rows; its upper bits are the partition
    rows = rows.withColumn(PLACE, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).withColumn(PART, F.spark_partition_id())
    return written(rows, "dealt")


def numbered(parts: DataFrame, by: list[str], out: str) -> DataFrame:
    """Add each row's number within its group, from 1, to a dealt table. PART stays."""
    ends = parts.groupBy(*by, PART).agg(F.count(F.lit(1)).alias("_n"), F.min(PLACE).alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a written table's size is known, so rows aren't shuffled to meet a few
    ends = written(ends.select(*by, PART, (before - F.col("_first") + 1).alias("_shift")), "ends")
    return join_same(parts, ends, [*by, PART]).withColumn(out, F.col(PLACE) + F.col("_shift")).drop(PLACE, "_shift")


def summed_before(parts: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Add the sum of value over the rows before each row of its group to a dealt table. PART and PLACE go."""
    inside = F.coalesce(F.sum(value).over(Window.partitionBy(*by, PART).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = parts.groupBy(*by, PART).agg(F.sum(value).alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*by, PART, before.alias("_before"))
    return join_same(parts.withColumn(out, inside), sums, [*by, PART]).withColumn(out, F.col(out) + F.col("_before")).drop(PART, PLACE, "_before")


def least_from_here(numbers: DataFrame, by: list[str], number: str, value: str, out: str) -> DataFrame:
    """Add the least value from each row to its group's end to a numbered table that still has PART. PART goes."""
    inside = F.min(value).over(Window.partitionBy(*by, PART).orderBy(F.col(number).desc()).rowsBetween(Window.unboundedPreceding, 0))
    least = numbers.groupBy(*by, PART).agg(F.min(value).alias("_m"))
    after = F.min("_m").over(Window.partitionBy(*by).orderBy(F.col(PART).desc()).rowsBetween(Window.unboundedPreceding, -1))
    least = least.select(*by, PART, after.alias("_after"))
    return join_same(numbers.withColumn(out, inside), least, [*by, PART]).withColumn(out, F.least(out, "_after")).drop(PART, "_after")


def mean_ranks(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """(by, value, out): the mean rank of each value among its group's, from running counts over the distinct values."""
    values = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = summed_before(dealt(values, by, [value]), by, "_n", "_below")
    return ranked.select(*by, value, (F.col("_below") + (F.col("_n") + 1) / 2.0).alias(out))
