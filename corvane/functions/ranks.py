"""Ranks and running totals in two levels: range sorts deal rows out, and a row per task carries what stands before it. No key's rows meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.storage import written


def _laid(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows in ranges of order, sorted, as a table; _at grows along the order, _part is the range."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return written(sorted_.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "laid")


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """rows with their rank from 1 among rows of equal keys (not null), by order, nulls first. Writes a table when called, which the result reads."""
    laid = _laid(rows, [*keys, *order])
    spans = laid.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    placed = laid.join(spans, [*keys, "_part"]).withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1)
    return placed.select(*rows.columns, name)


def running_total(rows: DataFrame, order: list[str], value: str, name: str = "before") -> DataFrame:
    """rows with the sum of value over all rows before them by order. Writes a table when called, which the result reads."""
    laid = _laid(rows, order)
    sums = laid.groupBy("_part").agg(F.sum(value).alias("_sum"))
    # a row per range
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    within = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return laid.withColumn("_within", within).join(offsets, "_part").withColumn(name, F.col("_offset") + F.col("_within")).select(*rows.columns, name)
