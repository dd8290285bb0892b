"""Rows dealt into a set number of partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows by their keys in as many partitions as shuffles have, for joins by these keys. Partitions that Spark chooses are put together by their packed bytes; sorted keys
    pack so well that one task would get many times the rows."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
