"""Choice grading, score totals and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def choice_points(pick: Column, key: Column) -> Column:
    """1 where the trimmed upper-case pick is the first character of the trimmed upper-case key, else 0; an empty pick or key gives 0."""
    return F.when((F.upper(F.trim(pick)) == F.substring(F.upper(F.trim(key)), 1, 1)) & (F.trim(pick) != ""), 1).otherwise(0)


def score_totals(grades: DataFrame, keys: list[str], auto: Column, manual: Column, possible: Column) -> DataFrame:
    """earned (automatic points shadow manual ones) and possible per key."""
    return grades.groupBy(*keys).agg(F.sum(F.coalesce(auto, manual, F.lit(0.0))).alias("earned"), F.sum(possible).alias("possible"))


def verdict(text: Column, status: Column) -> Column:
    """A blank text is unavailable; a status outside the three known ones is uncertain."""
    known = F.lower(status).isin("correct", "incorrect", "uncertain")
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "unavailable").when(known, F.lower(status)).otherwise("uncertain")
