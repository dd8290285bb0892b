"""Windows, completeness, score grids and edits of an assessment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.parts import dealt


def effective_window(tests: DataFrame, key: str, window: tuple[str, str], overrides: DataFrame) -> DataFrame:
    """(key, opens_at, closes_at): an override (key, opens_at, closes_at) replaces the class window outright, nulls included."""
    own = overrides.select(key, F.struct(F.col("opens_at").alias("opens_at"), F.col("closes_at").alias("closes_at")).alias("own"))
    whole = F.struct(F.col(window[0]).alias("opens_at"), F.col(window[1]).alias("closes_at"))
    return tests.select(key, whole.alias("class")).join(own, key, "left").select(key, F.coalesce("own", "class").alias("w")).select(key, "w.*")


def grading_complete(tests: DataFrame, key: str, answers: DataFrame, needs_grade: Column, graded: Column) -> DataFrame:
    """(key, complete): true unless an answer that needs a manual grade has none; vacuously true without answers."""
    open_ = answers.where(needs_grade & ~F.coalesce(graded, F.lit(False))).select(key).distinct().withColumn("open", F.lit(True))
    return tests.select(key).join(open_, key, "left").select(key, F.col("open").isNull().alias("complete"))


def score_grid(grades: DataFrame, student: str, test: str, tests: list[str], earned: Column, possible: Column) -> DataFrame:
    """One row per student, two columns per listed test; one pass, without collecting the tests' names."""
    cells = []
    for t in tests:
        here = F.col(test) == t
        cells += [F.sum(F.when(here, earned)).alias(f"{t}_earned"), F.sum(F.when(here, possible)).alias(f"{t}_possible")]
    return grades.groupBy(student).agg(*cells)


def matching_credit(pairs: Column, picks: Column, max_points: float) -> Column:
    """Correct pairs over all keyed pairs, times max_points, at four places; 0 without keyed pairs."""
    right = F.size(F.filter(F.map_keys(pairs), lambda k: F.coalesce(F.element_at(pairs, k) == F.element_at(picks, k), F.lit(False))))
    return F.when(F.size(pairs) > 0, F.round(right / F.size(pairs) * max_points, 4)).otherwise(0.0)


def overlay_rows(base: DataFrame, key: str, deletes: DataFrame, adds: DataFrame) -> DataFrame:
    """base without the deleted keys, and the adds whose key is not there after that; missing columns become null. Keys may repeat in each table: only sorts hold rows."""
    left = dealt(base, [key]).join(dealt(deletes.select(key), [key]), key, "left_anti")
    return left.unionByName(dealt(adds, [key]).join(left.select(key), key, "left_anti"), allowMissingColumns=True)


def changed_since(old: DataFrame, new: DataFrame, key: str, stamp: str) -> DataFrame:
    """(key, old_stamp, new_stamp) where the stamps differ; a row on one side only differs from a present stamp."""
    both = old.select(key, F.col(stamp).alias("old_stamp")).join(new.select(key, F.col(stamp).alias("new_stamp")), key, "full")
    return both.where(~F.col("old_stamp").eqNullSafe(F.col("new_stamp")))


def ordered_union(lists: list[DataFrame], key: str, order: str) -> DataFrame:
    """(key, source, ord): the distinct keys of several lists, each where it comes first by list and then by order."""
    parts = [rows.select(F.col(key).alias(key), F.struct(F.lit(k).alias("source"), F.col(order).alias("ord")).alias("at")) for k, rows in enumerate(lists)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(key).agg(F.min("at").alias("at")).select(key, "at.source", "at.ord")


def builder_pool(items: DataFrame, text: str, query: str, correct: Column, kept: DataFrame, key: str) -> DataFrame:
    """Items that contain the query in either case, are verified as correct and not kept already."""
    found = items.where(F.lower(F.coalesce(F.col(text), F.lit(""))).contains(query.lower()) & F.coalesce(correct, F.lit(False)))
    return found.join(kept.select(key), key, "left_anti")
