"""As-of and interval assignment, newest-n, patch merge, prefix lookup, facets and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(rows: DataFrame, key: str, order: list[str], is_anchor: Column, anchor_value: Column, slice_of: Column | None = None) -> DataFrame:
    """rows with anchor: the value of the last anchor row at or before each.

    slice_of, which must not fall along order, cuts a key into slices that are sorted each; the last anchor of a slice, a row
    of a small aggregate, is carried into the later ones. Without it a key is one sort.
    """
    value = F.when(is_anchor, anchor_value)
    whole = rows.select(F.struct("*").alias("row"), F.col(key).alias("k"), (F.lit(0) if slice_of is None else slice_of).alias("slice"), F.struct(*order).alias("by"), value.alias("value"))
    within = Window.partitionBy("k", "slice").orderBy("by").rowsBetween(Window.unboundedPreceding, 0)
    own = whole.withColumn("own", F.last("value", ignorenulls=True).over(within))
    if slice_of is None:
        return own.select("row.*", F.col("own").alias("anchor"))
    ends = whole.groupBy("k", "slice").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("by"))).alias("end"))
    earlier = Window.partitionBy("k").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("k").alias("of"), F.col("slice").alias("at"), F.last("end", ignorenulls=True).over(earlier).alias("carried"))
    joined = own.join(carried, F.col("k").eqNullSafe(F.col("of")) & F.col("slice").eqNullSafe(F.col("at")))
    return joined.select("row.*", F.coalesce("own", "carried").alias("anchor"))


def newest_per_key(rows: DataFrame, key: str, newest_first: list[Column], n: int) -> DataFrame:
    """The n newest rows of each key, with their rank; Spark limits each group before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*newest_first))).where(F.col("rank") <= n)


def patch_merge(feed: DataFrame, key: str, order: Column, fields: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Per key and field, the value of the last row in which the field is present; a present null overwrites."""
    held = [F.max_by(F.struct(value.alias("v")), F.when(present, order))["v"].alias(name) for name, (present, value) in fields.items()]
    return feed.groupBy(key).agg(*held)


def prefix_price(model: Column, prices: list[tuple[str, float]], default: float) -> Column:
    """The price of the first listed prefix that opens the model's name."""
    out = None
    for prefix, price in prices:
        out = F.when(model.startswith(prefix), price) if out is None else out.when(model.startswith(prefix), price)
    return F.lit(default) if out is None else out.otherwise(default)


def new_only(batch: DataFrame, bank: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the batch whose key the bank does not have, how many were skipped); rows without a key always pass."""
    known = bank.select(F.col(key).alias("known")).distinct()
    fresh = batch.join(known, F.col(key) == F.col("known"), "left_anti")
    return fresh, batch.join(known, F.col(key) == F.col("known"), "left_semi").agg(F.count("*").alias("skipped"))


def facets(rows: DataFrame, by: dict[str, Column]) -> DataFrame:
    """(facet, value, n) of several columns at once: one pass over the rows, partial counts before the shuffle."""
    pairs = F.array(*[F.struct(F.lit(name).alias("facet"), column.cast("string").alias("value")) for name, column in by.items()])
    return rows.select(F.explode(pairs).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n")).where("value is not null")


def trailing_limit(rows: DataFrame, key: str, ts: str, seconds: int, limit: int, is_failure: Column | None = None, is_success: Column | None = None, exclusive: bool = False) -> DataFrame:
    """rows with recent (failures of the key in the trailing seconds since its last success, the row's own included) and
    blocked (recent >= limit). A success clears the failures up to its own time; without the two columns every row is a failure. A failure just
    seconds old counts, unless exclusive.

    A key is cut into slices of the window's width. Each slice takes its predecessor's failures and successes along, which
    are all that its windows reach, so no success before them matters and a hot key is as many tasks as it has slices.
    """
    width = seconds * 1_000_000
    failed = F.lit(1) if is_failure is None else F.coalesce(is_failure, F.lit(False)).cast("int")
    cleared = F.lit(0) if is_success is None else F.coalesce(is_success, F.lit(False)).cast("int")
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    own = rows.select(F.struct("*").alias("row"), F.col(key).alias("k"), us.alias("us"), failed.alias("failed"), cleared.alias("cleared"))
    own = own.withColumn("slice", F.floor(F.col("us") / width))
    before = own.where("slice is not null and (failed = 1 or cleared = 1)").groupBy("k", "us", "slice").agg(F.sum("failed").alias("failed"), F.max("cleared").alias("cleared"))
    before = before.withColumn("slice", F.col("slice") + 1)
    both = own.withColumn("own", F.lit(True)).unionByName(before.withColumn("own", F.lit(False)), allowMissingColumns=True)
    by = Window.partitionBy("k", "slice").orderBy("us")
    upto = by.rangeBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"trailing": F.sum("failed").over(by.rangeBetween(int(exclusive) - width, 0)), "upto": F.sum("failed").over(upto)})
    both = both.withColumn("at_success", F.max(F.when(F.col("cleared") == 1, F.col("upto"))).over(upto))
    recent = F.least("trailing", F.col("upto") - F.coalesce("at_success", F.lit(0)))
    return both.withColumn("recent", recent).where("own").select("row.*", "recent").withColumn("blocked", F.col("recent") >= limit)
