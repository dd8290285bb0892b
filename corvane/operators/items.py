"""Records from lines, chunks, numbers and stable orders of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segment_records(lines: DataFrame, key: str, order: str, line: str, start: str, stop: str, least_body: int = 9) -> DataFrame:
    """(key, record_no, n_lines, body): a line matching start opens a record, the lines after it are its body.

    From the first line matching stop on, a document gives nothing; lines before its first record are left out, as are
    records with a body under least_body characters. record_no counts the opened records from 1.
    """
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    text = F.coalesce(F.col(line), F.lit(""))
    numbered = lines.select(
        key, F.col(order).alias("at"), text.alias("line"),
        F.sum(text.rlike(start).cast("int")).over(upto).alias("record_no"), F.max(text.rlike(stop)).over(upto).alias("over"),
    ).where("record_no > 0 and not over")
    records = numbered.groupBy(key, "record_no").agg(
        F.count("*").alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("body")
    )
    return records.where(F.length("body") >= least_body)


def greedy_chunks(docs: DataFrame, key: str, text: str, separator: str, most: int) -> DataFrame:
    """(key, chunk_no, chunk): paragraphs are appended while the chunk stays within most characters, separator included.

    A longer paragraph stands alone; empty paragraphs are left out; a null text gives no chunk.
    """
    parts = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), separator), lambda p: p != "")
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("cur"))

    def step(s: Column, p: Column) -> Column:
        fits = F.length(s["cur"]) + len(separator) + F.length(p) <= most
        return (
            F.when(s["cur"].isNull(), F.struct(s["done"].alias("done"), p.alias("cur")))
            .when(fits, F.struct(s["done"].alias("done"), F.concat(s["cur"], F.lit(separator), p).alias("cur")))
            .otherwise(F.struct(F.concat(s["done"], F.array(s["cur"])).alias("done"), p.alias("cur")))
        )

    chunks = F.aggregate(parts, state, step, lambda s: F.when(s["cur"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["cur"]))))
    return docs.select(key, F.posexplode(chunks).alias("chunk_no", "chunk"))


def next_number(rows: DataFrame, key: str, number: Column) -> DataFrame:
    """(key, next_number): one above the largest numeric part; numbers without one are ignored, none at all gives 1."""
    numeric = F.regexp_replace(number, "[a-z]+$", "").try_cast("int")
    return rows.groupBy(key).agg((F.coalesce(F.max(numeric), F.lit(0)) + 1).alias("next_number"))


def running_number(rows: DataFrame, groups: list[Column], within: list[Column]) -> DataFrame:
    """rows with running: 1, 2, ... by groups and then by within.

    The window is cut by groups; where a group starts comes from the counts per group, so only these, a row
    per group, are numbered in one task.
    """
    names = [f"by{k}" for k in range(len(groups))]
    keyed = rows.select(F.struct("*").alias("row"), *[c.alias(n) for c, n in zip(groups, names, strict=True)], *[c.alias(f"in{k}") for k, c in enumerate(within)])
    before = Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy(*names).agg(F.count("*").alias("n")).select(F.struct(*names).alias("at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy(*names).orderBy(*[f"in{k}" for k in range(len(within))]))
    numbered = keyed.withColumn("nth", nth).withColumn("at", F.struct(*names))
    return numbered.join(starts.withColumnRenamed("at", "of"), F.col("at").eqNullSafe(F.col("of"))).select("row.*", (F.col("nth") + F.col("start")).alias("running"))


def stable_order(rows: DataFrame, taker: str, number: str) -> DataFrame:
    """rows with place: each taker's own order of the questions, the same on every run."""
    mixed = F.md5(F.concat_ws(":", F.col(taker).cast("string"), F.col(number).cast("string")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(taker).orderBy(mixed, number)))


def context_anchor(rows: DataFrame, order: str, known_context: Column) -> DataFrame:
    """rows with anchor: the smallest order of the rows of the same context; without a context, its own.

    An aggregation and a join instead of a window, so a hot context is combined before the shuffle.
    """
    keyed = rows.withColumn("context", known_context)
    first = keyed.where("context is not null").groupBy("context").agg(F.min(order).alias("anchor"))
    return keyed.join(first, "context", "left").withColumn("anchor", F.coalesce("anchor", order)).drop("context")
