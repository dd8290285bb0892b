"""Lookups by text: topics by phrases of a taxonomy table, prices by prefixes of a price table, pages by the beginnings of items."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.text import OTHER

#: Phrases of a taxonomy, about, that one pass over the texts looks for.
PHRASES = 200_000
#: Characters of an item's beginning that a page must hold, and of the grams by which such beginnings are found.
NEEDLE, GRAM = 25, 8


def _topics(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        phrases: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for order, phrase, weight in shared.value:
            phrases[phrase].append((order, weight))
        always = phrases.pop("", [])
        automaton = ahocorasick.Automaton()
        for phrase in phrases:
            automaton.add_word(phrase, phrase)
        if phrases:
            automaton.make_automaton()
        for batch in batches:
            found = []
            for text in batch.column(batch.schema.get_field_index("_low")).to_pylist():
                score: dict[int, int] = defaultdict(int)
                for phrase in {p for _, p in automaton.iter(text)} if phrases and text else ():
                    for order, weight in phrases[phrase]:
                        score[order] += weight
                for order, weight in always:
                    score[order] += weight
                found.append([{"ord": o, "score": s} for o, s in score.items()])
            kind = pa.list_(pa.struct([("ord", pa.int32()), ("score", pa.int64())]))
            yield pa.record_batch([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, "_found"])

    return run


def classify_by_table(rows: DataFrame, text: str, keywords: DataFrame, name: str = "topic", other: str = OTHER) -> DataFrame:
    """rows with the topic whose contained phrases weigh most; the first declared (topic_ord) wins ties, no phrase at all gives other.

    keywords: topic, topic_ord, phrase, weight; a phrase that a text contains counts once a mention in keywords, whatever its case. One automaton finds all phrases in one
    pass over a text, so a large taxonomy costs no more than a small one; beyond PHRASES the taxonomy goes in blocks, a pass each, and scores are added in the
    row. A null text is other. No shuffle of rows.
    """
    session = rows.sparkSession
    table = keywords.select(F.col("topic_ord").cast("int").alias("ord"), F.lower("phrase").alias("phrase"), F.col("weight").cast("long").alias("weight")).where("phrase is not null")
    blocks = max(1, -(-table.count() // PHRASES))
    out = rows.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit("")))).withColumn("_scores", F.array().cast("array<struct<ord:int,score:bigint>>"))
    for block in range(blocks):
        phrases = [tuple(r) for r in table.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == block).collect()]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema) + ", `_found` array<struct<ord:int,score:bigint>>"
        out = out.mapInArrow(_topics(session.sparkContext.broadcast(phrases)), schema).withColumn("_scores", F.concat("_scores", "_found")).drop("_found")
    orders = F.array_distinct(F.transform("_scores", lambda s: s["ord"]))
    summed = F.transform(orders, lambda o: F.struct(F.aggregate(F.filter("_scores", lambda s: s["ord"] == o), F.lit(0).cast("long"), lambda acc, s: acc + s["score"]).alias("score"), (-o).alias("place")))
    best = F.array_max(F.transform(F.array(summed), lambda x: F.array_max(x)))
    topics = keywords.groupBy(F.col("topic_ord").cast("int").alias("_ord")).agg(F.first("topic").alias("_topic"))
    # a taxonomy has few topics, however many phrases; Spark broadcasts their names if they are small
    named = out.withColumn("_best", best).withColumn("_ord", F.when(F.col("_best.score") > 0, -F.col("_best.place"))).join(topics, "_ord", "left")
    return named.select(*rows.columns, F.coalesce("_topic", F.lit(other)).alias(name))


def price_by_table(usage: DataFrame, model: str, prices: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """usage with the columns of defaults: those of the first listed row (ord) of prices (prefix, ord, columns) whose prefix opens the model's name, else the defaults.

    Every distinct model is met by its own prefixes in an equi-join, so the price table may be long; then each model has one row. A null model
    has the defaults.
    """
    names = usage.select(F.col(model).alias("_model")).where("_model is not null").distinct()
    opened = names.select("_model", F.explode(F.expr("transform(sequence(0, length(_model)), k -> left(_model, k))")).alias("prefix"))
    first = opened.join(prices, "prefix").groupBy("_model").agg(F.min_by(F.struct(*defaults), "ord").alias("_price"))
    priced = usage.join(first, F.col(model) == F.col("_model"), "left")
    return priced.select(*usage.columns, *[F.coalesce(F.col("_price")[c], F.lit(v)).alias(c) for c, v in defaults.items()])


def _anchors(texts: list[str], whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the least gram of every run of NEEDLE characters of a text; whole: of the text's first run alone. Runs of equal text have one least gram."""
    rows, hashes, runs = [], [], NEEDLE - GRAM + 1
    for k, text in enumerate(texts):
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        if len(code) < NEEDLE:
            continue
        gram = np.zeros(len(code) - GRAM + 1, dtype=np.uint64)
        for j in range(GRAM):
            gram = (gram * np.uint64(0x9E3779B97F4A7C15)) ^ (code[j : j + len(gram)] + np.uint64(1))
        gram = (gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        gram ^= gram >> np.uint64(32)
        own = gram[:runs].min(keepdims=True) if whole else np.unique(np.lib.stride_tricks.sliding_window_view(gram, runs).min(axis=1))
        rows.append(np.full(len(own), k))
        hashes.append(own)
    return (np.concatenate(rows), np.concatenate(hashes).view(np.int64)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


def _anchored(whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, h = _anchors([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()], whole)
            at = pa.array(row)
            yield pa.record_batch([*(batch.column(k).take(at) for k in range(batch.num_columns - 1)), pa.array(h)], names=[*batch.schema.names[:-1], "h"])

    return run


def pages_with(items: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, at, page): the pages (doc, page, text) of an item's own document that hold its needle (doc, at, needle; NEEDLE characters at most, not empty).

    Pages are indexed by the least gram of each run of NEEDLE characters, about a tenth of their length, and needles by their own: equal runs have equal ones, so
    items meet only pages with it, and the text decides. Needles shorter than NEEDLE meet all pages of their document.
    """
    kind = lambda d, names: ", ".join(f"{c} {d.schema[c].dataType.simpleString()}" for c in names)
    long_ = items.where(F.length("needle") == NEEDLE)
    held = pages.select("doc", "page", "text").mapInArrow(_anchored(False), f"{kind(pages, ('doc', 'page'))}, h long")
    asked = long_.select("doc", "at", F.col("needle").alias("own"), "needle").mapInArrow(_anchored(True), f"{kind(items, ('doc', 'at'))}, own string, h long").withColumnRenamed("own", "needle")
    met = asked.join(held, ["doc", "h"]).select("doc", "at", "needle", "page").distinct()
    met = met.union(items.where(F.length("needle") < NEEDLE).join(pages.select("doc", "page"), "doc").select("doc", "at", "needle", "page"))
    return met.join(pages.select("doc", "page", "text"), ["doc", "page"]).where(F.contains("text", "needle")).select("doc", "at", "page")


def needle(text: Column) -> Column:
    """What of an item is looked for: the first NEEDLE characters of its first 40, trimmed."""
    return F.substring(F.trim(F.substring(F.coalesce(text, F.lit("")), 1, 40)), 1, NEEDLE)
