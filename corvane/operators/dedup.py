"""Key dedup and similarity to a bank by word n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.storage import written


def first_per_key(rows: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """The row that comes first by order of each key; an aggregation, so one hot key is combined before the shuffle."""
    named = {f"k{k}": c for k, c in enumerate(keys)}
    packed = rows.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in named.items()], F.col(order).alias("by"))
    return packed.groupBy(*named).agg(F.min_by("row", "by").alias("row")).select("row.*")


#: Runs of Unicode word characters, and runs of anything but white space.
WORD, SPACED = r"[\p{L}\p{N}_]+", r"[^ \t\n\r]+"


def word_shingles(text: Column, n: int = 3, word: str = WORD) -> Column:
    """The distinct runs of n lower-case words; with fewer words, the words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(word), F.lit(0))

    def runs(w: Column) -> Column:
        joined = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda k: F.array_join(F.slice(w, k, n), " "))
        return F.array_distinct(F.when(F.size(w) < n, w).otherwise(joined))

    # bound as a lambda's variable, the words are split once a row and not once a run
    return F.transform(F.array(words), runs)[0]


def hashed_shingles(text: Column, n: int = 3, word: str = WORD) -> Column:
    """word_shingles as sorted 64-bit hashes, without building their texts."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(word), F.lit(0))

    def runs(w: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda k: F.xxhash64(*[F.get(w, k + i) for i in range(n)]))
        return F.sort_array(F.array_distinct(F.when(F.size(w) < n, F.transform(w, lambda x: F.xxhash64(x))).otherwise(whole)))

    return F.transform(F.array(words), runs)[0]


#: A bank of at most so many shingles goes to every executor, so that documents' shingles are not shuffled; beyond, both sides are.
BROADCAST_SHINGLES = 1_000_000


def duplicate_of_bank(docs: DataFrame, bank: DataFrame, threshold: float = 0.4, n: int = 3, word: str = WORD) -> DataFrame:
    """doc_id, similarity, matched: the first bank item (by id) at the threshold or above, else the most similar one, if any
    shares a shingle. Pairs come from a join on shingles, never from all of docs and bank; shingles are equal when their 64-bit hashes are.

    The bank's sets are a table, counted when called to choose between sending them everywhere and shuffling. A shingle that very many documents
    have is one row of each, met by the bank's few; where both sides are shuffled, Spark splits such a key's rows.
    """
    sets = written(bank.select("item_id", hashed_shingles(F.col("text"), n, word).alias("s")), "bank")
    # explode_outer: for explode, the optimizer would ask for non-empty arrays below the projection and make every set twice
    theirs = sets.select("item_id", F.size("s").alias("nb"), F.explode("s").alias("h"))
    if theirs.count() <= BROADCAST_SHINGLES:
        theirs = F.broadcast(theirs)
    mine = docs.select("doc_id", hashed_shingles(F.col("text"), n, word).alias("s")).select("doc_id", F.size("s").alias("nd"), F.explode_outer("s").alias("h"))
    pairs = mine.join(theirs, "h").groupBy("doc_id", "item_id", "nd", "nb").agg(F.count("*").alias("k"))
    pairs = pairs.withColumn("sim", F.col("k") / (F.col("nd") + F.col("nb") - F.col("k")))
    over = F.col("sim") >= threshold
    rank = F.struct(over.cast("int"), F.when(over, 0.0).otherwise(F.col("sim")), -F.col("item_id"))
    best = pairs.groupBy("doc_id").agg(F.max_by(F.struct("item_id", "sim"), rank).alias("m"))
    return docs.select("doc_id").join(best, "doc_id", "left").select(
        "doc_id", F.coalesce(F.col("m.sim") >= threshold, F.lit(False)).alias("duplicate"), F.col("m.item_id").alias("matched"), F.round(F.coalesce("m.sim", F.lit(0.0)), 6).alias("similarity")
    )
