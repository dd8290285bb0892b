"""N-gram Jaccard join by grouped prefixes: groups of equal prefix and size are paired, expanded and verified."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import by_bytes, clean, connected_components, materialize, mix, remove, shingle_sets

#: Shingles are counted in so many buckets: the table of counts, 2 MB, is the same size for any corpus.
BUCKETS = 1 << 18
#: 64-bit words of the parity bitmap of a set.
BITMAP_WORDS = 8
_HEADS = "doc_id long, n long, fp binary, h binary, prefix array<long>, bits array<long>, sketch array<long>"


def _count_buckets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            held, size = [], 0
            for _, keys in shingle_sets(batch.column(0), words):
                held.append((keys % np.uint64(BUCKETS)).astype(np.int64))
                size += len(keys)
                if size > 1 << 20:
                    counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
                    held, size = [], 0
            if size:
                counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, words: int) -> np.ndarray:
    """How many distinct shingles of all documents fall into each bucket; BUCKETS numbers reach the driver, whatever the input."""
    rows = by_bytes(texts.select("text")).mapInArrow(_count_buckets(words), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, dtype=np.int64)
    counts[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return counts


def _parity(places: np.ndarray, size: int) -> np.ndarray:
    """The parity bitmap of size bits, 64 a number: a bit is set where an odd number of members fall on it."""
    return np.packbits((np.bincount((places & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).view(np.int64)


def _heads(words: int, percent: int, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        digest = lambda x: hashlib.blake2b(x.tobytes(), digest_size=16).digest()
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 3)
        names = ["doc_id", "n", "fp", "h", "prefix", "bits", "sketch"]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: list[list] = [[] for _ in names]
            size = 0
            for row, keys in shingle_sets(batch.column(1), words):
                if size > 1 << 18:  # members of the sets behind out, whose prefixes and sketches are a part of them
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)
                    out, size = [[] for _ in names], 0
                n = len(keys)
                size += n + 64
                take = n - -(-percent * n // 100) + 1 if n else 0
                # any total order of the shingles is right; rare buckets first keeps the postings short
                order = np.lexsort((keys, table[(keys % np.uint64(BUCKETS)).astype(np.int64)]))[:take]
                places = mix(keys)
                # four bits a member, so the sketch tells the sizes of differences for sets of any size
                sketch = _parity(places, max(64 * BITMAP_WORDS, 1 << max(n - 1, 1).bit_length() + 2))
                bits = _parity(places, 64 * BITMAP_WORDS)
                for col, value in zip(out, (ids[row], n, digest(keys), digest(keys[order]), keys[order].view(np.int64), bits, sketch), strict=True):
                    col.append(value)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, rows, size = batch.column(0), [], [], 0
            for row, keys in shingle_sets(batch.column(1), words):
                held.append(keys.view(np.int64))
                rows.append(row)
                size += len(keys)
                if size > 1 << 20:
                    yield pa.record_batch([ids.take(pa.array(rows)), pa.array(held, pa.list_(pa.int64()))], names=["id", "keys"])
                    held, rows, size = [], [], 0
            if rows:
                yield pa.record_batch([ids.take(pa.array(rows)), pa.array(held, pa.list_(pa.int64()))], names=["id", "keys"])

    return run


def _similar_sizes(a: str, b: str, percent: int) -> Column:
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def _bitmaps_allow(percent: int) -> Column:
    """False only where the parity bitmaps differ in more bits than two linked sets can differ in members."""
    differing = reduce(lambda x, y: x + y, [F.bit_count(F.col("abits")[k].bitwiseXOR(F.col("bbits")[k])) for k in range(BITMAP_WORDS)])
    return differing * (100 + percent) <= (F.col("an") + F.col("bn")) * (100 - percent)


def _sketches_allow(percent: int) -> Column:
    """False only where the sketches x and y differ in more bits than two linked sets can differ in members. The larger sketch is folded to the
    size of the smaller first: sizes are powers of two, and those of linked sets are equal or one step apart from 50 percent on; others pass."""

    def fold(long: Column, other: Column) -> Column:
        half = (F.size(long) / 2).cast("int")
        folded = F.zip_with(F.slice(long, F.lit(1), half), F.slice(long, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(long) > F.size(other), folded).otherwise(long)

    x, y = fold(F.col("x"), F.col("y")), fold(F.col("y"), F.col("x"))
    differing = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, k: total + F.coalesce(k, F.lit(0)))
    return (F.size(x) != F.size(y)) | (differing * (100 + percent) <= (F.col("an") + F.col("bn")) * (100 - percent))


def _linked(pairs: DataFrame, rows: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of ids, those whose complete sets link.

    Small bitmaps, then sketches of a sixteenth of a set's size hold nearly all others back, both exactly; so complete sets are
    sent for about as many pairs as there are links.
    """
    facts, spark = rows.select("doc_id", "n", "bits"), texts.sparkSession
    pairs = pairs.distinct().join(facts.toDF("a", "an", "abits"), "a").join(facts.toDF("b", "bn", "bbits"), "b")
    pairs = materialize(pairs.where(_similar_sizes("an", "bn", percent) & _bitmaps_allow(percent)).select("a", "b", "an", "bn"), "pairs")
    sketches = rows.select("doc_id", "sketch")
    near = pairs.join(sketches.toDF("b", "y"), "b").join(sketches.toDF("a", "x"), "a")
    near = materialize(near.where(_sketches_allow(percent)).select("a", "b"), "near")
    remove(spark, pairs)
    wanted = near.select(F.col("a").alias("id")).union(near.select("b")).distinct()
    sets = materialize(by_bytes(texts.join(wanted, "id", "left_semi").select("id", "text")).mapInArrow(_sets(words), "id long, keys array<long>"), "sets")
    both = near.join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a")
    shared = F.size(F.array_intersect("x", "y"))
    out = materialize(both.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b"), "links")
    remove(spark, near, sets)
    return out


def _merged(members: DataFrame, links: DataFrame) -> DataFrame:
    """members with comp replaced by the smallest comp reached over links of ids."""
    comp = members.select("id", "comp")
    edges = links.join(comp.toDF("a", "ca"), "a").join(comp.toDF("b", "cb"), "b")
    now = connected_components(edges, "ca", "cb").toDF("comp", "least")
    return materialize(members.join(now, "comp", "left").withColumn("comp", F.coalesce("least", "comp")).drop("least"), "members")


def similarity_components(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", star_rounds: int = 2) -> DataFrame:
    """One row per input row: id_col, n_shingles, component_id (smallest id reachable over links, its own included).

    Two documents link when 100 * |A & B| >= percent * |A | B| for their sets of word shingles. Null and empty texts have
    an empty set and link with nothing; rows of equal id are one node; a null id has a null component. Other columns
    are ignored.

    Documents of equal sets are one class. Classes whose prefix (the rarest shingles, one of which any
    two linked sets share) and size are equal form a group; only groups are posted under their prefix shingles. Each star round
    pairs the groups of a posting with one pivot, which is linear in the postings, and joins what links into
    components. The last round pairs all groups of a posting that are still in different components, and expands
    and verifies their members. Pairs within a component cannot change it, so none are made, and no link is lost.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = spark.sparkContext.broadcast(bucket_counts(texts, words))
    rows = materialize(by_bytes(texts.select(F.col("id").alias("doc_id"), "text")).mapInArrow(_heads(words, percent, counts), _HEADS), "heads")
    filled = rows.where("n > 0 and doc_id is not null")
    # size and prefix follow from the set, so they only ride along as keys
    classes = materialize(filled.groupBy("fp", "n", "h").agg(F.min("doc_id").alias("id")), "classes")
    groups = classes.groupBy("h", "n").agg(F.min("id").alias("g"))
    members = materialize(classes.join(groups, ["h", "n"]).select("id", "g", F.col("id").alias("comp")).distinct(), "members")
    first = filled.select("doc_id", "n", "h", "prefix").join(groups.withColumnRenamed("g", "doc_id"), ["doc_id", "n", "h"], "left_semi").dropDuplicates(["doc_id", "n", "h"])
    posted = first.select(F.col("doc_id").alias("g"), "n", F.posexplode("prefix").alias("pos", "s"))
    often = posted.groupBy("s").agg(F.count("*").alias("k")).where("k > 1").select("s")
    posted = materialize(posted.join(often, "s", "left_semi"), "postings")
    clean(spark)

    for r in range(star_rounds):
        entries = members.groupBy("g", "comp").agg(F.min("id").alias("id"))
        rank = F.col("id") if r == 0 else F.xxhash64("id", F.lit(r))
        inside = entries.groupBy("g").agg(F.min_by("id", rank).alias("a"), F.min_by("comp", rank).alias("ca"))
        inside = entries.join(inside, "g").where("comp != ca").select("a", F.col("id").alias("b"))
        # bands of size, shifted each round, keep pivots comparable with what they are paired with
        band = F.floor(F.log("n") / F.lit(float(np.log(100 / percent))) + F.lit(r / 2))
        # in the first round every class is its own component, and a group's first one stands for it
        lists = posted.withColumns({"id": F.col("g"), "comp": F.col("g")}) if r == 0 else posted.join(entries, "g")
        lists = lists.withColumn("band", band)
        pivot = lists.groupBy("s", "band").agg(F.min_by(F.struct("id", "comp", "n"), rank).alias("p"), F.min("comp").alias("least"), F.max("comp").alias("most"))
        star = lists.join(pivot.where("least != most"), ["s", "band"]).where(F.expr("p.comp != comp") & _similar_sizes("n", "p.n", percent))
        pairs = star.select(F.col("p.id").alias("a"), F.col("id").alias("b")).union(inside)
        links = _linked(pairs, rows, texts, words, percent)
        after = _merged(members, links)
        remove(spark, members, links)
        members = after
        clean(spark)

    entries = members.groupBy("g", "comp").agg(F.min("id").alias("id"))
    mixed = posted.join(entries, "g").groupBy("s").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least != most").select("s")
    # a group of one class has that class's bitmap; groups of several are held back by their sizes and places only
    single = members.groupBy("g").agg(F.count("*").alias("k")).join(rows.select(F.col("doc_id").alias("g"), "bits").dropDuplicates(["g"]), "g")
    single = single.select("g", F.when(F.col("k") == 1, F.col("bits")).alias("bits"))
    lists = posted.join(mixed, "s", "left_semi").join(entries.join(single, "g"), "g")
    lists = materialize(lists.select("s", "pos", "n", "g", "comp", "bits"), "lists")
    x, y = lists.toDF("s", "xpos", "an", "xg", "xc", "abits"), lists.toDF("s", "ypos", "bn", "yg", "yc", "bbits")
    # at the first shingle that two linked sets share, all they share is still ahead; at later ones they need not pair again
    fits = F.expr(f"least(an - xpos, bn - ypos) * {100 + percent} >= {percent} * (an + bn)")
    near = F.expr("abits is null or bbits is null") | _bitmaps_allow(percent)
    across = x.join(y, "s").where(F.expr("xc < yc") & _similar_sizes("an", "bn", percent) & fits & near).select("xg", "xc", "yg", "yc")
    own = entries.select("g", "comp")
    inside = own.toDF("xg", "xc").join(own.toDF("yg", "yc"), F.expr("xg = yg and xc < yc"))
    grouped = across.union(inside).distinct()
    pairs = grouped.join(members.select(F.col("g").alias("xg"), F.col("comp").alias("xc"), F.col("id").alias("a")), ["xg", "xc"])
    pairs = pairs.join(members.select(F.col("g").alias("yg"), F.col("comp").alias("yc"), F.col("id").alias("b")), ["yg", "yc"]).select("a", "b")
    links = _linked(pairs, rows, texts, words, percent)
    merged = _merged(members, links)
    remove(spark, members, links, posted, lists)
    clean(spark)

    found = classes.join(merged.groupBy("id").agg(F.min("comp").alias("comp")), "id").select(F.col("fp").alias("f"), "comp")
    out = rows.select("doc_id", "n", "fp").join(found, F.col("f") == F.col("fp"), "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_per_component(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose id is the smallest of their component; rows with a null id stay."""
    best = similarity_components(docs, words, percent, id_col, text_col).where(F.col(id_col).eqNullSafe(F.col("component_id")))
    best = best.select(F.col(id_col).alias("kept_id")).distinct()
    rows = docs.select(F.struct("*").alias("r"))
    kept = rows.where(F.col("r")[id_col].isNotNull()).join(best, F.col("r")[id_col].cast("long") == F.col("kept_id"), "left_semi")
    return kept.union(rows.where(F.col("r")[id_col].isNull())).select("r.*")
