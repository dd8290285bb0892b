"""Prefix tries of conversations by van Emde Boas recursion: sequences are cut at half depth, cut prefixes get names, and totals are grafted upward."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import materialize, remove, shuffle_partitions

#: Levels of the smallest windows, whose little tries are summed directly.
BASE = 8
#: Text of member ids that a task holds of one node; longer runs leave it as blocks.
BLOCK_BYTES = 1 << 16
#: A node with more than this share of all nodes as children is looked up by broadcast: there are fewer than a thousand of them.
HOT_SHARE = 1000
_NODE = ["depth", "a", "b"]
_ENDS = "depth long, a long, b long, first long, ids binary, digest string"


def number_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(turns, spans). turns, a table: conv, part, id, fp (128 bits of role and text), w (words). spans: conv, part, first, before.

    A turn's place in its conversation, from 0, is id - first + before. Turns are ordered by turn_col, nulls first, ties by the digest of role and text.
    One range sort deals them out, so a conversation of any length spreads over tasks; a span is what one task holds of one conversation.
    Rows without conv_col are of no conversation and left out; null roles and texts are empty.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), digest.alias("fp"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("w")
    )
    order = ["conv", "turn", "fp"]
    laid = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    turns = materialize(laid.select("conv", F.shiftright("id", 33).alias("part"), "id", "fp", "w"), "turns")
    # a conversation has a span in each task at most
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = turns.groupBy("conv", "part").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    return turns, spans.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def rebuilt(turns: DataFrame, spans: DataFrame, group: int = 20, shares: int = 4) -> tuple[DataFrame, DataFrame]:
    """(letters, lengths) of the rebuilt conversations: conv, p (place from 0), fp, w, len; and conv, len.

    Conversation c takes the first h turns of conversation c - c % group, if that exists, and its own after its first h; h is crc32(c) % shares.
    A base has fewer than 2 * group such conversations and lends each fewer than `shares` turns.
    """
    lengths = spans.groupBy("conv").agg(F.sum("n").alias("own"))
    base = F.col("conv") - F.col("conv") % group
    h = F.when(F.col("conv") == base, 0).otherwise(F.crc32(F.col("conv").cast("string").cast("binary")) % shares)
    heads = lengths.select(F.col("conv").alias("base"), F.col("own").alias("there"))
    plan = lengths.withColumns({"base": base, "h": h}).join(heads, "base", "left").withColumn("lent", F.least("h", F.coalesce("there", F.lit(0))))
    plan = plan.select("conv", "base", "h", "lent", (F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len"))
    numbered = turns.join(spans.join(plan, "conv"), ["conv", "part"]).withColumn("p", F.col("id") - F.col("first") + F.col("before"))
    own = numbered.where("p >= h").select("conv", (F.col("p") - F.col("h") + F.col("lent")).alias("p"), "fp", "w", "len")
    first = numbered.where((F.col("p") < shares) & (F.col("conv") % group == 0)).select(F.col("conv").alias("base"), "p", "fp", "w")
    borrowed = plan.where("lent > 0").join(first, "base").where("p < lent").select("conv", "p", "fp", "w", "len")
    return own.unionByName(borrowed), plan.select("conv", "len")


def _xor(x: Column, y: Column) -> Column:
    return F.struct(x["a"].bitwiseXOR(y["a"]).alias("a"), x["b"].bitwiseXOR(y["b"]).alias("b"))


def _chunks(letters: DataFrame) -> DataFrame:
    """conv, j, n, len, names, w: BASE turns in a row. names[i] is the name of the chunk's first i turns, the exclusive or of two 64-bit hashes of
    digest and place, so the name of a longer prefix is the exclusive or of its parts' names."""
    letter = F.struct("p", F.xxhash64("fp", "p").alias("a"), F.xxhash64("p", "fp").alias("b"), "w")
    rows = letters.groupBy("conv", F.floor(F.col("p") / BASE).alias("j")).agg(F.sort_array(F.collect_list(letter)).alias("x"), F.max("len").alias("len"))
    none = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    names = F.aggregate("x", F.array(none), lambda acc, y: F.concat(acc, F.array(_xor(F.element_at(acc, -1), y))))
    return rows.select("conv", "j", F.size("x").alias("n"), "len", names.alias("names"), F.transform("x", lambda y: y["w"]).alias("w"))


def _cut_names(chunks: DataFrame) -> list[DataFrame]:
    """Tables of (conv, j, a, b): the name of the prefix before chunk j, for every j > 0 there is.

    Every window of chunks is cut at its half: the cut prefix is named by the window's own prefix and its upper half. All windows of a size are cut in one job;
    the halves follow in the next.
    """
    spark = chunks.sparkSession
    last, named, size = chunks.agg(F.max("j")).first()[0] or 0, [], 1
    while size <= last:
        size *= 2
    total = F.element_at("names", -1)
    while size > 1:
        half = size // 2
        upper = chunks.where((F.col("n") == BASE) & (F.col("j") % size < half)).groupBy("conv", (F.col("j") - F.col("j") % size).alias("lo"))
        upper = upper.agg(F.bit_xor(total["a"]).alias("ua"), F.bit_xor(total["b"]).alias("ub"))
        cuts = chunks.where(F.col("j") % size == half).select("conv", "j", (F.col("j") - half).alias("lo")).join(upper, ["conv", "lo"])
        before = reduce(DataFrame.unionByName, named, spark.createDataFrame([], "conv long, j long, a long, b long")).withColumnRenamed("j", "lo")
        cuts = cuts.join(before, ["conv", "lo"], "left") if named else cuts.withColumns({"a": F.lit(0).cast("long"), "b": F.lit(0).cast("long")})
        name = [F.coalesce(x, F.lit(0)).bitwiseXOR(F.col(y)).alias(x) for x, y in (("a", "ua"), ("b", "ub"))]
        named.append(materialize(cuts.select("conv", "j", *name), "cuts"))
        size = half
    return named


def _paths(chunks: DataFrame) -> DataFrame:
    """The chunks with whole names: names[i] names the prefix of the conversation that ends i turns into the chunk."""
    named = _cut_names(chunks)
    first = chunks.where("j = 0")
    if not named:
        return first
    rest = chunks.where("j > 0").join(reduce(DataFrame.unionByName, named), ["conv", "j"])
    root = F.struct("a", "b")
    rest = rest.withColumn("names", F.transform("names", lambda x: _xor(x, root)))
    paths = materialize(first.unionByName(rest.select(*first.columns)), "paths")
    remove(paths.sparkSession, *named)
    return paths


def _steps(names: str, j: str, upto: Column) -> Column:
    """One element for each node of a chunk's path down to its upto-th: depth, name and the parent's name."""
    step = lambda x, i: F.struct((F.col(j) * BASE + i + 1).alias("depth"), x["a"].alias("a"), x["b"].alias("b"), F.get(F.col(names), i)["a"].alias("pa"), F.get(F.col(names), i)["b"].alias("pb"))
    return F.transform(F.slice(F.col(names), F.lit(2), upto), step)


def _nodes(paths: DataFrame) -> DataFrame:
    """All nodes but the root: depth, a, b, pa, pb, conv (smallest member), n_convs, saved (the node's own), n_children."""
    steps = _steps("names", "j", F.col("n"))
    rows = paths.select("conv", F.inline(F.zip_with(steps, "w", lambda s, w: F.struct(s["depth"].alias("depth"), s["a"].alias("a"), s["b"].alias("b"), s["pa"].alias("pa"), s["pb"].alias("pb"), w.alias("w")))))
    nodes = rows.groupBy(*_NODE).agg(F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.min("w").alias("w"))
    nodes = materialize(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("w")).drop("w"), "nodes")
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    trie = materialize(nodes.join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie")
    remove(paths.sparkSession, nodes)
    return trie


def _shares(at: DataFrame, paths: DataFrame, upto: Column) -> DataFrame:
    """What every row of at (conv, j, saved, leaves) gives to the nodes of its conversation's chunk j down to the upto-th, summed by node."""
    rows = at.join(paths.select("conv", "j", "names"), ["conv", "j"]).select("saved", "leaves", F.inline(_steps("names", "j", upto)))
    return rows.groupBy(*_NODE).agg(F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))


def _totals(trie: DataFrame, paths: DataFrame) -> list[DataFrame]:
    """Tables whose sums by node are the subtrees' saved and leaves.

    First every window of BASE levels is summed by itself. Then windows double: what the lower forest under a cut node holds is grafted on
    the cut node and its ancestors in the upper trie, along the path of the node's smallest member. Windows of a size are independent of each other.
    """
    within = trie.select("conv", F.floor((F.col("depth") - 1) / BASE).alias("j"), ((F.col("depth") - 1) % BASE + 1).cast("int").alias("i"), "saved", (F.col("n_children") == 0).cast("long").alias("leaves"))
    given = [materialize(_shares(within, paths, F.col("i")), "totals")]
    deepest, size = trie.agg(F.max("depth")).first()[0] or 0, 2 * BASE
    while size // 2 < deepest:
        half = size // 2
        tops = reduce(DataFrame.unionByName, given).where(F.col("depth") % size == half + 1)
        forest = tops.groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
        cut = forest.join(trie.where(F.col("depth") % size == half).select(*_NODE, "conv"), _NODE)
        chunk = F.explode(F.sequence(((F.col("depth") - half) / BASE).cast("long"), (F.col("depth") / BASE).cast("long") - 1)).alias("j")
        given.append(materialize(_shares(cut.select("conv", "saved", "leaves", chunk), paths, F.lit(BASE)), "totals"))
        size *= 2
    return given


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of nodes whose members' ids lie within this task's sorted rows, between others; blocks of ids for its first and last node and for long ones."""
    out: list[tuple] = []
    node, first, held, size, whole = None, 0, [], 0, False

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * 6
        out.clear()
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)], names=["depth", "a", "b", "first", "ids", "digest"])

    for batch in batches:
        cols = [c.to_numpy() for c in batch.columns]
        if not len(cols[0]):
            continue
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1
        for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(cols[0])], strict=True):
            here = (int(cols[0][lo]), int(cols[1][lo]), int(cols[2][lo]))
            if here != node:
                if node is not None:
                    text = ",".join(held).encode()
                    out.append((*node, first, None, hashlib.sha256(text).hexdigest()) if whole else (*node, first, text, None))
                # what an earlier task may have begun is not whole
                node, first, held, size, whole = here, int(cols[3][lo]), [], 0, node is not None
            for at in range(lo, hi, 4096):
                ids = cols[3][at : min(hi, at + 4096)]
                if not held:
                    first = int(ids[0])
                text = ",".join(map(str, ids.tolist()))
                held.append(text)
                size += len(text)
                if size >= BLOCK_BYTES:
                    out.append((*node, first, ",".join(held).encode(), None))
                    held, size, whole = [], 0, False
        if len(out) > 4096:
            yield flush()
    if node is not None and held:
        out.append((*node, first, ",".join(held).encode(), None))
    yield flush()


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order, a node's in a row, hashed one after another: only the state of a hash is held."""
    node, state, done = None, None, []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*done, strict=True)) or [[]] * 4
        done.clear()
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=[*_NODE, "digest"])

    for batch in batches:
        for depth, a, b, ids in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if (depth, a, b) != node:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = (depth, a, b), hashlib.sha256(ids)
            elif ids:
                state.update(b"," + ids)
        if len(done) > 4096:
            yield flush()
    if node is not None:
        done.append((*node, state.hexdigest()))
    yield flush()


def _ends(ends: DataFrame) -> DataFrame:
    """depth, a, b, ends_sha256: the hash of the ids of the conversations that end at a node, ascending, comma-joined.

    A range sort deals out the ids, so a node where a third of all conversations end spreads over tasks; what is left to one task is the chain of
    SHA-256 itself, over blocks of ids, with nothing but its state in memory.
    """
    n = shuffle_partitions(ends.sparkSession)
    laid = ends.select(*_NODE, "conv").repartitionByRange(n, *_NODE, "conv").sortWithinPartitions(*_NODE, "conv")
    runs = materialize(laid.mapInArrow(_runs, _ENDS), "ends")
    blocks = runs.where("digest IS NULL").repartition(n, *_NODE).sortWithinPartitions(*_NODE, "first").select(*_NODE, "ids")
    whole = blocks.mapInArrow(_chained, "depth long, a long, b long, digest string")
    return runs.where("digest IS NOT NULL").select(*_NODE, "digest").unionByName(whole).withColumnRenamed("digest", "ends_sha256")


def prefix_trie(letters: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per distinct prefix of the sequences: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    letters: conv, p (place from 0, gapless), fp (binary digest of the element), w (its words), len; lengths: conv, len of every sequence, empty ones too.
    Prefixes are equal when their 128-bit names are. The root's row has no parent. No sequences: no rows. Runs jobs when called; tables of its own
    that the result does not read are deleted.
    """
    spark = letters.sparkSession
    lengths = materialize(lengths, "lengths")
    members, smallest = lengths.agg(F.count("*"), F.min("conv")).first()
    chunks = materialize(_chunks(letters), "chunks")
    paths = _paths(chunks)
    trie = _nodes(paths)
    given = _totals(trie, paths)
    n_nodes, saved, leaves, tops = trie.agg(F.count("*"), F.sum("saved"), F.count_if(F.col("n_children") == 0), F.count_if(F.col("depth") == 1)).first()
    zero = lambda name: F.lit(0).cast("long").alias(name)

    totals = reduce(DataFrame.unionByName, given).groupBy(*_NODE).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    last = paths.where(F.col("j") * BASE + F.col("n") == F.col("len")).select("conv", F.col("len").alias("depth"), F.element_at("names", -1)["a"].alias("a"), F.element_at("names", -1)["b"].alias("b"))
    ends = _ends(last.unionByName(lengths.where("len = 0").select("conv", zero("depth"), zero("a"), zero("b"))))

    # a parent's smallest member: the root's is known, nodes with very many children are few, all others have few children
    parents = trie.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("parent_conv_id"), "n_children")
    key, hot = ["depth", "pa", "pb"], F.col("n_children") > n_nodes // HOT_SHARE + 1
    many = F.broadcast(parents.where(hot).drop("n_children").withColumnRenamed("parent_conv_id", "known"))
    deeper = trie.where("depth > 1").join(many, key, "left")
    found = deeper.where("known IS NULL").drop("known").join(parents.where(~hot).drop("n_children"), key)
    cols = [*_NODE, "conv", "n_convs", "n_children", "parent_conv_id"]
    nodes = trie.where("depth = 1").withColumn("parent_conv_id", F.lit(smallest).cast("long")).select(*cols)
    nodes = nodes.unionByName(deeper.where("known IS NOT NULL").withColumnRenamed("known", "parent_conv_id").select(*cols)).unionByName(found.select(*cols))
    nodes = nodes.join(totals, _NODE)
    root = spark.range(1 if members else 0).select(
        zero("depth"), zero("a"), zero("b"), F.lit(smallest).cast("long").alias("conv"), F.lit(members).cast("long").alias("n_convs"), F.lit(tops).cast("long").alias("n_children"),
        F.lit(None).cast("long").alias("parent_conv_id"), F.lit(saved or 0).cast("long").alias("saved_tokens"), F.lit(leaves or 1).cast("long").alias("n_leaves"),
    )
    out = nodes.unionByName(root).join(ends, _NODE, "left")
    result = materialize(out.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    ), "prefixes")
    remove(spark, lengths, chunks, paths, trie, *given)
    return result


def conversation_trie(conversations: DataFrame, group: int = 20, shares: int = 4, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The prefix trie of the conversations rebuilt by `rebuilt`, as `prefix_trie` returns it; odd rows are handled as `number_turns` says. Other columns are ignored."""
    turns, spans = number_turns(conversations, conv_col, turn_col, role_col, text_col)
    spans = materialize(spans, "spans")
    result = prefix_trie(*rebuilt(turns, spans, group, shares))
    remove(conversations.sparkSession, turns, spans)
    return result
