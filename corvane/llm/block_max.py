"""Ranked lexical search by Block-Max MaxScore over an inverted index in shards of documents."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import LONG_WORD, by_bytes, materialize, remove, shared_dir, shuffle_partitions, text_slices, word_hashes

#: Postings of a block, whose maximum is known without unpacking it.
BLOCK = 128
#: A shard of the index ends after so many postings or documents, whichever comes first.
SHARD_POSTINGS, SHARD_DOCS = 1 << 20, 1 << 14
#: Bytes of a text that are split into terms at a time.
PART_BYTES = 1 << 20
#: Pairs of an item and a term, about, in a block of queries: what a task holds of them.
QUERY_PAIRS = 1 << 16
_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_INDEX = "shard long, term long, n long, tokens long, firsts array<int>, max_tf array<int>, min_len array<long>, ends array<int>, payload binary"


# --- terms --------------------------------------------------------------------------------------


def _parts(data: bytes, offsets: np.ndarray) -> Iterator[tuple[bytes, np.ndarray, int]]:
    """(bytes, offsets, row of the first): data whole, or a single long text in parts that end between terms."""
    if len(offsets) > 2 or len(data) <= PART_BYTES:
        yield data, offsets, 0
        return
    at = 0
    while at < len(data):
        end = min(len(data), at + PART_BYTES)
        while end < len(data) and _TERM[data[end - 1]]:
            more = np.flatnonzero(~_TERM[np.frombuffer(data[end : end + PART_BYTES], dtype=np.uint8)])
            end = end + int(more[0]) + 1 if len(more) else min(len(data), end + PART_BYTES)
        yield data[at:end], np.array([0, end - at]), 0
        at = end


def terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, keys, row of each key): the terms of a string column, with repeats, as 64-bit hashes, slice after slice; a long text
    comes in several slices.

    Terms are the maximal runs of ASCII letters and digits and of all characters beyond ASCII; A-Z are lower-cased. UTF-8 has bytes from 0x80 for just these
    characters, so terms are runs of bytes.
    """
    for first, whole, ends in text_slices(column):
        for data, offsets, _ in _parts(whole, ends):
            data = data.translate(_LOWER)
            raw = np.frombuffer(data, dtype=np.uint8)
            inside = np.zeros(len(raw) + 2, dtype=bool)
            inside[1:-1] = _TERM[raw]
            edge = np.zeros(len(raw) + 1, dtype=bool)  # where a document begins
            edge[offsets] = True
            starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
            stops = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
            keys = word_hashes(raw, starts, stops)
            for k in np.flatnonzero(stops - starts > LONG_WORD):
                keys[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : stops[k]], digest_size=8).digest(), "little")
            yield first, len(offsets) - 1, keys, np.searchsorted(offsets, starts, side="right") - 1


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin in sorted columns."""
    n = len(columns[0])
    new = np.ones(n, dtype=bool)
    if n > 1:
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


# --- packed integers ----------------------------------------------------------------------------


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative integers, 7 bits a byte, low bits first, the high bit set on all bytes but a value's last; and each value's number of bytes."""
    size = np.ones(len(values), dtype=np.int64)
    for bits in range(7, 63, 7):
        size += values >= 1 << bits
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    at, rest, left = ends - size, values.astype(np.int64), size.copy()
    while len(at):
        out[at] = (rest & 127) | ((left > 1) << 7)
        more = left > 1
        at, rest, left = at[more] + 1, rest[more] >> 7, left[more] - 1
    return out, size


def unpack(data: np.ndarray) -> np.ndarray:
    """The integers that `pack` has packed."""
    if not len(data):
        return np.empty(0, np.int64)
    last = data < 128
    starts = np.concatenate(([0], np.flatnonzero(last)[:-1] + 1))
    shift = 7 * (np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))))
    return np.add.reduceat((data & 127).astype(np.int64) << shift, starts)


# --- the index ----------------------------------------------------------------------------------


class _Shard:
    """Postings of some documents, gathered in memory until they are written."""

    def __init__(self) -> None:
        self.ids: list = []
        self.lengths: list[np.ndarray] = []
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.docs = self.postings = 0

    def open_docs(self, ids: list) -> None:
        self.ids += ids
        self.lengths.append(np.zeros(len(ids), dtype=np.int64))
        self.docs += len(ids)

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Terms of the documents opened last; rows from 0 there."""
        self.lengths[-1] += np.bincount(rows, minlength=len(self.lengths[-1]))
        order = np.lexsort((rows, keys))
        keys, rows = keys[order], rows[order]
        at = _runs(keys, rows)
        self.held.append((keys[at], (rows[at] + self.docs - len(self.lengths[-1])).astype(np.int64), np.diff(np.append(at, len(keys)))))
        self.postings += len(at)

    def rows(self, shard: int) -> pa.RecordBatch:
        """One row with the documents (term null), one row a term with its list in blocks."""
        length = np.concatenate(self.lengths)
        key, row, tf = (np.concatenate(c) for c in zip(*self.held, strict=True)) if self.held else (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 2)
        order = np.lexsort((row, key))
        key, row, tf = key[order], row[order], tf[order]
        at = _runs(key, row) if len(key) else np.empty(0, np.int64)
        if len(at) < len(key):  # a long text's parts
            tf = np.add.reduceat(tf, at)
            key, row = key[at], row[at]
        lists = _runs(key) if len(key) else np.empty(0, np.int64)
        sizes = np.diff(np.append(lists, len(key)))
        place = np.arange(len(key)) - np.repeat(lists, sizes)
        blocks = np.flatnonzero(place % BLOCK == 0)
        gap = np.empty(len(key), dtype=np.int64)
        gap[1:] = row[1:] - row[:-1]
        gap[blocks] = row[blocks]
        pair = np.empty(2 * len(key), dtype=np.int64)
        pair[0::2], pair[1::2] = gap, tf
        data, bytes_of = pack(pair)
        ends = np.cumsum(bytes_of[1::2] + bytes_of[0::2])
        block_end = ends[np.append(blocks[1:], len(key)) - 1] if len(key) else ends
        list_end = ends[lists + sizes - 1] if len(key) else ends
        list_start = np.concatenate(([0], list_end[:-1])) if len(key) else list_end
        per_list = -(-sizes // BLOCK)
        null = np.array([v is None for v in self.ids])
        ids = np.array([0 if v is None else v for v in self.ids], dtype="<i8")
        head = ids.tobytes() + length.astype("<i8").tobytes() + null.astype(np.uint8).tobytes()
        cut = np.concatenate(([0, 0], np.cumsum(per_list))).astype(np.int32)
        lists_of = lambda values, kind: pa.ListArray.from_arrays(pa.array(cut), pa.array(values.astype(kind)))
        bytes_cut = np.concatenate(([0, len(head)], len(head) + list_end)).astype(np.int32)
        payload = pa.Array.from_buffers(pa.binary(), len(lists) + 1, [None, pa.py_buffer(bytes_cut.tobytes()), pa.py_buffer(head + data.tobytes())])
        n = np.concatenate(([np.count_nonzero(length)], sizes)).astype(np.int64)
        return pa.record_batch(
            [
                pa.array(np.full(len(n), shard, dtype=np.int64)), pa.array(np.concatenate((np.zeros(1, np.int64), key[lists].view(np.int64))), mask=np.arange(len(n)) == 0), pa.array(n),
                pa.array(np.concatenate(([length.sum()], np.zeros(len(lists)))).astype(np.int64)), lists_of(row[blocks], np.int32),
                lists_of(np.maximum.reduceat(tf, blocks) if len(key) else tf, np.int32), lists_of(np.minimum.reduceat(length[row], blocks) if len(key) else tf, np.int64),
                lists_of(block_end - np.repeat(list_start, per_list), np.int32), payload,
            ],
            names=[c.split()[0] for c in _INDEX.split(", ")],
        )


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number, shard = TaskContext.get().partitionId(), 0, _Shard()
    for batch in batches:
        ids, done = batch.column(0).to_pylist(), 0
        for first, rows, keys, row in terms(batch.column(1)):
            if first >= done:  # not a further part of the same long text
                if shard.docs and (shard.postings >= SHARD_POSTINGS or shard.docs + rows > SHARD_DOCS):
                    yield shard.rows(part << 32 | number)
                    number, shard = number + 1, _Shard()
                shard.open_docs(ids[first : first + rows])
                done = first + rows
            if len(keys):
                shard.add(keys, row)
    if shard.docs:
        yield shard.rows(part << 32 | number)


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index of every row's whole text, written to path and read back; a shard is some 2^20 postings of at most 2^14 documents.

    A row is a term's list in a shard (n postings in blocks of BLOCK: first document, largest tf, shortest document and end of each block, packed gaps and tf's), or,
    with a null term, a shard's documents (n with at least one term, tokens in all). There is no shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    by_bytes(rows).mapInArrow(_build, _INDEX).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(_INDEX).parquet(path)


# --- search -------------------------------------------------------------------------------------


@dataclass
class _Queries:
    """A block of queries: for each item its terms and weights (repeats included), heaviest bound first, and bounds of what the rest can add."""

    items: dict[int, tuple[list[int], list[int], np.ndarray]]
    total_docs: int
    total_terms: int
    k: int

    def norm(self, length: np.ndarray) -> np.ndarray:
        return 25 + (75 * length * self.total_docs) // self.total_terms


def _impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * norm)


class _List:
    """A term's postings in one shard: blocks are unpacked when first asked for."""

    def __init__(self, firsts, max_tf, min_len, ends, payload: bytes, n: int, shard: _Documents, queries: _Queries) -> None:
        self.firsts = np.asarray(firsts)
        self.most = _impact(np.asarray(max_tf).astype(np.int64), queries.norm(np.asarray(min_len)))
        self.starts, self.ends = np.concatenate(([0], ends[:-1])), np.asarray(ends)
        self.payload, self.n, self.norm = np.frombuffer(payload, dtype=np.uint8), n, shard.norm
        self.known = np.zeros(len(self.firsts), dtype=bool)
        self.rows, self.impacts = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)

    def read(self, blocks: np.ndarray) -> None:
        """Unpack these blocks."""
        blocks = blocks[~self.known[blocks]]
        if not len(blocks):
            return
        whole = len(blocks) == len(self.firsts)
        pair = unpack(self.payload if whole else np.concatenate([self.payload[self.starts[b] : self.ends[b]] for b in blocks]))
        at = np.arange(self.n) if whole else np.concatenate([np.arange(b * BLOCK, min(self.n, (b + 1) * BLOCK)) for b in blocks])
        gap, tf = pair[0::2], pair[1::2]
        head = np.flatnonzero(at % BLOCK == 0)
        sums = np.cumsum(gap)
        row = sums - np.repeat(sums[head] - gap[head], np.diff(np.append(head, len(at))))
        self.rows[at], self.impacts[at] = row, _impact(tf, self.norm[row])
        self.known[blocks] = True

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        self.read(np.arange(len(self.firsts)))
        return self.rows, self.impacts

    def block_of(self, rows: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, rows, side="right") - 1

    def bounds(self, blocks: np.ndarray) -> np.ndarray:
        return np.where(blocks >= 0, self.most[blocks], 0)

    def at(self, rows: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """The impacts of rows, 0 where the term does not occur; only their blocks are unpacked."""
        out = np.zeros(len(rows), dtype=np.int64)
        inside = np.flatnonzero(blocks >= 0)
        need = np.unique(blocks[inside])
        self.read(need)
        place = np.concatenate([np.arange(b * BLOCK, min(self.n, (b + 1) * BLOCK)) for b in need]) if len(need) else np.empty(0, np.int64)
        have = self.rows[place]
        found = np.minimum(np.searchsorted(have, rows[inside]), max(len(have) - 1, 0))
        hit = have[found] == rows[inside] if len(have) else np.zeros(len(inside), dtype=bool)
        out[inside[hit]] = self.impacts[place[found[hit]]]
        return out


class _Documents:
    """The documents of a shard."""

    def __init__(self, payload: bytes, queries: _Queries) -> None:
        n = len(payload) // 17
        self.ids, length = np.frombuffer(payload, "<i8", n), np.frombuffer(payload, "<i8", n, 8 * n)
        self.null = np.frombuffer(payload, np.uint8, n, 16 * n).astype(bool)
        self.norm = queries.norm(length)


class Heaps:
    """The k best of each item so far: (score, null id, id)."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.best: dict[int, np.ndarray] = {}

    def floor(self, item: int) -> int:
        """A document with a lower score is not among the k best; 1 while there are fewer."""
        have = self.best.get(item)
        return int(have[-1, 0]) if have is not None and len(have) == self.k else 1

    def add(self, item: int, scores: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        new = np.column_stack((scores, null.astype(np.int64), ids))
        rows = np.concatenate((self.best[item], new)) if item in self.best else new
        self.best[item] = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))][: self.k]


def _kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def _search(docs: _Documents, lists: dict[int, _List], queries: _Queries, heaps: Heaps) -> None:
    """One shard's share of every item's k best."""
    k, sums = queries.k, np.zeros(len(docs.ids), dtype=np.int64)
    for item, (keys, weights, rest) in queries.items.items():
        own = [(lists[t], w, i) for i, (t, w) in enumerate(zip(keys, weights, strict=True)) if t in lists]
        if not own:
            continue
        floor = heaps.floor(item)

        def gather(some) -> tuple[np.ndarray, np.ndarray]:
            for plist, w, _ in some:
                rows, impacts = plist.all()
                sums[rows] += w * impacts
            rows = np.flatnonzero(sums)
            partial = sums[rows]
            sums[rows] = 0
            return rows, partial

        def complete(rows, partial, some, floor) -> tuple[np.ndarray, np.ndarray, int]:
            """Whole scores of the rows that may still reach floor."""
            for plist, w, i in some:
                # rest[i]: what this term and all lighter ones can add anywhere; a block's maximum says more, before it is unpacked
                live = partial + rest[i] >= floor
                rows, partial = rows[live], partial[live]
                blocks = plist.block_of(rows)
                live = partial + w * plist.bounds(blocks) + rest[i + 1] >= floor
                rows, partial, blocks = rows[live], partial[live], blocks[live]
                if not len(rows):
                    break
                partial = partial + w * plist.at(rows, blocks)
                floor = max(floor, _kth(partial, k))
            return rows, partial, floor

        if floor == 1:
            # a first floor: the best documents of the heaviest lists, scored in full
            some, held = 0, 0
            while some < len(own) and held < 4 * k:
                held += own[some][0].n
                some += 1
            rows, partial = gather(own[:some])
            top = np.argsort(-partial, kind="stable")[: 4 * k]
            top.sort()
            floor = max(1, _kth(complete(rows[top], partial[top], own[some:], 1)[1], k))
        # lists whose bounds together cannot reach the floor are not essential: they alone bring no candidate
        essential = sum(bool(rest[i] >= floor) for _, _, i in own)
        rows, partial = gather(own[:essential])
        rows, partial, floor = complete(rows, partial, own[essential:], floor)
        good = partial >= floor
        if good.any():
            rows = rows[good]
            heaps.add(item, partial[good], docs.null[rows], docs.ids[rows])


def _searched(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: _Queries = shared.value
        heaps, now, docs, lists = Heaps(queries.k), None, None, {}
        for batch in batches:
            cols = [batch.column(c) for c in range(8)]
            for r in range(batch.num_rows):
                shard, term = cols[0][r].as_py(), cols[1][r].as_py()
                if shard != now:
                    if lists:
                        _search(docs, lists, queries, heaps)
                    now, docs, lists = shard, None, {}
                if term is None:
                    docs = _Documents(cols[7][r].as_buffer(), queries)
                else:
                    firsts, max_tf, min_len, ends = (cols[c][r].values.to_numpy() for c in range(3, 7))
                    lists[term] = _List(firsts, max_tf, min_len, ends, cols[7][r].as_buffer(), cols[2][r].as_py(), docs, queries)
        if lists:
            _search(docs, lists, queries, heaps)
        rows = [(item, score, None if null else doc) for item, best in heaps.best.items() for score, null, doc in best.tolist()]
        out = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["item", "score", "doc_id"])

    return run


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        item = batch.column(0).to_numpy()
        for first, _, keys, row in terms(batch.column(1)):
            order = np.lexsort((keys, row))
            keys, row = keys[order], row[order]
            at = _runs(row, keys) if len(keys) else np.empty(0, np.int64)
            yield pa.record_batch([pa.array(item[first + row[at]]), pa.array(keys[at].view(np.int64)), pa.array(np.diff(np.append(at, len(keys))).astype(np.int64))], names=["item", "term", "repeats"])


def search(index: DataFrame, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", doc_col: str = "doc_id") -> DataFrame:
    """id_col, rank (int, from 1), doc_col, score of each item's k best documents with a score above 0; equal scores by ascending doc_col, null ids last.

    A term in df of N documents weighs w = floor(1000 ln((2N + 2) / (2 df + 1))); a document of n of all L terms has m = 25 + (75 n N) div L; its score sums
    w ((10^9 tf) div (1000 tf + 8 m)) over the item's terms, repeats included. Every row of items is an item of its own; one without terms has no rows.

    Items go in blocks of about QUERY_PAIRS pairs of item and term, each against all shards: the block is what tasks get by broadcast. In a task, terms
    are ordered by the largest score they give anywhere; those that together cannot lift a document among the item's k best are not essential and bring no
    candidates; candidates of the others are dropped by the maxima of non-essential blocks before these are unpacked. Tasks give k rows an item.
    """
    spark = items.sparkSession
    named = materialize(items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).alias("name"), F.col(text_col).alias("text")), "items")
    wanted = materialize(named.select("item", "text").mapInArrow(_query_terms, "item long, term long, repeats long").groupBy("item", "term").agg(F.sum("repeats").alias("repeats")), "wanted")
    total_docs, total_terms = index.where("term IS NULL").agg(F.sum("n"), F.sum("tokens")).first()
    blocks = -(-wanted.count() // QUERY_PAIRS) if total_terms else 0
    best = spark.createDataFrame([], "item long, score long, doc_id long")
    most = F.expr(f"array_max(zip_with(max_tf, min_len, (t, n) -> (1000000000L * t) div (1000L * t + 8 * (25 + (75 * n * {total_docs or 0}L) div {total_terms or 1}L))))")
    for block in range(blocks):
        pairs = wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        keys = F.broadcast(pairs.select("term").distinct())
        lists = index.join(keys, "term", "left_semi")
        known = {r.term: (math.floor(1000 * math.log((2 * total_docs + 2) / (2 * r.df + 1))), r.most) for r in lists.groupBy("term").agg(F.sum("n").alias("df"), F.max(most).alias("most")).collect()}
        by_item: dict[int, list[tuple[int, int, int]]] = {}
        for item, term, repeats in pairs.collect():
            if term in known:
                weight = known[term][0] * repeats
                by_item.setdefault(item, []).append((weight * known[term][1], term, weight))
        queries = _Queries({}, total_docs, total_terms, k)
        for item, rows in by_item.items():
            rows.sort(reverse=True)
            queries.items[item] = ([t for _, t, _ in rows], [w for _, _, w in rows], np.concatenate((np.cumsum([b for b, _, _ in rows][::-1])[::-1], [0])))
        cols = ["shard", "term", "n", "firsts", "max_tf", "min_len", "ends", "payload"]
        dealt = lists.select(*cols).unionByName(index.where("term IS NULL").select(*cols)).repartition(shuffle_partitions(spark), "shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())
        found = by_bytes(dealt).mapInArrow(_searched(spark.sparkContext.broadcast(queries)), "item long, score long, doc_id long")
        best = best.unionByName(materialize(found, "heaps"))
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    result = materialize(ranked.join(named.select("item", "name"), "item").select(F.col("name").alias(id_col), "rank", F.col("doc_id").alias(doc_col), "score"), "ranked")
    remove(spark, named, wanted, best)
    return result


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """`search` of items (item_id, text) over a fresh index of docs (doc_id, text), which is deleted afterwards.

    Null and empty texts have no terms. Documents with a null id count and rank, last among equals; repeated rows are documents each; other columns are ignored.
    """
    path = shared_dir(docs.sparkSession, "index")
    index = build_index(docs, path)
    result = search(index, items, k)
    remove(docs.sparkSession, index)
    return result
