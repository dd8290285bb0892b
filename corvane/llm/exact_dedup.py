"""Exact dedup by Grace hashing: partition, spill and repartition until a bucket fits a table of contents."""

from __future__ import annotations

import os
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import by_bytes, shuffle_partitions

FAN_OUT_BITS = 4
_HEAD = struct.Struct("<QqqBI")  # key, largest id, copies, has an id, bytes of content

Entry = tuple[int, bytes, "int | None", int]


class ContentTable:
    """Open addressing with linear probing; equal keys are told apart by their complete contents."""

    def __init__(self) -> None:
        self.slots = np.full(1024, -1, dtype=np.int64)
        self.keys: list[int] = []
        self.contents: list[bytes] = []
        self.ids: list[int | None] = []
        self.copies: list[int] = []
        self.bytes = 0

    def add(self, key: int, content: bytes, doc_id: int | None, copies: int) -> None:
        slots, mask = self.slots, len(self.slots) - 1
        at = key & mask
        while (k := slots[at]) >= 0:
            if self.keys[k] == key and self.contents[k] == content:
                if doc_id is not None and (self.ids[k] is None or doc_id > self.ids[k]):
                    self.ids[k] = doc_id
                self.copies[k] += copies
                return
            at = (at + 1) & mask
        slots[at] = len(self.keys)
        self.keys.append(key)
        self.contents.append(content)
        self.ids.append(doc_id)
        self.copies.append(copies)
        self.bytes += len(content) + 200
        if 2 * len(self.keys) > len(slots):
            self._grow()

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, dtype=np.int64)
        mask = len(self.slots) - 1
        for k, key in enumerate(self.keys):
            at = key & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k

    def entries(self) -> Iterator[Entry]:
        return zip(self.keys, self.contents, self.ids, self.copies, strict=True)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Entry]:
    for batch in batches:
        key, content, doc_id, copies = (batch.column(k) for k in range(4))
        for k in range(len(batch)):
            yield key[k].as_py() & 0xFFFFFFFFFFFFFFFF, content[k].as_buffer().to_pybytes(), doc_id[k].as_py(), copies[k].as_py()


def _batch(entries: list[Entry]) -> pa.RecordBatch:
    signed = [e[0] - (1 << 64) if e[0] >> 63 else e[0] for e in entries]
    return pa.record_batch(
        [pa.array(signed, pa.int64()), pa.array([e[1] for e in entries], pa.binary()), pa.array([e[2] for e in entries], pa.int64()), pa.array([e[3] for e in entries], pa.int64())],
        names=["key", "content", "doc_id", "copies"],
    )


def _packed(entries: Iterator[Entry], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for e in entries:
        held.append(e)
        size += len(e[1]) + 64
        if size >= most_bytes:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def combine(budget: int):
    """Map side: one entry per distinct content of what the table holds before it is emptied."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable()
        for row in _rows(batches):
            if table.bytes + len(row[1]) > budget and table.keys:
                yield from _packed(table.entries())
                table = ContentTable()
            table.add(*row)
        yield from _packed(table.entries())

    return run


def grace(rows: Iterator[Entry], budget: int, depth: int = 0) -> Iterator[Entry]:
    """One entry per distinct content. Beyond the budget, rows go to spill files by the next bits of the key."""
    table = ContentTable()
    for row in rows:
        table.add(*row)
        if table.bytes > budget and len(table.keys) > 1 and FAN_OUT_BITS * (depth + 1) < 64:
            break
    else:
        yield from table.entries()
        return
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        names = [os.path.join(folder, f"{k:x}") for k in range(1 << FAN_OUT_BITS)]
        files = [open(name, "wb") for name in names]  # noqa: SIM115
        try:
            shift = 64 - FAN_OUT_BITS * (depth + 1)
            for source in (table.entries(), rows):
                for key, content, doc_id, copies in source:
                    out = files[(key >> shift) & ((1 << FAN_OUT_BITS) - 1)]
                    out.write(_HEAD.pack(key, doc_id or 0, copies, doc_id is not None, len(content)))
                    out.write(content)
        finally:
            for f in files:
                f.close()
        del table
        for name in names:
            yield from grace(_spilled(name), budget, depth + 1)
            os.unlink(name)


def _spilled(name: str) -> Iterator[Entry]:
    with open(name, "rb") as f:
        while head := f.read(_HEAD.size):
            key, doc_id, copies, has_id, n = _HEAD.unpack(head)
            yield key, f.read(n), doc_id if has_id else None, copies


def _finish(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        held: list[tuple[str, int | None, int]] = []
        for _, content, doc_id, copies in grace(_rows(batches), budget):
            held.append((hashlib.sha256(content).hexdigest(), doc_id, copies))
            if len(held) == 50_000:
                yield _groups(held)
                held = []
        if held:
            yield _groups(held)

    return run


def _groups(held: list[tuple[str, int | None, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x[k] for x in held], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["text_sha256", "keep_id", "group_size"])


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget_bytes: int = 32 << 20) -> DataFrame:
    """One row per distinct text: text_sha256, keep_id (largest id), group_size (rows, repeated ones counted).

    The map side folds copies within a task before anything moves, so a text that fills a third of
    the table reaches its bucket as one entry per task. A bucket is one shuffle partition by the first 64 bits
    of SHA-256; where its distinct contents exceed budget_bytes it is split again into spill files of the task.
    """
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.col(id_col).cast("long").alias("doc_id"))
    rows = rows.select(
        F.expr("cast(conv(substring(sha2(t, 256), 1, 16), 16, -10) as bigint)").alias("key"),
        F.col("t").cast("binary").alias("content"), "doc_id", F.lit(1).cast("long").alias("copies"),
    )
    schema = "key long, content binary, doc_id long, copies long"
    part = by_bytes(rows).mapInArrow(combine(budget_bytes), schema)
    buckets = part.repartition(shuffle_partitions(docs.sparkSession), "key")
    return by_bytes(buckets).mapInArrow(_finish(budget_bytes), "text_sha256 string, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget_bytes: int = 32 << 20) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text counts as empty. The row with the largest id stays;
    rows that repeat that id all stay, and where all ids of a group are null, keep_id is null and all stay. An empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    groups = content_groups(docs, id_col, text_col, budget_bytes)
    rows = docs.select(F.col(id_col), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256"))
    return rows.join(groups, "text_sha256").select(
        F.col(id_col), "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget_bytes: int = 32 << 20) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns."""
    groups = content_groups(docs, id_col, text_col, budget_bytes).select(F.struct("text_sha256", "keep_id").alias("g"))
    rows = docs.select(F.struct("*").alias("r"))
    same = F.sha2(F.coalesce(F.col("r")[text_col], F.lit("")), 256) == F.col("g.text_sha256")
    return rows.join(groups, same & F.col("r")[id_col].cast("long").eqNullSafe(F.col("g.keep_id")), "left_semi").select("r.*")
