"""Compression classifier: the difference of sizes under a good and a bad zstandard dictionary, calibrated."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import by_bytes

PIECE_BYTES = 4096


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    level: int


def _compressors(model: Model):
    return [zstd.ZstdCompressor(level=model.level, dict_data=zstd.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]


def features(text: bytes, compressors) -> list[float]:
    """The normalised size difference, the size under the better dictionary, and the share of bytes that repetition saves."""
    sizes, n = np.zeros(2), len(text)
    if not n:
        return [0.0, 0.0, 0.0]
    for at in range(0, n, PIECE_BYTES):
        piece = text[at : at + PIECE_BYTES]
        sizes += [len(c.compress(piece)) for c in compressors]
    return [float((sizes[1] - sizes[0]) / sizes.max()), float(sizes.min() / n), float(abs(sizes[1] - sizes[0]) / n)]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _measured(batches: Iterator[pa.RecordBatch], compressors) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(2))
        x = np.array([features(t, compressors) for t in texts]).reshape(-1, 3)
        yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(x[:, k]) for k in range(3))], names=["i", "y", "difference", "size", "saved"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 1500, build_bytes: int = 1 << 23, dict_bytes: int = 65536, level: int = 3) -> Model:
    """Dictionaries and calibration from a bounded sample: sample_rows labelled documents per class, by a hash of the id.

    The dictionaries are built from two thirds of the sample, whole texts: of those up to an eighth of build_bytes, the first in the order of
    the hash that together stay within build_bytes a class. The calibration is fitted on the rest, whose whole texts are measured in
    Spark tasks, so the driver holds build_bytes a class and three numbers a document. A calibration row weighs as many labelled documents
    as it stands for, so the prior is that of all labels at any size. An id with both labels counts as 1. Rows without label or text are left out; without both classes the model scores the
    labels' rate throughout. Runs jobs when called.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).alias("y"))
    texts_of = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null and t != ''")
    known = known.join(texts_of.select("i"), "i", "left_semi")
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    order = F.xxhash64("i")
    picked = known.where("y = 1").orderBy(order).limit(sample_rows).union(known.where("y = 0").orderBy(order).limit(sample_rows))
    sample = texts_of.join(F.broadcast(picked), "i")
    builds = F.pmod(F.xxhash64("i", F.lit(1)), F.lit(3)) > 0
    size = F.octet_length("t").cast("long")
    filled = F.sum("size").over(Window.partitionBy("y").orderBy(F.xxhash64("i"), "i", "t").rowsBetween(Window.unboundedPreceding, 0))
    whole = sample.where(builds).withColumn("size", size).where(F.col("size") <= build_bytes // 8).withColumn("filled", filled)
    build = [(r["t"].encode("utf-8", "surrogatepass"), r["y"]) for r in whole.where(F.col("filled") <= build_bytes).select("i", "y", "t").orderBy("i", "t").collect()]
    share = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
    flat = Model(b"", b"", (0.0, 0.0, 0.0, float(np.log(share / (1 - share)))), level)
    if len({y for _, y in build}) < 2:
        return flat
    dicts = []
    for y in (1, 0):
        pieces = [text[at : at + PIECE_BYTES] for text, own in build if own == y for at in range(0, len(text), PIECE_BYTES)]
        try:
            dicts.append(zstd.train_dictionary(dict_bytes, pieces).as_bytes())
        except zstd.ZstdError:  # too few samples to train on: their own texts serve as a dictionary
            dicts.append(b"\n".join(pieces))
    draft = Model(dicts[0], dicts[1], (), level)
    rest = sample.where(~builds).select("i", F.col("y").cast("int").alias("y"), "t")
    measured = by_bytes(rest).mapInArrow(lambda batches: _measured(batches, _compressors(draft)), f"i {rest.schema['i'].dataType.simpleString()}, y int, difference double, size double, saved double").orderBy("i").toPandas()
    y = measured["y"].to_numpy(dtype=float)
    if len(set(y)) < 2:
        return flat
    weight = np.where(y == 1, totals[1] / y.sum(), totals[0] / (1 - y).sum()) * (len(y) / sum(totals.values()))
    w = _logistic(measured[["difference", "size", "saved"]].to_numpy(), y, weight)
    return Model(dicts[0], dicts[1], tuple(w.tolist()), level)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score in 0 to 1 of every whole text, cut into pieces that are compressed each. Null and empty texts get
    the score of zero features. Repeated rows are scored each; other columns are ignored; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(model.weights)
        compressors = _compressors(model) if model.good else None
        for batch in batches:
            texts = (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(1))
            x = np.array([features(t, compressors) if compressors else [0.0] * 3 for t in texts]).reshape(-1, 3)
            yield pa.record_batch([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))))], names=["i", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    return by_bytes(rows).mapInArrow(run, "i long, score double").withColumnRenamed("i", id_col)


def keep_good(docs: DataFrame, model: Model, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score at least the threshold; one pass, no join."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(model.weights)
        compressors = _compressors(model) if model.good else None
        for batch in batches:
            texts = (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(at))
            x = np.array([features(t, compressors) if compressors else [0.0] * 3 for t in texts]).reshape(-1, 3)
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))) >= least))

    return by_bytes(docs).mapInArrow(run, docs.schema)
