"""Embedding near-dedup by collision counting over many sorted one-dimensional projections."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import by_bytes, connected_components, materialize, remove

#: Signs of further projections, two longs a vector, whose disagreements hold strangers back before they are counted.
SKETCH_BITS = 128
#: Vectors of a cell, about, before its window is applied.
PER_CELL = 32
_CELLS = "cell long, p double, id long, s0 long, s1 long"


def _missed(trials: int, p: float, least: int) -> float:
    """The chance that fewer than least of trials succeed."""
    return sum(math.comb(trials, c) * p**c * (1 - p) ** (trials - c) for c in range(least))


def plan(n: int, cosine: float, recall: float) -> tuple[int, int, float, int, int]:
    """(tables, sign bits per table, half width of the window, least collisions, most sketch disagreements) for n vectors.

    A pair at the given cosine collides in a table when its sign bits agree and its projection, of unit-variance Gaussian
    directions, differs by at most the half width. Bits grow with the logarithm of n, so a cell holds about PER_CELL vectors at
    any n, and tables grow with them: as many as let such a pair collide twice with probability recall. Tables, and with
    them all work, therefore grow as n to the power log2(1 / agreement of a bit), 0.224 at a cosine of 0.9. The least count
    is the largest that the pair still reaches with probability recall.
    """
    half = 1.3 * math.sqrt(2 - 2 * cosine)
    agree = 1 - math.acos(cosine) / math.pi
    bits = max(2, math.ceil(math.log2(max(n, 2) / PER_CELL)))
    p = math.erf(1.3 / math.sqrt(2)) * agree**bits
    tables = 8
    while _missed(tables, p, 2) > 1 - recall:
        tables += max(1, tables // 16)
    least = 2
    while _missed(tables, p, least + 1) <= 1 - recall:
        least += 1
    differ = SKETCH_BITS
    while _missed(SKETCH_BITS, 1 - agree, differ) >= 1 - (1 - recall) / 1000:
        differ -= 1
    return tables, bits, half, least, differ


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vid, digest, u) of usable vectors: scaled by their largest component first, so that squares neither overflow nor vanish."""
    for batch in batches:
        ids, digests, units = [], [], []
        for i, v in zip(batch.column(0), batch.column(1), strict=True):
            if not i.is_valid or not v.is_valid or v.values.null_count or not len(v.values):
                continue
            x = v.values.to_numpy().astype(np.float64) + 0.0
            top = np.abs(x).max()
            if not np.isfinite(top) or top == 0:
                continue
            ids.append(i)
            digests.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
            x = x / top
            units.append(x / np.sqrt((x * x).sum()))
        yield pa.record_batch([pa.array([i.as_py() for i in ids], pa.int64()), pa.array(digests, pa.binary()), pa.array(units, pa.list_(pa.float64()))], names=["vid", "h", "u"])


def _project(tables: int, bits: int, seed: int):
    """Rows (cell, projection, id, sketch) of each vector in each table. Directions follow from length, table and seed alone."""

    def rows(ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        dim = x.shape[1]
        signs = x @ np.random.default_rng([seed, dim]).standard_normal((dim, SKETCH_BITS)) > 0
        sketch = np.packbits(signs, axis=1).view(np.int64)
        for table in range(tables):
            p = x @ np.random.default_rng([seed, dim, table]).standard_normal((dim, bits + 1))
            code = ((p[:, 1:] > 0) << np.arange(bits)).sum(axis=1)
            cell = (dim % (1 << 20) << 43) + (table << 32) + code
            yield pa.record_batch([pa.array(c) for c in (cell.astype(np.int64), p[:, 0].copy(), ids, sketch[:, 0].copy(), sketch[:, 1].copy())], names=["cell", "p", "id", "s0", "s1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), batch.column(1)
            length = vectors.value_lengths().to_numpy()
            for dim in np.unique(length):
                same = np.flatnonzero(length == dim)
                most = max(1, (1 << 20) // int(dim))
                for at in range(0, len(same), most):
                    part = same[at : at + most]
                    x = vectors.take(pa.array(part)).flatten().to_numpy().reshape(len(part), int(dim))
                    yield from rows(ids[part], x)

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, recall: float = 0.999, seed: int = 7) -> DataFrame:
    """One row per input row: id_col, n_links (other vectors at the cosine or above), component_id, kept.

    Null, empty and zero vectors and those with null or non-finite components link with nothing; vectors of
    different length do not link; a null id has null component_id and kept; rows of equal id should be equal. Equal
    vectors are one class, counted by its size, so copies never meet in pairs. Each table deals the classes by the signs
    of some projections and sorts a cell by one more; every vector's window there yields its collisions. Pairs that
    collide in enough tables are verified on the complete vectors in double precision. Other columns are ignored.
    Runs jobs when called: intermediate tables go to the shared folder.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vid"), F.col(vector_col).cast("array<double>").alias("v"))
    units = materialize(by_bytes(rows).mapInArrow(_unit, "vid long, h binary, u array<double>"), "units")
    usable = units.groupBy("vid").agg(F.min("h").alias("h"))
    classes = usable.groupBy("h").agg(F.min("vid").alias("id"), F.count("*").alias("copies"))
    first = units.select(F.col("vid").alias("id"), F.col("h").alias("uh"), "u")
    classes = materialize(classes.join(first, "id").where("h = uh").drop("uh").dropDuplicates(["id"]), "vectors")
    tables, bits, half, least, differ = plan(classes.count(), cosine, recall)
    cells = by_bytes(classes.select("id", "u")).mapInArrow(_project(tables, bits, seed), _CELLS)
    # slots of the window's width: a window reaches into the next slot only, once pairs are put in order
    cells = materialize(cells.withColumn("slot", F.floor(F.col("p") / half).cast("long")), "cells")
    left = cells.select("cell", "p", "id", "s0", "s1", F.explode(F.array("slot", F.col("slot") + 1)).alias("slot"), F.col("slot").alias("own"))
    right = cells.select("cell", "slot", F.col("p").alias("q"), F.col("id").alias("other"), F.col("s0").alias("o0"), F.col("s1").alias("o1"))
    alike = F.bit_count(F.col("s0").bitwiseXOR(F.col("o0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("o1"))) <= differ
    once = (F.col("own") != F.col("slot")) | (F.col("id") < F.col("other"))
    near = left.join(right, ["cell", "slot"]).where((F.abs(F.col("p") - F.col("q")) <= half) & once & alike)
    pairs = near.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.count("*").alias("hits")).where(F.col("hits") >= least)
    ends = classes.select("id", "u", "copies")
    both = pairs.select("a", "b").join(ends.toDF("a", "x", "xc"), "a").join(ends.toDF("b", "y", "yc"), "b").where("size(x) = size(y)")
    dot = F.aggregate(F.zip_with("x", "y", lambda x, y: x * y), F.lit(0.0), lambda s, c: s + c)
    links = materialize(both.where(dot >= cosine).select("a", "b", "xc", "yc"), "links")
    remove(spark, cells)
    ends = links.select(F.col("a").alias("id"), F.col("yc").alias("k")).union(links.select("b", "xc"))
    degree = ends.groupBy("id").agg(F.sum("k").alias("k"))
    comps = connected_components(links)
    found = classes.select("id", "h", "copies").join(degree, "id", "left").join(comps, "id", "left")
    found = found.select("h", (F.coalesce("k", F.lit(0)) + F.col("copies") - 1).alias("k"), F.coalesce("component", "id").alias("c"))
    of = usable.join(found, "h").select(F.col("vid").alias("o"), "k", "c")
    out = rows.select("vid").join(of, F.col("vid") == F.col("o"), "left").select(
        F.col("vid").alias(id_col), F.coalesce("k", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vid").alias("component_id")
    )
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))
