"""Shared storage, connected components and shingle hashing for the operators of this subpackage."""

from __future__ import annotations

import gc
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch, about, that goes to a Python worker.
BATCH_BYTES = 4 << 20
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, or the context's checkpoint folder; a temporary one only in local mode where neither is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _own_dirs.setdefault(app, "file://" + tempfile.mkdtemp(prefix="spark-corvane-"))
    return f"{base.rstrip('/')}/corvane/{name}-{uuid.uuid4().hex}"


def by_bytes(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches bounded by BATCH_BYTES: what a batch of texts takes on both sides of a worker then follows from
    that and not from their lengths. A lower bound of the session's own stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    have = conf.get(name).lower().removesuffix("b")
    if not have.isdigit() or int(have) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files of materialized tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for frame in frames:
        for parent in {f.rpartition("/")[0] for f in frame.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished queries now: Spark deletes them once the driver's collector has seen their plans go."""
    gc.collect()
    spark.sparkContext._jvm.java.lang.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Edges, 16 bytes each, that one task contracts without a shuffle.
FEW_EDGES = 400_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable from every id that occurs in edges.

    Alternating large-star and small-star contraction (Kiveris et al., 2014), all joins and
    aggregations; each round is a table in the shared folder. Self-loops and null ends are ignored. It ends when
    a round changes nothing, after about the logarithm of the largest component's size in rounds. Up to FEW_EDGES the rounds
    run in one task, beyond them in as many as the session's shuffles have.
    """
    spark = edges.sparkSession
    u, v = F.greatest(a, b), F.least(a, b)
    now = materialize(edges.where(F.col(a) != F.col(b)).select(u.alias("u"), v.alias("v")).distinct(), "edges")
    before = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or seen == before:
            break
        before = seen
        # a bounded table needs no shuffle: its rounds are one task each
        edges_now = now.coalesce(1) if seen[0] <= FEW_EDGES else now
        both = edges_now.union(edges_now.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m"))
        after = materialize(small.distinct(), "edges")
        remove(spark, now)
        now = after
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


# --- shingles -----------------------------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}
SLICE_BYTES = 1 << 18
LONG_WORD = 256


def _power_table(base: int, n: int) -> np.ndarray:
    key = f"{base}"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= 4 * SLICE_BYTES:
            _powers[key] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer, so that every bit of the key depends on every bit of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs from starts to ends, polynomials from one running sum over raw. Runs beyond LONG_WORD are better hashed alone."""
    n = len(raw)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, n)[:n], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power_table(_INVERSE, n)[starts] + (ends - starts).astype(np.uint64))


def text_slices(column: pa.Array) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about SLICE_BYTES of UTF-8; a longer text stands alone."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    column = column.fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = memoryview(column.buffers()[2]) if column.buffers()[2] is not None else memoryview(b"")
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1)
        last = min(last, len(column))
        yield first, bytes(data[offsets[first] : offsets[last]]), offsets[first : last + 1] - offsets[first]
        first = last


def shingle_sets(column: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit keys of its word shingles) for each row of a string column.

    A-Z are lower-cased and words are runs of anything but ASCII white space. A text of fewer words is
    one shingle; a null text or one without words has none. Word keys are polynomial hashes
    from one running sum over the slice, so no word is cut out as a Python object.
    """
    for first, data, offsets in text_slices(column):
        data = data.translate(_LOWER)
        raw = np.frombuffer(data, dtype=np.uint8)
        n = len(raw)
        if not n:
            for k in range(len(offsets) - 1):
                yield first + k, np.empty(0, np.uint64)
            continue
        word = ~_SPACE[raw]
        edge = np.zeros(n + 1, dtype=bool)  # where a document begins
        edge[offsets] = True
        before = np.empty(n, dtype=bool)
        before[0] = False
        before[1:] = word[:-1]
        starts = np.flatnonzero(word & (~before | edge[:n]))
        after = np.empty(n, dtype=bool)
        after[-1] = False
        after[:-1] = word[1:]
        ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        keys = word_hashes(raw, starts, ends)
        # sums mod 2^64 collide by construction for some words of thousands of bytes, so long ones are hashed alone
        for k in np.flatnonzero(ends - starts > LONG_WORD):
            keys[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8).digest(), "little")
        at = np.searchsorted(starts, offsets)  # the first word of each document
        rolled = np.zeros(max(0, len(keys) - words + 1), dtype=np.uint64)
        for k in range(words):
            rolled = mix(rolled * np.uint64(3) + keys[k : k + len(rolled)])
        for k in range(len(offsets) - 1):
            i, j = int(at[k]), int(at[k + 1])
            if j - i >= words:
                own = np.sort(rolled[i : j - words + 1])
                if len(own) > 1:
                    own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif j > i:
                own = np.array([j - i], dtype=np.uint64)
                for x in keys[i:j]:
                    own = mix(own * np.uint64(5) + x)
            else:
                own = np.empty(0, np.uint64)
            yield first + k, own
