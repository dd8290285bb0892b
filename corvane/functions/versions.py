"""Tables in versions: folders, and a marker written last that says which of them count, so that a reader sees the state before or after, never half of one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def folders(spark: SparkSession, path: str, prefix: str, whole: bool = True) -> list[int]:
    """The numbers of the folders prefix=number below path, ascending; whole: of those that a writer has finished."""
    fs, at = _fs(spark, path)
    if not fs.exists(at(path)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at(path))]
    found = sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{prefix}="))
    return [n for n in found if not whole or fs.exists(at(f"{path}/{prefix}={n}/_SUCCESS"))]


def current(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """(version, upto) of the last marker: the version that counts, and the last batch that is part of it."""
    fs, at = _fs(spark, f"{path}/marker")
    if not fs.exists(at(f"{path}/marker")):
        return None
    names = [s.getPath().getName().split("-") for s in fs.listStatus(at(f"{path}/marker"))]
    found = [(int(n[1]), int(n[2])) for n in names if n[0] == "v"]
    return max(found) if found else None


def mark(spark: SparkSession, path: str, version: int, upto: int) -> None:
    """From now on this version counts; creating an empty file is what no reader sees half of."""
    fs, at = _fs(spark, path)
    fs.create(at(f"{path}/marker/v-{version}-{upto}"), True).close()


def drop(spark: SparkSession, path: str, prefix: str, numbers: list[int]) -> None:
    fs, at = _fs(spark, path)
    for n in numbers:
        fs.delete(at(f"{path}/{prefix}={n}"), True)


def read_folders(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    return spark.read.parquet(*[f"{path}/{n}" for n in names])
