"""Staging and swapping of table folders, through the file system Spark itself uses."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    fs, at = _fs(spark, old)
    if not fs.rename(at, _fs(spark, new)[1]):
        raise OSError(f"cannot rename {old} to {new}")


def recover(spark: SparkSession, target: str) -> None:
    """After a swap that stopped half-way: the old folder takes its place again."""
    if not exists(spark, target) and exists(spark, target + ".old"):
        _rename(spark, target + ".old", target)


def swap(spark: SparkSession, staged: str, target: str) -> None:
    """Put a finished folder in the place of another; the old one stays until the new one stands."""
    recover(spark, target)
    delete(spark, target + ".old")
    if exists(spark, target):
        _rename(spark, target, target + ".old")
    _rename(spark, staged, target)
    delete(spark, target + ".old")


@contextmanager
def staged(rows: DataFrame, folder: str, name: str, *by: str) -> Iterator[str]:
    """Path of the rows as a written table beside the others, removed afterwards."""
    path = f"{folder.rstrip('/')}/staging/{name}-{uuid.uuid4().hex}"
    try:
        rows.write.partitionBy(*by).parquet(path)
        yield path
    finally:
        delete(rows.sparkSession, path)
