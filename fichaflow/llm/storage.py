"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset, as in tests on one machine, a new folder here."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        context.setCheckpointDir(folder)
    return folder


#: Paths written during a tracked call, and those of the call before, whose result has been stored since.
_made: list[str] | None = None
_done: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame as a written table: computed once, and read again if an executor is lost."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _made is not None:
        _made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard_stored(df: DataFrame) -> None:
    """Delete a stored table that nothing reads any more: all that came of it is stored itself."""
    for file in df.inputFiles()[:1]:
        discard(df.sparkSession, file.rpartition("/")[0])


@contextmanager
def tracked(spark: SparkSession) -> Iterator[None]:
    """Remember what is stored meanwhile, and delete what the tracked call before this one stored.

    For calls whose results are written before the next one begins, as stages of a pipeline are.
    """
    global _made
    for path in _done:
        discard(spark, path)
    _done.clear()
    _made = []
    try:
        yield
    finally:
        _done.extend(_made)
        _made = None
