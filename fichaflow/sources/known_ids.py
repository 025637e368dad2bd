"""Coin ids seen so far, in buckets with Bloom filters, so a look-up reads only buckets it may hit.

Ids lie in `ids/bucket=…/batch=…`, the filters' bits in `bits/bucket=…/batch=…` as (word, bits) rows. A look-up joins the
bits of its ids' buckets; only ids whose bits are all set can be known, and only their buckets of ids are read for the exact
answer. With more ids than the filters are sized for, more buckets are read; the answer stays exact. Each
batch adds one file per bucket, so batches should be few and large, or folders compacted from time to time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

KEY = ("machine_id", "uid")
WORD = 64


@dataclass
class KnownIds:
    """``buckets``, ``bits`` (a bucket's filter) and ``hashes`` are fixed once the first ids are added."""

    spark: SparkSession
    folder: str
    buckets: int = 64
    bits: int = 1 << 24
    hashes: int = 4

    def _bucketed(self, ids: DataFrame) -> DataFrame:
        bucket = F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int")
        return ids.where(F.col("uid").isNotNull()).select(*KEY).distinct().withColumn("bucket", bucket)

    def _places(self, ids: DataFrame) -> DataFrame:
        """One row per id and hash: word and mask of its bit."""
        place = lambda i: F.pmod(F.xxhash64(F.lit(i), *KEY), F.lit(self.bits))
        at = F.explode(F.array(*[place(i) for i in range(self.hashes)])).alias("at")
        return ids.select(*KEY, "bucket", at).select(
            *KEY, "bucket", F.floor(F.col("at") / WORD).cast("int").alias("word"),
            F.expr(f"shiftleft(1L, cast(at % {WORD} AS INT))").alias("mask"),
        )

    def _write(self, rows: DataFrame, name: str, batch: str) -> None:
        rows = rows.withColumn("batch", F.lit(batch)).repartition("bucket").sortWithinPartitions("bucket")
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch")
        writer.parquet(f"{self.folder.rstrip('/')}/{name}")

    def _read(self, name: str, schema: str, ahead_of: Column | None) -> DataFrame | None:
        try:
            rows = self.spark.read.schema(f"{schema}, bucket int, batch string").parquet(f"{self.folder.rstrip('/')}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return rows if ahead_of is None else rows.where(ahead_of)

    def add(self, ids: DataFrame, batch: str) -> None:
        """Remember ids (machine_id, uid). A batch that is added again replaces what it added before in the same buckets."""
        ids = self._bucketed(ids)
        self._write(ids, "ids", batch)
        words = self._places(ids).groupBy("bucket", "word").agg(F.bit_or("mask").alias("bits"))
        self._write(words, "bits", batch)

    def hits(self, ids: DataFrame, ahead_of: Column | None = None) -> DataFrame | None:
        """(machine_id, uid, bucket) of those of ``ids`` whose bits are all set; None before the first batch."""
        bits = self._read("bits", "word int, bits long", ahead_of)
        if bits is None:
            return None
        ids = self._bucketed(ids)
        bits = bits.groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
        found = self._places(ids).join(bits, ["bucket", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) != 0)
        return found.groupBy(*KEY, "bucket").agg(F.count("*").alias("n")).where(F.col("n") == self.hashes).drop("n")

    def known(self, ids: DataFrame, ahead_of: Column | None = None) -> DataFrame | None:
        """Those of ``ids`` that are known, once each; ``ahead_of`` is a condition on ``batch``. None before the first batch."""
        hits = self.hits(ids, ahead_of)
        if hits is None:
            return None
        touched = [r["bucket"] for r in hits.select("bucket").distinct().collect()]  # one per bucket at most
        stored = self._read("ids", "machine_id string, uid string", ahead_of).where(F.col("bucket").isin(touched))
        return hits.join(stored, [*KEY, "bucket"], "left_semi").select(*KEY)
