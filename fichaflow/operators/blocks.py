"""Ordered per-key scans that survive hot keys.

A window over one machine or employee puts all of its rows into one task. Keys
above ``BLOCK_ROWS`` rows are therefore cut into blocks of that many rows by their
rank in the order, whatever the gaps in the positions. Scans run inside a block, a small
per-block summary is scanned per key, and its result is carried into the blocks.
Keys below the limit form one block (``-1``) and pay nothing.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

BLOCK_ROWS = 2_000_000
BLK = "_blk"


class HotKeys(NamedTuple):
    """keys: the hot keys; cuts: position and block of each of their rows, if asked for."""

    keys: DataFrame
    block_rows: int
    cuts: DataFrame | None


def find_hot_keys(
    rows: DataFrame, key: str, block_rows: int = BLOCK_ROWS, position: str | None = "seq"
) -> HotKeys | None:
    """Keys with more than ``block_rows`` rows, or None.

    Counts the key column once to see whether there are any. The keys and their blocks stay
    distributed, however many there are.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    keys = counts.where((F.col("_n") > block_rows) & F.col(key).isNotNull()).select(key)
    if keys.isEmpty():
        return None
    keys = checkpoint(keys)
    if position is None:
        return HotKeys(keys, block_rows, None)
    return HotKeys(keys, block_rows, cut_by_rank(rows.select(key, position).join(keys, key), key, block_rows, position))


def cut_by_rank(rows: DataFrame, key: str, block_rows: int, position: str = "seq") -> DataFrame:
    """(position, block) of all rows: block n of a key has its rows of rank n * ``block_rows`` and on.

    Rows are range-partitioned in order, so a key may span many partitions; each partition's
    share of a key starts at the sum of the shares ahead of it.
    """
    numbered = number_rows(rows.select(key, position), key, position, position="_at")
    numbered = numbered.withColumn("_part", F.shiftright("_at", 33))
    shares = numbered.groupBy(key, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    ahead = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.withColumn("_ahead", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    rank = F.col("_ahead") + F.col("_at") - F.col("_first")
    return numbered.join(shares, [key, "_part"]).select(position, F.floor(rank / block_rows).cast("long").alias(BLK))


def with_blocks(rows: DataFrame, key: str, hot: HotKeys | None, position: str = "seq") -> DataFrame:
    """Add the block number; ``position`` must be unique and ascending. Joins on it, which no key can skew."""
    if hot is None:
        return rows.withColumn(BLK, F.lit(-1).cast("long"))
    return rows.join(hot.cuts, position, "left").withColumn(BLK, F.coalesce(BLK, F.lit(-1).cast("long")))


def hot_blocks(rows: DataFrame, key: str, hot: HotKeys, position: str = "seq") -> DataFrame:
    """Only the rows of hot keys, with their block numbers."""
    return rows.join(hot.cuts, position)


def ordered_window(key: str, position: str = "seq") -> Window:
    return Window.partitionBy(key, BLK).orderBy(position)


def block_window(key: str) -> Window:
    """Over block summaries: at most one row per block."""
    return Window.partitionBy(key).orderBy(BLK)


def checkpoint(rows: DataFrame) -> DataFrame:
    """Cut lineage in the cluster's shared checkpoint folder."""
    ensure_checkpoint_dir(rows.sparkSession)
    return rows.checkpoint()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = context.getConf().get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        import tempfile

        context.setCheckpointDir(tempfile.mkdtemp(prefix="fichaflow-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


def number_rows(rows: DataFrame, *order: str, position: str = "_pos") -> DataFrame:
    """Ascending unique positions in the given total order.

    Range partitioning balances any skew because the order columns are unique
    together. The numbers depend on where the ranges fall, so they are checkpointed
    before anything reads them twice.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return checkpoint(ranged.withColumn(position, F.monotonically_increasing_id()))
