"""Coin de-duplication by id and by time, and admission to the ledger."""

from __future__ import annotations

import heapq
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from fichaflow import schemas as S
from fichaflow.functions.times import micros
from fichaflow.operators.blocks import (
    BLK, HotKeys, block_window, hot_blocks, ordered_window, with_blocks,
)

ACCEPTED, DUPLICATE, RATE_LIMIT = "accepted", "duplicate", "rate_limit"
GHOST, TEST = "ghost_coin", "test_coin"
_NEVER = -(2**62)

# the Arrow functions below travel with the job: workers need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: Known ids (machine_id, uid), or a function from the ids in question to those of them that are known.
KnownIds = DataFrame | Callable[[DataFrame], DataFrame | None] | None


def first_per_id(coins: DataFrame, known_ids: KnownIds = None) -> DataFrame:
    """Arrival number of the first coin of every (machine, id) not seen before.

    A grouped minimum, so copies of one id collapse before the shuffle.
    """
    firsts = coins.where(F.col("uid").isNotNull()).groupBy("machine_id", "uid").agg(F.min("seq").alias("seq"))
    if callable(known_ids):
        known_ids = known_ids(firsts.select("machine_id", "uid"))
    if known_ids is not None:
        firsts = firsts.join(known_ids.select("machine_id", "uid"), ["machine_id", "uid"], "left_anti")
    return firsts.select("seq")


def mark_id_duplicates(coins: DataFrame, known_ids: KnownIds = None) -> DataFrame:
    """Add ``duplicate``. Joins on the unique arrival number, which no id can skew."""
    firsts = first_per_id(coins, known_ids).withColumn("_first", F.lit(True))
    marked = coins.join(firsts, "seq", "left")
    return marked.withColumn("duplicate", F.col("uid").isNotNull() & F.col("_first").isNull()).drop("_first")


def _with_cuts(rows: DataFrame, window_us: int) -> DataFrame:
    """``_cut``: rows accepted whatever was accepted before them.

    The last accepted time never exceeds the running maximum of all times, so a coin
    a full window past that maximum, or one with an id not below it, always resets
    the chain. Late coins need no special case.
    """
    w = ordered_window("machine_id")
    ahead = w.rowsBetween(Window.unboundedPreceding, -1)
    counted = F.when(~F.col("duplicate"), F.col("_us"))
    run_max = F.greatest(F.max(counted).over(ahead), F.col("_in_max"))
    margin = F.when(F.col("uid").isNull(), F.lit(window_us)).otherwise(F.lit(0))
    resets = run_max.isNull() | (F.col("_us") >= run_max + margin)
    return rows.withColumn("_cut", ~F.col("duplicate") & resets)


def _fold(window_us: int):
    """Greedy acceptance over batches ordered by machine, block and arrival.

    Only the last accepted time is kept between rows, so memory does not grow with
    the block. Rows between two cuts are the only ones looped over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, _NEVER
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            names = batch.column("machine_id")
            blocks = batch.column(BLK).to_numpy(zero_copy_only=False)
            times = batch.column("_us").to_numpy(zero_copy_only=False)
            cuts = batch.column("_cut").to_numpy(zero_copy_only=False)
            has_id = batch.column("_has_id").to_numpy(zero_copy_only=False)
            repeat = batch.column("duplicate").to_numpy(zero_copy_only=False)
            start = batch.column("_in_last").fill_null(_NEVER).to_numpy(zero_copy_only=False)
            keep = np.ones(n, dtype=bool)
            between = np.flatnonzero(~cuts)
            for stretch in np.split(between, np.flatnonzero(np.diff(between) > 1) + 1) if len(between) else ():
                if stretch[0]:  # the row ahead is a cut
                    i = stretch[0] - 1
                    key, last = (names[i].as_py(), blocks[i]), int(times[i])
                for i in stretch:
                    t, here = int(times[i]), (names[i].as_py(), blocks[i])
                    if here != key:
                        key, last = here, int(start[i])
                    if repeat[i]:
                        continue
                    if has_id[i] or abs(t - last) >= window_us:
                        last = max(last, t)
                    else:
                        keep[i] = False
            if cuts[n - 1]:
                key, last = (names[n - 1].as_py(), blocks[n - 1]), int(times[n - 1])
            out = batch.drop_columns(["_us", "_cut", "_has_id", "_in_last", BLK])
            yield out.append_column("rate_limited", pa.array(~keep))

    return run


class _Steps:
    """How a run of coins turns the last accepted time before it into the one after.

    Constant pieces ``(upper bound, value)`` followed by an unchanged remainder.
    """

    def __init__(self) -> None:
        self.pieces: list[tuple[int, int]] = []      # upper bound, group
        self.parent: list[int] = []
        self.heap: list[tuple[int, int]] = []        # value, group
        self.reset: int | None = None                # set once a cut was seen

    def cut(self, t: int) -> None:
        self.reset = t

    def coin(self, t: int, has_id: bool, window_us: int) -> None:
        if self.reset is not None:
            if has_id or t - self.reset >= window_us:
                self.reset = max(self.reset, t)
            return
        bound = t if has_id else t - window_us
        group = -1
        while self.heap and self.heap[0][0] <= bound:
            _, old = heapq.heappop(self.heap)
            if group < 0:
                group = old
            else:
                self.parent[old] = group
        if not self.pieces or bound > self.pieces[-1][0]:
            if group < 0:
                group = len(self.parent)
                self.parent.append(group)
            self.pieces.append((bound, group))
        if group >= 0:
            heapq.heappush(self.heap, (t, group))

    def rows(self) -> list[tuple[int, int]]:
        if self.reset is not None:
            return [(2**62, self.reset)]
        value = {group: v for v, group in self.heap}
        out: list[tuple[int, int]] = []
        for bound, group in self.pieces:
            while self.parent[group] != group:
                group = self.parent[group]
            if out and out[-1][1] == value[group]:
                out[-1] = (bound, value[group])
            else:
                out.append((bound, value[group]))
        return out


def _block_steps(window_us: int):
    """One table of steps per block, from rows ordered by machine, block and arrival."""

    def emit(key: tuple, steps: _Steps) -> pa.RecordBatch:
        rows = steps.rows() or [(_NEVER, _NEVER)]
        return pa.RecordBatch.from_pydict({
            "machine_id": pa.array([key[0]] * len(rows), pa.string()),
            BLK: pa.array([key[1]] * len(rows), pa.int64()),
            "upto": pa.array([r[0] for r in rows], pa.int64()),
            "becomes": pa.array([r[1] for r in rows], pa.int64()),
            "coin0_us": pa.array([key[2]] * len(rows), pa.int64()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, steps = None, _Steps()
        for batch in batches:
            machines = batch.column("machine_id").to_pylist()
            blocks = batch.column(BLK).to_pylist()
            first = batch.column("coin0_us").to_pylist()
            times = batch.column("_us").to_pylist()
            cuts = batch.column("_cut").to_pylist()
            has_id = batch.column("_has_id").to_pylist()
            for m, b, c0, t, cut, hid in zip(machines, blocks, first, times, cuts, has_id):
                if key is None or (m, b) != key[:2]:
                    if key is not None:
                        yield emit(key, steps)
                    key, steps = (m, b, c0), _Steps()
                if cut:
                    steps.cut(t)
                else:
                    steps.coin(t, hid, window_us)
        if key is not None:
            yield emit(key, steps)

    return run


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last accepted time at the start of each block, from step tables in block order."""
    key, before, after, settled = None, _NEVER, _NEVER, False
    for batch in batches:
        out_m, out_b, out_v = [], [], []
        for m, b, upto, becomes, c0 in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if key is None or (m, b) != key:
                if key is None or m != key[0]:
                    before = _NEVER if c0 is None else c0
                else:
                    before = after
                key, after, settled = (m, b), before, False
                out_m.append(m)
                out_b.append(b)
                out_v.append(before)
            if not settled and before <= upto:
                after, settled = becomes, True
        if out_m:
            yield pa.RecordBatch.from_pydict({
                "machine_id": pa.array(out_m, pa.string()),
                BLK: pa.array(out_b, pa.int64()),
                "_in_last": pa.array(out_v, pa.int64()),
            })


def _block_carry(coins: DataFrame, window_us: int, hot: HotKeys) -> DataFrame:
    """Running maximum and last accepted time at the start of each block of a hot machine."""
    narrow = hot_blocks(
        coins.where(~F.col("duplicate")).select(
            "machine_id", "seq", "uid", "duplicate", "coin0_us", micros(F.col("ts")).alias("_us")
        ),
        "machine_id", hot,
    )
    peaks = narrow.groupBy("machine_id", BLK).agg(F.max("_us").alias("_peak"), F.first("coin0_us").alias("coin0_us"))
    ahead = block_window("machine_id").rowsBetween(Window.unboundedPreceding, -1)
    maxima = peaks.select(
        "machine_id", BLK, F.greatest(F.max("_peak").over(ahead), F.col("coin0_us")).alias("_in_max")
    )
    cut = _with_cuts(narrow.join(maxima, ["machine_id", BLK]), window_us)
    cut = cut.select(
        "machine_id", BLK, "seq", "_us", "_cut", F.col("uid").isNotNull().alias("_has_id"), "coin0_us"
    ).sortWithinPartitions("machine_id", BLK, "seq")
    steps = cut.mapInArrow(
        _block_steps(window_us), f"machine_id string, {BLK} long, upto long, becomes long, coin0_us long"
    )
    ordered = steps.repartition("machine_id").sortWithinPartitions("machine_id", BLK, "upto")
    starts = ordered.mapInArrow(_chain, f"machine_id string, {BLK} long, _in_last long")
    return maxima.join(starts, ["machine_id", BLK])


def mark_rate_limited(coins: DataFrame, dedup_ms: int = S.COIN_DEDUP_MS, hot: HotKeys | None = None) -> DataFrame:
    """Add ``rate_limited``: a coin without id closer than the window to the last accepted one.

    Rows marked ``duplicate`` take no part; ``coin0_us`` is the last accepted coin time known
    beforehand (null if none). Acceptance depends on earlier acceptance, which no
    window function expresses, so the chain is folded over Arrow batches.
    """
    window_us = dedup_ms * 1000
    rows = with_blocks(coins, "machine_id", hot).withColumn("_us", micros(F.col("ts")))
    if hot is None:
        rows = rows.withColumns({"_in_max": F.col("coin0_us"), "_in_last": F.col("coin0_us")})
    else:
        rows = rows.join(_block_carry(coins, window_us, hot), ["machine_id", BLK], "left").withColumns({
            "_in_max": F.coalesce("_in_max", "coin0_us"),
            "_in_last": F.coalesce("_in_last", "coin0_us"),
        })
    rows = _with_cuts(rows, window_us).withColumn("_has_id", F.col("uid").isNotNull()).drop("_in_max")
    # the window has already grouped and sorted the rows this way
    rows = rows.sortWithinPartitions("machine_id", BLK, "seq")
    kept = [f for f in rows.schema.fields if f.name not in ("_us", "_cut", "_has_id", "_in_last", BLK)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(_fold(window_us), f"{schema}, rate_limited boolean")


def judge_coins(
    coins: DataFrame,
    dedup_ms: int = S.COIN_DEDUP_MS,
    known_ids: KnownIds = None,
    last_coins: DataFrame | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Add ``verdict`` (accepted, duplicate or rate_limit) to every coin message."""
    narrow = coins.select("machine_id", "seq", "ts", "uid")
    if last_coins is None:
        narrow = narrow.withColumn("coin0_us", F.lit(None).cast("long"))
    else:
        known = last_coins.select("machine_id", micros(F.col("last_coin_ts")).alias("coin0_us"))
        narrow = narrow.join(known, "machine_id", "left")
    # only what the chain needs goes through it; the messages themselves meet the verdicts on their number
    marked = mark_rate_limited(mark_id_duplicates(narrow, known_ids), dedup_ms, hot)
    verdict = F.when(F.col("duplicate"), DUPLICATE).when(F.col("rate_limited"), RATE_LIMIT).otherwise(ACCEPTED)
    return coins.join(marked.select("seq", verdict.alias("verdict")), "seq")


def admission(status_after: Column, test_mode: Column) -> Column:
    """Whether an accepted coin enters the ledger."""
    return F.when(test_mode, TEST).when(status_after != "active", GHOST).otherwise(ACCEPTED)


def new_ledger_rows(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """Coins not yet in the ledger: by machine and id, or by event where there is no id. A repeated run adds nothing."""
    have = ledger.where(F.col("unique_id").isNotNull()).select("machine_id", "unique_id").distinct()
    with_id = candidates.where(F.col("unique_id").isNotNull())
    firsts = with_id.groupBy("machine_id", "unique_id").agg(F.min("id").alias("id"))
    fresh = firsts.join(have, ["machine_id", "unique_id"], "left_anti").select("id")
    without_id = candidates.where(F.col("unique_id").isNull()).join(
        ledger.where(F.col("unique_id").isNull()).select("event_id"), "event_id", "left_anti")
    return without_id.select(candidates.columns).unionByName(with_id.join(fresh, "id", "left_semi").select(candidates.columns))
