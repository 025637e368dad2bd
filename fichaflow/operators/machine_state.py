"""Machine on/off state over the message order, with heartbeat timeouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fichaflow import schemas as S
from fichaflow.functions.times import from_micros, micros
from fichaflow.operators.blocks import (
    BLK, HotKeys, block_window, hot_blocks, ordered_window, with_blocks,
)

ACTIVE, INACTIVE = "active", "inactive"


class Heartbeat:
    """When a silent machine is switched off.

    ``exact``: at last ping + timeout. ``tick``: at the first sweep after that.
    ``timeout_ms=None`` switches timeouts off.
    """

    def __init__(
        self,
        timeout_ms: int | None = S.HEARTBEAT_TIMEOUT_MS,
        missed: int = S.MISSED_PINGS_THRESHOLD,
        mode: str = "exact",
        interval_ms: int = S.SWEEP_INTERVAL_MS,
    ) -> None:
        if mode not in ("exact", "tick"):
            raise ValueError(f"unknown mode {mode!r}")
        self.limit = None if timeout_ms is None else timeout_ms * missed * 1000
        self.mode, self.interval = mode, interval_ms * 1000

    def off_at(self, last_ping_us: Column) -> Column:
        if self.limit is None:
            return F.lit(None).cast("long")
        due = last_ping_us + F.lit(self.limit)
        if self.mode == "exact":
            return due
        return (F.floor(due / self.interval) + 1) * self.interval

    def off_at_micros(self, last_ping_us: int | None) -> int | None:
        """The same for a plain number."""
        if self.limit is None or last_ping_us is None:
            return None
        due = last_ping_us + self.limit
        return due if self.mode == "exact" else (due // self.interval + 1) * self.interval

    def missed(self, last_ping_us: Column, now_us: Column) -> Column:
        return F.coalesce(self.off_at(last_ping_us) < now_us, F.lit(False))


def effect(event: Column) -> Column:
    return F.when(event.isin("machine_on", "ping"), ACTIVE).when(event == "machine_off", INACTIVE)


def _status_before(w: Window, position: str, initial: Column, gap_frame_end: int) -> Column:
    """Status ahead of each row: the last effect, unless a timeout came after it."""
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    gaps = w.rowsBetween(Window.unboundedPreceding, gap_frame_end)
    pos = F.col(position)
    last_effect = F.last(
        F.when(F.col("_eff").isNotNull(), F.struct(F.col("_eff").alias("s"), pos.alias("p"))), ignorenulls=True
    ).over(earlier)
    last_gap = F.max(F.when(F.col("_gap"), pos)).over(gaps)
    untouched = F.when(last_gap.isNotNull() & (initial == ACTIVE), INACTIVE).otherwise(initial)
    return (
        F.when(last_effect.isNull(), untouched)
        .when(last_gap > last_effect["p"], F.lit(INACTIVE))
        .otherwise(last_effect["s"])
    )


def _scan(rows: DataFrame, heartbeat: Heartbeat) -> DataFrame:
    """Scan inside blocks from ``_in_status`` and ``_in_ping`` (micros), both nullable."""
    w = ordered_window("machine_id")
    now = micros(F.col("received_at"))
    rows = rows.withColumn("_eff", effect(F.col("event"))).withColumn(
        "_prev", F.coalesce(F.lag(now).over(w), F.col("_in_ping"))
    )
    rows = rows.withColumn("_gap", heartbeat.missed(F.col("_prev"), now))
    rows = rows.withColumn("status_before", _status_before(w, "seq", F.col("_in_status"), 0))
    return rows.withColumn("status_after", F.coalesce("_eff", "status_before"))


def _block_carry(messages: DataFrame, heartbeat: Heartbeat, hot: HotKeys) -> DataFrame:
    """Status and last ping at the start of every block of a hot machine."""
    narrow = hot_blocks(messages.select("machine_id", "seq", "received_at", "event", "status0", "ping0"),
                        "machine_id", hot)
    open_start = narrow.withColumns({
        "_in_status": F.lit(None).cast("string"), "_in_ping": F.lit(None).cast("long"),
    })
    summary = _scan(open_start, heartbeat).groupBy("machine_id", BLK).agg(
        F.max_by("status_after", "seq").alias("_eff"),
        F.bool_or("_gap").alias("_inner_gap"),
        F.min(micros(F.col("received_at"))).alias("_first"),
        F.max(micros(F.col("received_at"))).alias("_last"),
        F.first("status0").alias("status0"),
        F.first("ping0").alias("ping0"),
    )
    w = block_window("machine_id")
    summary = summary.withColumn("_carry_ping", F.coalesce(F.lag("_last").over(w), micros(F.col("ping0"))))
    summary = summary.withColumn(
        "_gap", F.col("_inner_gap") | heartbeat.missed(F.col("_carry_ping"), F.col("_first"))
    )
    summary = summary.withColumn("_carry_status", _status_before(w, BLK, F.col("status0"), -1))
    more = F.lead(BLK).over(w).isNotNull()
    return summary.select("machine_id", BLK, "_carry_status", "_carry_ping", more.alias("_more_blocks"))


def track_states(messages: DataFrame, heartbeat: Heartbeat, hot: HotKeys | None = None) -> DataFrame:
    """Add status before and after each accepted message, and what it triggers.

    ``messages`` come from :func:`ingest.accepted`; ``seq`` is the arrival number and
    ascends with ``received_at``. Added columns: ``status_before``, ``status_after``,
    ``event`` (a repeated on becomes a ping, marked ``suppressed_on``), ``auto_on``
    (a ping that wakes a machine), ``off_at`` (a timeout between the previous message
    and this one) and ``is_last`` (the machine's last message). One shuffle, on machine
    and block.
    """
    rows = with_blocks(messages, "machine_id", hot)
    if hot is None:
        rows = rows.withColumns({
            "_carry_status": F.lit(None).cast("string"), "_carry_ping": F.lit(None).cast("long"),
            "_more_blocks": F.lit(False),
        })
    else:
        rows = rows.join(_block_carry(messages, heartbeat, hot), ["machine_id", BLK], "left")
    rows = rows.withColumns({
        "_in_status": F.coalesce("_carry_status", "status0"),
        "_in_ping": F.coalesce("_carry_ping", micros(F.col("ping0"))),
    })
    scanned = _scan(rows, heartbeat)
    w = ordered_window("machine_id")
    # the status left by the row ahead, before a timeout in between
    left_by_previous = F.coalesce(F.lag("status_after").over(w), F.col("_in_status"))
    scanned = scanned.withColumn(
        "off_at",
        F.when(F.col("_gap") & (left_by_previous == ACTIVE), from_micros(heartbeat.off_at(F.col("_prev")))),
    )
    is_last = F.lead("seq").over(w).isNull() & ~F.coalesce("_more_blocks", F.lit(False))
    scanned = scanned.withColumn("is_last", is_last)
    suppressed = (F.col("event") == "machine_on") & (F.col("status_before") == ACTIVE)
    event = F.when(suppressed, "ping").otherwise(F.col("event"))
    scanned = scanned.withColumns({"suppressed_on": suppressed, "event": event})
    auto_on = (F.col("event") == "ping") & (F.col("status_before") != ACTIVE)
    return scanned.withColumn("auto_on", auto_on).drop(
        "_carry_status", "_carry_ping", "_more_blocks", "_in_status", "_in_ping", "_eff", "_prev", "_gap", BLK
    )


def snapshot(states: DataFrame, machines: DataFrame) -> DataFrame:
    """Registry with status, last ping and ``last_seq`` after the last message."""
    last = states.groupBy(F.col("machine_id").alias("id")).agg(
        F.max_by("status_after", "seq").alias("_status"), F.max("received_at").alias("_ping"),
        F.max("seq").alias("_seq"),
    )
    joined = machines.join(last, "id", "left")
    earlier = F.col("last_seq") if "last_seq" in machines.columns else F.lit(None).cast("long")
    return joined.withColumns({
        "status": F.coalesce("_status", "status"),
        "last_ping": F.coalesce("_ping", "last_ping"),
        "last_seq": F.coalesce("_seq", earlier),
    }).drop("_status", "_ping", "_seq")


def last_heartbeat(messages: DataFrame) -> DataFrame:
    """Latest accepted arrival per machine, whatever the event."""
    return messages.groupBy("machine_id").agg(F.max("received_at").alias("last_ping"))


def found_silent(status: Column, last_ping: Column, heartbeat: Heartbeat, as_of: Column) -> Column:
    """Whether a sweep at ``as_of`` switches a machine off."""
    return (status == ACTIVE) & heartbeat.missed(micros(last_ping), micros(as_of))


def silence_time(last_ping: Column, heartbeat: Heartbeat) -> Column:
    return from_micros(heartbeat.off_at(micros(last_ping)))


def after_sweep(current: DataFrame, heartbeat: Heartbeat, as_of: Column) -> DataFrame:
    """Snapshot with the machines found silent switched off."""
    silent = found_silent(F.col("status"), F.col("last_ping"), heartbeat, as_of)
    return current.withColumn("status", F.when(silent, INACTIVE).otherwise(F.col("status")))
