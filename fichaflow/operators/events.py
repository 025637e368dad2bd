"""Event-log queries: filters, pages, history, power sessions, statistics, liveness."""

from __future__ import annotations

import datetime as dt
import re
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window, functions as F

from fichaflow import schemas as S
from fichaflow.functions.times import between_days, local_day, micros
from fichaflow.operators import blocks
from fichaflow.operators.coins import coin_number
from fichaflow.operators.blocks import BLK, HotKeys, find_hot_keys, number_rows

RANGES = {"7d": 7, "30d": 30}
END_SLACK = dt.timedelta(milliseconds=1000)
POWER = ("machine_on", "machine_off")


def _utc(value: dt.datetime) -> dt.datetime:
    if value.tzinfo is None:
        value = value.replace(tzinfo=ZoneInfo(S.LOCAL_ZONE))
    return value.astimezone(dt.timezone.utc).replace(tzinfo=None)


def _instant(text: str, end: bool) -> dt.datetime:
    """A bound in UTC: a date means that local day, an end gets a second of slack."""
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        clock = dt.time(23, 59, 59, 999000) if end else dt.time()
        moment = _utc(dt.datetime.combine(dt.date.fromisoformat(text), clock))
    else:
        moment = _utc(dt.datetime.fromisoformat(text))
    return moment + END_SLACK if end else moment


def _ntz(moment: dt.datetime) -> Column:
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def range_bounds(
    as_of: dt.datetime | None = None, range_: str | None = None, start: str | None = None, end: str | None = None
) -> tuple[list[dt.datetime], list[dt.datetime]]:
    """Lower and upper bounds in UTC; all of them apply."""
    low, high = [], []
    if range_ in RANGES:
        if as_of is None:
            raise ValueError("a range needs as_of")
        low.append(as_of - dt.timedelta(days=RANGES[range_]))
    if start:
        low.append(_instant(start, end=False))
    if end:
        high.append(_instant(end, end=True))
    return low, high


def filter_events(
    events: DataFrame,
    as_of: dt.datetime | None = None,
    range_: str | None = None,
    start: str | None = None,
    end: str | None = None,
    include_pings: bool = False,
) -> DataFrame:
    """Range and explicit bounds all apply together; pings are left out by default.

    The bounds are literals, so they reach the parquet scan; those on the local day, a day
    wider, leave out the partitions of other days. ``as_of`` (UTC) is what a range counts
    back from.
    """
    low, high = range_bounds(as_of, range_, start, end)
    by_day = "local_day" in events.columns
    day = lambda moment, shift: F.lit((moment + dt.timedelta(days=shift)).date().isoformat()).cast("date")
    for moment in low:
        events = events.where(F.col("timestamp") >= _ntz(moment))
        events = events.where(F.col("local_day") >= day(moment, -1)) if by_day else events
    for moment in high:
        events = events.where(F.col("timestamp") <= _ntz(moment))
        events = events.where(F.col("local_day") <= day(moment, 1)) if by_day else events
    return events if include_pings else exclude_pings(events)


def exclude_pings(events: DataFrame) -> DataFrame:
    return events.where(F.col("type") != "ping")


def page_bounds(page: object, page_size: object) -> tuple[int, int]:
    """Page at least 1; size within 1..1000 and 20 when unreadable or zero."""

    def read(value: object, default: int) -> int:
        try:
            return int(float(str(value))) or default
        except (ValueError, OverflowError):
            return default

    return max(1, read(page, 1)), max(1, min(S.MAX_PAGE_SIZE, read(page_size, S.DEFAULT_PAGE_SIZE)))


#: Rows of a slice of the log that a page sorts; a larger slice is cut by a finer unit of time.
SLICE_ROWS = 100_000


def page_events(
    events: DataFrame, page: object = 1, page_size: object = S.DEFAULT_PAGE_SIZE, hours: DataFrame | None = None
) -> DataFrame:
    """One page, newest first, ties by descending id.

    Every page is narrowed by counting rows per local day, a scan of the partition column alone,
    and then per hour, minute and second while the slice around the page is large. So
    only the days of the page are read, and the final sort holds one slice. With ``hours``, counts (slice, n) of the
    events per hour from :func:`hour_counts`, nothing is counted in the log unless an hour is large.
    """
    number, size = page_bounds(page, page_size)
    skip = (number - 1) * size
    by_day = "local_day" in events.columns
    day = F.col("local_day").cast("timestamp_ntz") if by_day else local_day(F.col("timestamp")).cast("timestamp_ntz")
    units = [] if hours is not None else [(day, None)]
    units += [(F.date_trunc(u, F.col("timestamp")).cast("timestamp_ntz"), hours if u == "hour" else None) for u in ("hour", "minute", "second")]
    for unit, counts in units:
        if counts is None:
            counts = events.groupBy(unit.alias("slice")).agg(F.count(F.lit(1)).alias("n"))
        newest_first = Window.orderBy(F.col("slice").desc())
        ahead = F.coalesce(
            F.sum("n").over(newest_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        )
        # one row per slice of the parent slice; a page touches at most `size` of them
        hit = counts.withColumn("ahead", ahead).where(
            (F.col("ahead") < skip + size) & (F.col("ahead") + F.col("n") > skip)
        ).agg(F.min("slice"), F.max("slice"), F.min("ahead"), F.sum("n")).first()
        if hit[0] is None:
            return events.limit(0)
        events = events.where(unit.between(_ntz(hit[0]), _ntz(hit[1])))
        if by_day and hours is not None:
            near = [F.lit((x + dt.timedelta(days=d)).date().isoformat()).cast("date") for x, d in ((hit[0], -1), (hit[1], 1))]
            events = events.where(F.col("local_day").between(*near))
        skip -= hit[2]
        if hit[3] <= SLICE_ROWS:
            break
    return events.orderBy(F.col("timestamp").desc(), F.col("id").desc()).offset(skip).limit(size)


def hour_counts(
    events: DataFrame, kept: DataFrame, low: list[dt.datetime], high: list[dt.datetime], include_pings: bool = False
) -> DataFrame:
    """(slice, n): rows per hour of the filtered ``events``, from counts (hour, type, n) kept with the log.

    Only an hour that a bound cuts in two is counted in the log itself.
    """
    kept = kept if include_pings else exclude_pings(kept)
    hour = lambda moment: moment.replace(minute=0, second=0, microsecond=0)
    cut = sorted({hour(m) for m in [*low, *high]})
    for moment in low:
        kept = kept.where(F.col("hour") >= _ntz(hour(moment)))
    for moment in high:
        kept = kept.where(F.col("hour") <= _ntz(hour(moment)))
    for moment in cut:
        kept = kept.where(F.col("hour") != _ntz(moment))
    whole = kept.groupBy(F.col("hour").alias("slice")).agg(F.sum("n").alias("n"))
    for moment in cut:
        edge = events.where((F.col("timestamp") >= _ntz(moment)) & (F.col("timestamp") < _ntz(moment + dt.timedelta(hours=1))))
        if "local_day" in events.columns:
            days = [F.lit((moment + dt.timedelta(days=d)).date().isoformat()).cast("date") for d in (-1, 1)]
            edge = edge.where(F.col("local_day").between(*days))
        whole = whole.unionByName(edge.agg(F.count(F.lit(1)).alias("n")).select(_ntz(moment).alias("slice"), "n"))
    return whole.where("n > 0")


def page_info(events: DataFrame, page: object = 1, page_size: object = S.DEFAULT_PAGE_SIZE) -> DataFrame:
    """Total and number of pages; ``events`` may be the counts of :func:`hour_counts`."""
    number, size = page_bounds(page, page_size)
    total = F.coalesce(F.sum("n"), F.lit(0)) if "n" in events.columns else F.count(F.lit(1))
    return events.agg(
        total.alias("total"),
        F.lit(number).alias("page"),
        F.lit(size).alias("page_size"),
        F.greatest(F.lit(1), F.ceil(total / size)).cast("long").alias("total_pages"),
    )


def liveness(machines: DataFrame, as_of: Column, timeout_ms: int = S.STATUS_TIMEOUT_MS) -> DataFrame:
    """Whether each machine was heard from within the timeout."""
    fresh = micros(as_of) - micros(F.col("last_ping")) < timeout_ms * 1000
    return machines.select(
        "id", "name", "status", F.col("last_ping").alias("lastPing"),
        F.coalesce(fresh, F.lit(False)).alias("connected"),
    )


def machines_with_last_power(machines: DataFrame, events: DataFrame) -> DataFrame:
    """Registry with the latest on and off time, null when there is none."""
    power = events.where(F.col("type").isin(*POWER)).groupBy(F.col("machine_id").alias("id")).agg(
        F.max(F.when(F.col("type") == "machine_on", F.col("timestamp"))).alias("last_on"),
        F.max(F.when(F.col("type") == "machine_off", F.col("timestamp"))).alias("last_off"),
    )
    return machines.join(power, "id", "left")


def machine_by_id(machines: DataFrame, events: DataFrame, machine_id: str) -> DataFrame:
    return machines_with_last_power(
        machines.where(F.col("id") == machine_id), events.where(F.col("machine_id") == machine_id)
    )


def _scoped(events: DataFrame, machine_id: str | None, start: str | None, end: str | None) -> DataFrame:
    if machine_id is not None:
        events = events.where(F.col("machine_id") == machine_id)
    day = F.col("local_day") if "local_day" in events.columns else local_day(F.col("timestamp"))
    cond = between_days(day, start, end)
    return events if cond is None else events.where(cond)


def _session_minutes(next_type: Column, next_ts: Column) -> Column:
    minutes = (micros(next_ts) - micros(F.col("timestamp"))) / F.lit(60_000_000)
    closes = (F.col("type") == "machine_on") & (next_type == "machine_off") & (next_ts > F.col("timestamp"))
    return F.when(closes, F.floor(minutes + F.lit(0.5)))


def power_sessions(
    events: DataFrame,
    machine_id: str | None = None,
    start: str | None = None,
    end: str | None = None,
    block_rows: int = blocks.BLOCK_ROWS,
    hot: HotKeys | None | str = "find",
) -> DataFrame:
    """On and off rows of the period, each on with the minutes to the off right after it.

    The day filter comes first, so a session cut by it stays open. Hot machines are
    found by a count over ``events``; for a log that is not stored yet pass those of
    the replay instead, which bound its rows too.
    """
    rows = _scoped(events, machine_id, start, end).where(F.col("type").isin(*POWER)).select(
        "machine_id", "id", "type", "timestamp"
    )
    if isinstance(hot, str):
        hot = find_hot_keys(rows, "machine_id", block_rows, position=None)
    w = Window.partitionBy("machine_id").orderBy("timestamp", "id")
    usual = rows if hot is None else rows.join(hot.keys, "machine_id", "left_anti")
    out = usual.withColumn("dur", _session_minutes(F.lead("type").over(w), F.lead("timestamp").over(w)))
    if hot is not None:
        out = out.unionByName(_hot_sessions(rows, hot))
    label = F.when(F.col("type") == "machine_on", "Encendido").otherwise("Apagado")
    return out.select("machine_id", "id", label.alias("event"), F.col("timestamp").alias("ts"), "dur")


def _hot_sessions(rows: DataFrame, hot: HotKeys) -> DataFrame:
    numbered = number_rows(rows.join(hot.keys, "machine_id"), "machine_id", "timestamp", "id")
    numbered = numbered.withColumn(BLK, F.floor(F.col("_pos") / hot.block_rows))
    row = F.struct("type", "timestamp")
    firsts = numbered.groupBy("machine_id", BLK).agg(F.min_by(row, "_pos").alias("_head"))
    following = firsts.select(
        "machine_id", BLK, F.lead("_head").over(blocks.block_window("machine_id")).alias("_next_head")
    )
    w = blocks.ordered_window("machine_id", "_pos")
    joined = numbered.join(following, ["machine_id", BLK])
    nxt = F.coalesce(F.lead(row).over(w), F.col("_next_head"))
    joined = joined.withColumn("_next", nxt)
    joined = joined.withColumn("dur", _session_minutes(F.col("_next.type"), F.col("_next.timestamp")))
    return joined.drop("_pos", BLK, "_next", "_next_head")


def machine_history(
    events: DataFrame, coins: DataFrame, machine_id: str | None = None, start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """All events but coin events without a ledger row, newest first.

    Only coin events meet the ledger, on the unique event id.
    """
    rows = _scoped(events, machine_id, start, end)
    is_coin = F.col("type") == "coin_inserted"
    ledger = coins.select(F.col("event_id").alias("id"))
    kept = rows.where(~is_coin).unionByName(rows.where(is_coin).join(ledger, "id", "left_semi"))
    return kept.orderBy(F.col("timestamp").desc(), F.col("id").desc())


def machine_stats(machines: DataFrame, events: DataFrame, coins: DataFrame, faithful: bool = True) -> DataFrame:
    """Income, score, sessions and usage per machine; ``data`` is the payload map, ``coins`` the ledger or its kept counts.

    The test filter is null for rows without a test mark, which leaves them out;
    ``faithful=False`` keeps them.
    """
    test = F.element_at("data", "test")
    counted = (test != "true") if faithful else (F.coalesce(test, F.lit("false")) != "true")
    score = F.coalesce(F.element_at("data", "score").try_cast("decimal(18,6)"), F.lit(0))
    per_machine = events.where(counted).groupBy("machine_id").agg(
        F.sum(F.when(F.col("type") == "game_end", score)).alias("score"),
        F.count_if(F.col("type") == "game_start").alias("starts"),
    )
    income = coins.groupBy("machine_id").agg(coin_number(coins).alias("income"))
    joined = machines.select(F.col("id").alias("machine_id")).join(per_machine, "machine_id", "left").join(
        income, "machine_id", "left"
    )
    return joined.select(
        "machine_id",
        F.coalesce("income", F.lit(0)).cast("long").alias("totalIncome"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("totalScore"),
        F.coalesce("starts", F.lit(0)).cast("long").alias("activeSessions"),
        F.when(F.col("starts").isNotNull(), F.lit(S.USAGE_RATE)).otherwise(F.lit(0.0)).alias("usageRate"),
    )
