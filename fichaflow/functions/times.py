"""Time expressions: device time normaliser, local days, day bounds, micros."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, functions as F

from fichaflow import schemas as S
from fichaflow.functions.values import let, strip

DEVICE_TIME = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?\s*(Z|[+-]\d{2}:?\d{2})?$"
)


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a UTC wall-clock time."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def local_time(ts: Column) -> Column:
    """UTC wall clock to the business zone's wall clock."""
    return F.convert_timezone(F.lit("UTC"), F.lit(S.LOCAL_ZONE), ts)


def local_day(ts: Column) -> Column:
    return F.to_date(local_time(ts))


def to_millis(ts: Column) -> Column:
    return F.date_trunc("millisecond", ts).cast("timestamp_ntz")


def device_time(text: Column, ingest: Column) -> Column:
    """UTC time of a device-given text, else the ingest time.

    A text with a zone must name a real clock time (day 29-31 may spill into the
    next month). Without a zone the parts are UTC-4 and any part may overflow; a
    fraction without a zone is read as UTC-4 too, but must name a real time. Each part
    is read from the text once, however often the rules use it.
    """
    parsed = lambda s: F.when(s.rlike(DEVICE_TIME), let(_parts(s), lambda p: let(_numbers(p), _moment)))
    return F.coalesce(let(strip(text), parsed), ingest)


def _parts(s: Column) -> Column:
    """Text, fraction of a second and zone; empty where there is none."""
    fraction, zone = F.regexp_extract(s, r"\.(\d+)", 1), F.regexp_extract(s, r"(Z|[+-]\d{2}:?\d{2})$", 1)
    return F.struct(
        s.alias("s"), fraction.alias("fraction"), zone.alias("zone"), F.regexp_replace(zone, "[^0-9]", "").alias("digits"))


def _numbers(p: Column) -> Column:
    s, digits = p["s"], p["digits"]
    # a failed cast costs an exception, so an absent part is not cast
    number = lambda c: F.when(c == "", F.lit(0)).otherwise(F.coalesce(c.try_cast("int"), F.lit(0)))
    part = lambda pos, n: number(F.substring(s, pos, n))
    clock = lambda c: F.when(F.length(s) >= 16, c).otherwise(F.lit(0))
    numbers = {
        "y": part(1, 4), "mo": part(6, 2), "d": part(9, 2), "hh": clock(part(12, 2)), "mi": clock(part(15, 2)),
        "ss": F.when(F.substring(s, 17, 1) == ":", part(18, 2)).otherwise(F.lit(0)),
        "ms": number(F.substring(F.concat(p["fraction"], F.lit("000")), 1, 3)),
        "off_h": number(F.substring(digits, 1, 2)), "off_m": number(F.substring(digits, 3, 2)),
        "sign": F.when(p["zone"].startswith("-"), F.lit(-1)).otherwise(F.lit(1)),
        "zoned": p["zone"] != "", "whole": p["fraction"] == "",
    }
    return F.struct(*[c.alias(name) for name, c in numbers.items()])


def _moment(n: Column) -> Column:
    """UTC time of the numbers of a text, null where they break the rules."""
    y, mo, d, hh, mi, ss, ms = (n[c] for c in ("y", "mo", "d", "hh", "mi", "ss", "ms"))
    # whole numbers: intervals and decimals cost several times as much
    day = F.unix_date(F.add_months(F.make_date(y, F.lit(1), F.lit(1)), mo - 1)).cast("long") + d - 1
    wall = ((((day * 24 + hh) * 60 + mi) * 60 + ss) * 1000 + ms) * 1000

    real = (
        mo.between(1, 12) & d.between(1, 31) & (mi <= 59) & (ss <= 59)
        & ((hh <= 23) | ((hh == 24) & (mi == 0) & (ss == 0) & (ms == 0)))
    )
    zoned = wall - n["sign"].cast("long") * (n["off_h"] * 60 + n["off_m"]) * 60_000_000
    naive = wall + S.DEVICE_OFFSET_HOURS * 3_600_000_000
    return from_micros(
        F.when(n["zoned"], F.when(real & (n["off_h"] <= 23) & (n["off_m"] <= 59), zoned))
        .when(n["whole"], naive)
        .when(real, naive)
    )


def parse_bound(value: str | None) -> str | None:
    """Day bound of an income query: a day, a month's first day, or no bound."""
    text = (value or "").strip()
    if re.fullmatch(r"\d{4}-\d{2}", text):
        return f"{text}-01"
    return text if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text) else None


def parse_upper_bound(value: str | None) -> str | None:
    """As :func:`parse_bound`, but a month means its last day."""
    text = (value or "").strip()
    month = re.fullmatch(r"(\d{4})-(\d{2})", text)
    if not month:
        return parse_bound(text)
    year, number = int(month[1]), int(month[2])
    # months outside 1..12 roll over before the last day is taken
    index = year * 12 + number
    following = dt.date(index // 12, index % 12 + 1, 1)
    return f"{text}-{(following - dt.timedelta(days=1)).day:02d}"


def lower_day(c: Column) -> Column:
    """Column form of :func:`parse_bound`."""
    s = strip(c)
    return F.when(s.rlike(r"^\d{4}-\d{2}$"), F.concat(s, F.lit("-01")).try_cast("date")).when(
        s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s.try_cast("date")
    )


def upper_day(c: Column) -> Column:
    """Column form of :func:`parse_upper_bound`."""
    s = strip(c)
    month = F.concat(s, F.lit("-01")).try_cast("date")
    return F.when(s.rlike(r"^\d{4}-\d{2}$"), F.last_day(month)).when(
        s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s.try_cast("date")
    )


def between_days(day: Column, start: str | None, end: str | None) -> Column | None:
    """Inclusive day filter; null when both bounds are open."""
    conds = []
    if start:
        conds.append(day >= F.lit(start).cast("date"))
    if end:
        conds.append(day <= F.lit(end).cast("date"))
    if not conds:
        return None
    return conds[0] if len(conds) == 1 else conds[0] & conds[1]
