"""How queries are registered: a function of the sample tables of a folder, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from fichaflow.operators.machine_state import Heartbeat
from fichaflow.plans.replay import Replay, replay
from fichaflow.session import configure
from fichaflow.sources.sample_views import SampleViews

SIX_HOURS_MS = 6 * 3600 * 1000
AS_OF = "2024-01-31 00:00:00"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of sample views under a name, with its SQL if it has one."""

    def add(fn: Callable[[SampleViews], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plain(fn(SampleViews(configure(spark), folder)))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and arrays as text, so any client compares them alike."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        if kind.startswith("decimal"):
            c = c.cast("double")
        elif kind == "array":
            c = F.array_join(c.cast("array<string>"), ",")
        out.append(c.alias(f.name))
    return df.select(*out)


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def replayed(v: SampleViews, mode: str = "exact", sweep: bool = True, with_coins: bool = True, **kw) -> Replay:
    heartbeat = Heartbeat(SIX_HOURS_MS, mode=mode, interval_ms=3600 * 1000)
    return replay(
        v.device_messages(), v.machines(), heartbeat, SIX_HOURS_MS, as_of() if sweep else None,
        with_coins=with_coins, **kw,
    )
