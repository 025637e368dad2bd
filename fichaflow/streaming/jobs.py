"""Structured Streaming jobs.

The ingest job replays each micro-batch with the batch operators from the machine
state the batch before left in a shared folder. A hot machine is cut into blocks
there as in batch, which keyed streaming state cannot do.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from fichaflow import schemas as S
from fichaflow.operators import alerts as alert_ops
from fichaflow.operators.machine_state import Heartbeat
from fichaflow.plans.replay import Replay, replay
from fichaflow.session import configure
from fichaflow.sources.known_ids import KnownIds
from fichaflow.sources.tables import event_rows

KEEP_COINS = "known_coin_ids"


@dataclass
class BatchTables:
    """Tables under ``folder`` with one folder per micro-batch, overwritten when a batch is retried."""

    spark: SparkSession
    folder: str

    def _path(self, name: str, batch: int) -> str:
        return f"{self.folder.rstrip('/')}/{name}/batch={batch}"

    def _write(self, rows: DataFrame, name: str, batch: int, by_day: bool = False) -> None:
        if by_day:
            rows.hint("rebalance", "local_day").write.mode("overwrite").partitionBy("local_day").parquet(
                self._path(name, batch)
            )
        else:
            rows.write.mode("overwrite").parquet(self._path(name, batch))

    def _read(self, name: str, schema: str | None = None) -> DataFrame | None:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        try:
            return reader.parquet(f"{self.folder.rstrip('/')}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def read(self, name: str) -> DataFrame:
        """A table over all micro-batches."""
        rows = self._read(name)
        if rows is None:
            raise ValueError(f"nothing written to {name} yet")
        return rows


@dataclass
class IngestJob(BatchTables):
    """Messages to event log, ledger, alerts, audit and machine snapshots under ``folder``.

    Every table is written to a folder of its micro-batch and overwritten when the
    batch is retried, and a batch reads only what earlier batches wrote. A failed
    batch can therefore run again without doubling anything. ``machines`` is the registry, or
    a function that reads it as it is now: each batch joins it to the states that the batch before
    left, so a machine added or a test mode changed meanwhile counts.
    """

    machines: DataFrame | Callable[[], DataFrame]
    heartbeat: Heartbeat
    dedup_ms: int = S.COIN_DEDUP_MS
    max_delay_ms: int | None = None
    block_rows: int | None = None

    def snapshot(self, batch: int) -> DataFrame:
        """Machine states a batch left behind."""
        return self.spark.read.parquet(self._path("snapshots", batch))

    def _registry(self) -> DataFrame:
        return self.machines() if callable(self.machines) else self.machines

    def _before(self, batch: int) -> DataFrame:
        now = self._registry()
        if batch == 0:
            base = now.withColumns({
                "last_seq": F.lit(None).cast("long"), "last_coin_ts": F.lit(None).cast("timestamp_ntz"),
            })
            return base
        left = self.snapshot(batch - 1).select(
            "id", F.col("status").alias("_status"), F.col("last_ping").alias("_ping"), "last_seq", "last_coin_ts"
        )
        before = now.join(left, "id", "left").withColumns({
            "status": F.coalesce("_status", "status"), "last_ping": F.coalesce("_ping", "last_ping"),
        }).drop("_status", "_ping")
        return before

    # -- one micro-batch ------------------------------------------------------
    def process(self, messages: DataFrame, batch: int) -> None:
        configure(self.spark)
        as_of = messages.agg(F.date_trunc("millisecond", F.max("received_at")).cast("timestamp_ntz")).first()[0]
        before = self._before(batch)
        index = KnownIds(self.spark, f"{self.folder.rstrip('/')}/{KEEP_COINS}")
        # only buckets that may hold ids of this batch are read, and only what earlier batches put there
        known_ids = lambda ids: index.known(ids, F.col("batch").cast("int") < batch)
        if as_of is None:
            self._write(before, "snapshots", batch)
            return
        extra = {} if self.block_rows is None else {"block_rows": self.block_rows}
        run = replay(
            messages, before, self.heartbeat, self.dedup_ms, F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz"),
            known_ids, before.select(F.col("id").alias("machine_id"), "last_coin_ts"),
            max_delay_ms=self.max_delay_ms, **extra,
        ).stored(self._path("work", batch))
        self._write(event_rows(run.events()), "machine_events", batch, by_day=True)
        self._write(run.coins(), "coins", batch, by_day=True)
        self._write(alert_ops.build_alerts(run.alert_feed(), before), "alerts", batch)
        self._write(run.audit(), "ingest_audit", batch)
        index.add(self._new_ids(run), str(batch))
        self._write(self._after(run), "snapshots", batch)

    @staticmethod
    def _new_ids(run: Replay) -> DataFrame:
        logged = run.logged().where((F.col("event") == "coin_inserted") & F.col("uid").isNotNull())
        return logged.select("machine_id", "uid")

    @staticmethod
    def _after(run: Replay) -> DataFrame:
        latest = run.logged().where(F.col("event") == "coin_inserted").groupBy(F.col("machine_id").alias("id")).agg(
            F.max("ts").alias("_coin")
        )
        after = run.snapshot().join(latest, "id", "left")
        return after.withColumn("last_coin_ts", F.greatest("last_coin_ts", "_coin")).drop("_coin")

    def start(self, messages: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run on a message stream, e.g. ``start(stream, folder, availableNow=True)``."""
        writer = messages.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"processingTime": "60 seconds"})).start()


def daily_income_stream(coins: DataFrame, delay: str = "1 day") -> DataFrame:
    """Ledger rows per machine and local day of a coin stream.

    A tumbling day over the wall clock of the local zone, whatever its offset was then; the
    watermark, on that clock too, lets finished days leave the state.
    """
    at = F.from_utc_timestamp(F.col("timestamp").cast("timestamp"), S.LOCAL_ZONE)
    counted = coins.withColumn("at", at).withWatermark("at", delay).groupBy("machine_id", F.window("at", "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("income")
    )
    return counted.select("machine_id", F.to_date(F.col("w.start")).alias("date"), "income")


def drop_repeated_coins(coins: DataFrame, delay: str | None = None) -> DataFrame:
    """First coin of every (machine, id) of a stream of coins with ids.

    Exact without ``delay``, at the price of keeping every id; with it, repeats
    further apart than the delay may pass.
    """
    if delay is None:
        return coins.dropDuplicates(["machine_id", "uid"])
    timed = coins.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    return timed.dropDuplicatesWithinWatermark(["machine_id", "uid"]).drop("at")
