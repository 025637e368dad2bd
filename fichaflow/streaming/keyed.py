"""Machine state, silence timers and coin verdicts in keyed streaming state.

Each machine has its status, last ping, last coin time and coin ids in the state store, so a message is judged by what
came before it, in whatever micro-batch, and nothing written earlier is read again. A machine that falls silent is switched off by
an event-time timer: it fires when the messages of other machines have moved the watermark past the time. Messages whose device
time lies behind the watermark, and those that arrive behind a later one of their machine, are not dropped: they leave the
operator marked late and go to the audit.

The operator takes a machine's messages of one micro-batch in arrival order, in one task; the trigger bounds them. A
machine with most of all messages is better served by :class:`fichaflow.streaming.jobs.IngestJob`, which cuts it into blocks.
Coin ids are looked up by key in the store on the executor's disk, however many there are.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from fichaflow import schemas as S
from fichaflow.functions.times import from_micros, local_day, micros
from fichaflow.operators import alerts as alert_ops
from fichaflow.operators import coin_dedup, ingest
from fichaflow.operators.machine_state import ACTIVE, INACTIVE, Heartbeat
from fichaflow.plans.replay import Replay, idle_timeout_id, open_timeout_id, timeout_payload
from fichaflow.session import configure
from fichaflow.sources.tables import event_rows
from fichaflow.streaming.jobs import BatchTables

# the processor travels with the job: workers need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MACHINE, COIN_IDS = "machine", "coin_ids"
MACHINE_STATE = "status string, ping_us long, last_seq long, coin_us long, timer_ms long"
MESSAGE, TIMEOUT = "message", "timeout"
#: Groups that messages without a known machine are spread over; they touch no state.
REJECT_GROUPS = 64
CARRIED = ("seq", "received_us", "machine_id", "event", "ts_us", "uid", "raw_data", "cantidad", "test_mode", "reject")
JUDGED_SCHEMA = (
    "seq long, received_us long, machine_id string, event string, ts_us long, uid string, raw_data string, cantidad string, "
    "test_mode boolean, reject string, kind string, verdict string, status_before string, status_after string, "
    "suppressed_on boolean, auto_on boolean, off_us long"
)
_STATUS = {"machine_on": ACTIVE, "ping": ACTIVE, "machine_off": INACTIVE}


class MachineProcessor(StatefulProcessor):
    """State of one machine. Rows out: one per message, and one per timeout, numbered by the message before it."""

    def __init__(self, off_at, dedup_us: int, route_late: bool) -> None:
        self.off_at, self.dedup_us, self.route_late = off_at, dedup_us, route_late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine = handle.getValueState(MACHINE, MACHINE_STATE)
        self.coin_ids = handle.getMapState(COIN_IDS, "uid string", "seq long")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self._save(key, [initialState["status"], initialState["ping_us"], None, None, None])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        waiting = sorted(rows, key=lambda r: r["seq"])
        if waiting[0]["reject"] is not None:
            for row in waiting:
                yield self._row(row)
            return
        held = self.machine.get()
        state = list(held) if held else [waiting[0]["status0"], None, None, None, None]
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        # ids met in this micro-batch; a machine without an earlier message has none in the store
        self.met, self.stored_ids = set(), state[2] is not None
        for row in waiting:
            late = self.route_late and row["ts_us"] < watermark
            if late or state[2] is not None and row["seq"] <= state[2]:
                yield self._row(row, reject=ingest.LATE)
                continue
            yield from self._message(row, state)
        self._save(key, state)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, ping, seq, coin, timer = self.machine.get()
        if timer != expiredTimerInfo.getExpiryTimeInMs() or status != ACTIVE:
            return
        yield self._timeout(key[0], ping, seq)
        self.machine.update((INACTIVE, ping, seq, coin, None))

    # -- one message ----------------------------------------------------------
    def _message(self, row: Row, state: list) -> Iterator[Row]:
        """Judge a message and move the state on; a timeout found ahead of it comes first."""
        status, ping, seq = state[:3]
        now, due = row["received_us"], self.off_at(ping)
        if status == ACTIVE and due is not None and due < now:
            yield self._timeout(row["machine_id"], ping, seq)
            status = INACTIVE
        event = row["event"]
        verdict = self._coin(row, state) if event == "coin_inserted" else coin_dedup.ACCEPTED
        repeated = event == "machine_on" and status == ACTIVE
        after = _STATUS.get(event, status)
        event = "ping" if repeated else event
        yield self._row(
            row, event=event, verdict=verdict, status_before=status, status_after=after, suppressed_on=repeated,
            auto_on=event == "ping" and status is not None and status != ACTIVE,
        )
        state[:3] = after, now, row["seq"]

    def _coin(self, row: Row, state: list) -> str:
        uid, at, last = row["uid"], row["ts_us"], state[3]
        if uid is not None:
            if uid in self.met or self.stored_ids and self.coin_ids.containsKey((uid,)):
                return coin_dedup.DUPLICATE
            self.met.add(uid)
            self.coin_ids.updateValue((uid,), (row["seq"],))
        elif last is not None and abs(at - last) < self.dedup_us:
            return coin_dedup.RATE_LIMIT
        state[3] = at if last is None else max(last, at)
        return coin_dedup.ACCEPTED

    def _save(self, key, state: list) -> None:
        """Keep the state, with one timer where the machine is on."""
        due = self.off_at(state[1]) if state[0] == ACTIVE else None
        # a sweep finds the machine once the limit is passed, not when it is reached
        timer = None if due is None else due // 1000 + 1
        if timer != state[4]:
            if state[4] is not None:
                self.handle.deleteTimer(state[4])
            if timer is not None:
                self.handle.registerTimer(timer)
        state[4] = timer
        self.machine.update(tuple(state))

    # -- rows -----------------------------------------------------------------
    @staticmethod
    def _row(row: Row, **judged) -> Row:
        return Row(**{**{c: row[c] for c in CARRIED}, "kind": MESSAGE, "verdict": None, "status_before": None, "status_after": None,
                      "suppressed_on": None, "auto_on": None, "off_us": None, **judged})

    def _timeout(self, machine_id: str, ping: int, seq: int | None) -> Row:
        return Row(**{**dict.fromkeys(CARRIED), "seq": seq, "machine_id": machine_id, "kind": TIMEOUT, "verdict": None,
                      "status_before": ACTIVE, "status_after": INACTIVE, "suppressed_on": None, "auto_on": None, "off_us": self.off_at(ping)})


def judge_messages(
    messages: DataFrame, machines: DataFrame, heartbeat: Heartbeat, dedup_ms: int = S.COIN_DEDUP_MS, delay: str = "0 seconds",
    route_late: bool = False,
) -> DataFrame:
    """Rows of :data:`JUDGED_SCHEMA` of a stream of raw messages.

    The watermark runs on arrival times, ``delay`` behind the latest one. With ``route_late`` a message whose device time lies
    behind the watermark is marked late instead of judged.
    """
    timed = messages.withColumn("_at", F.col("received_at").cast("timestamp")).withWatermark("_at", delay)
    # the operator sees no event-time column, so rows behind the watermark reach it
    rows = ingest.normalise(timed, machines)
    spread = F.concat(F.lit("\0"), F.pmod("seq", F.lit(REJECT_GROUPS)).cast("string"))
    rows = rows.select(
        F.when(F.col("reject").isNull(), F.col("machine_id")).otherwise(spread).alias("key"), "seq",
        micros(F.col("received_at")).alias("received_us"), "machine_id", "event", micros(F.col("ts")).alias("ts_us"), "uid", "raw_data",
        F.col("cantidad").cast("string").alias("cantidad"), "test_mode", "reject", "status0",
    )
    known = machines.select(F.col("id").alias("key"), "status", micros(F.col("last_ping")).alias("ping_us")).groupBy("key")
    processor = MachineProcessor(heartbeat.off_at_micros, dedup_ms * 1000, route_late)
    return rows.groupBy("key").transformWithState(processor, JUDGED_SCHEMA, "Append", "eventTime", known)


@dataclass
class KeyedIngestJob(BatchTables):
    """Messages to event log, ledger, alerts and audit under ``folder``, with the states of machines in the state store.

    ``machines`` is the registry: a frame that is read anew for the names and test modes of each micro-batch, and whose status and
    last ping are the first state. Every table is written to a folder of its micro-batch, so a retried batch doubles nothing.
    """

    machines: DataFrame
    heartbeat: Heartbeat
    dedup_ms: int = S.COIN_DEDUP_MS
    delay: str = "0 seconds"
    route_late: bool = False

    def process(self, judged: DataFrame, batch: int) -> None:
        configure(self.spark)
        # read once from the operator, however many tables it feeds
        self._write(judged, "judged", batch)
        judged = self.spark.read.schema(JUDGED_SCHEMA).parquet(self._path("judged", batch))
        run = self.replayed(judged)
        events = run.events().unionByName(self.timeouts(judged))
        self._write(event_rows(events), "machine_events", batch, by_day=True)
        self._write(run.coins(), "coins", batch, by_day=True)
        self._write(alert_ops.build_alerts(events.where("alert"), self.machines), "alerts", batch)
        self._write(run.audit(), "ingest_audit", batch)

    def replayed(self, judged: DataFrame) -> Replay:
        """The judged messages in the form the batch operators expand to log, ledger and audit."""
        rows = judged.where(F.col("kind") == MESSAGE).withColumns({
            "received_at": from_micros(F.col("received_us")), "ts": from_micros(F.col("ts_us")),
            # timeouts are rows of their own here
            "off_at": F.lit(None).cast("timestamp_ntz"), "is_last": F.lit(False),
        }).drop("received_us", "ts_us", "off_us", "kind")
        return Replay(self.machines, rows, rows.where("reject is null").drop("reject"), self.heartbeat, None, None)

    @staticmethod
    def timeouts(judged: DataFrame) -> DataFrame:
        at = from_micros(F.col("off_us"))
        return judged.where(F.col("kind") == TIMEOUT).select(
            F.coalesce(open_timeout_id(F.col("seq")), idle_timeout_id(F.col("machine_id"))).alias("id"), "machine_id",
            F.lit("machine_off").alias("type"), at.alias("timestamp"), timeout_payload().alias("data"), F.lit("timeout").alias("origin"),
            F.lit(True).alias("alert"), local_day(at).alias("local_day"),
        )

    def start(self, messages: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run on a message stream. The session must use the RocksDB state store, see :func:`keyed_session`."""
        judged = judge_messages(messages, self.machines, self.heartbeat, self.dedup_ms, self.delay, self.route_late)
        writer = judged.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return writer.outputMode("append").trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def keyed_session(spark: SparkSession) -> SparkSession:
    """Keyed state needs a store that keeps several tables a key and lives on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return configure(spark)


def machine_states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(id, status, last_ping, last_seq, last_coin_ts) as a stopped or running job left them, from its state store."""
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", MACHINE).load()
    us = lambda c: from_micros(F.col(f"value.{c}"))
    return held.select(
        F.col("key.key").alias("id"), F.col("value.status").alias("status"), us("ping_us").alias("last_ping"),
        F.col("value.last_seq").alias("last_seq"), us("coin_us").alias("last_coin_ts"),
    )
