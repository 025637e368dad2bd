"""Batch replay: raw messages to event log, coin ledger, audit, snapshot and alerts."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from fichaflow import schemas as S
from fichaflow.functions.times import local_day
from fichaflow.operators import blocks, coin_dedup, ingest
from fichaflow.operators.machine_state import (
    Heartbeat, after_sweep, found_silent, silence_time, snapshot, track_states,
)

# room around each arrival number for derived events
ID_STRIDE = 4


def message_event_id(seq: Column) -> Column:
    return seq * ID_STRIDE


def auto_on_id(seq: Column) -> Column:
    return seq * ID_STRIDE + 1


def open_timeout_id(seq: Column) -> Column:
    """Sweep after a machine's last message ``seq``."""
    return seq * ID_STRIDE + 2


def idle_timeout_id(machine_id: Column) -> Column:
    """Sweep of a machine without messages: negative, apart from all others."""
    return -2 - F.pmod(F.xxhash64(machine_id), F.lit(2**62))


def timeout_id(seq: Column) -> Column:
    """Timeout found ahead of message ``seq``."""
    return seq * ID_STRIDE - 1


def _auto(reason: str) -> Column:
    return F.create_map(F.lit("auto"), F.lit("true"), F.lit("reason"), F.lit(reason))


def timeout_payload() -> Column:
    return _auto("timeout")


@dataclass
class Replay:
    """Lazy results of one replay. ``states`` has one row per accepted message."""

    machines: DataFrame
    normalised: DataFrame
    states: DataFrame
    heartbeat: Heartbeat
    as_of: Column | None
    hot: blocks.HotKeys | None

    def logged(self) -> DataFrame:
        """Messages that reach the log: all but dropped coins."""
        return self.states.where(F.col("verdict") == coin_dedup.ACCEPTED)

    def events(self) -> DataFrame:
        """Event log with a ``map<string,string>`` payload, one pass over the states.

        Dropped coins may still be preceded by a timeout, so all states are expanded.
        """
        data = ingest.logged_data(
            F.col("event"), F.col("suppressed_on"), F.col("uid"), F.col("test_mode"), F.col("raw_data"),
            F.col("cantidad"),
        )

        def row(event_id: Column, kind: Column, ts: Column, payload: Column, origin: str, alert: Column) -> Column:
            return F.struct(
                event_id.alias("id"), kind.alias("type"), ts.alias("timestamp"), payload.alias("data"),
                F.lit(origin).alias("origin"), alert.alias("alert"),
            )

        seq, yes = F.col("seq"), F.lit(True)
        admitted = coin_dedup.admission(F.col("status_after"), F.col("test_mode")) == coin_dedup.ACCEPTED
        worth_alert = F.when(F.col("event") == "coin_inserted", admitted).otherwise(
            F.col("event").isin("machine_on", "machine_off")
        )
        own = F.when(
            F.col("verdict") == coin_dedup.ACCEPTED,
            row(message_event_id(seq), F.col("event"), F.col("ts"), data, "message", worth_alert),
        )
        waking = F.when(
            F.col("auto_on"), row(auto_on_id(seq), F.lit("machine_on"), F.col("ts"), _auto("ping"), "auto_on", yes)
        )
        silent = F.when(
            F.col("off_at").isNotNull(),
            row(timeout_id(seq), F.lit("machine_off"), F.col("off_at"), _auto("timeout"), "timeout", yes),
        )
        rows = [silent, own, waking]
        if self.as_of is not None:
            ends = F.col("is_last") & found_silent(F.col("status_after"), F.col("received_at"), self.heartbeat, self.as_of)
            off = silence_time(F.col("received_at"), self.heartbeat)
            rows.append(F.when(ends, row(open_timeout_id(seq), F.lit("machine_off"), off, _auto("timeout"), "timeout", yes)))
        exploded = self.states.select("machine_id", F.explode(F.array_compact(F.array(*rows))).alias("e"))
        events = exploded.select("machine_id", "e.*")
        if self.as_of is not None:
            events = events.unionByName(self._idle_timeouts())
        return events.select("id", "machine_id", "type", "timestamp", "data", "origin", "alert",
                             local_day(F.col("timestamp")).alias("local_day"))

    def _idle_timeouts(self) -> DataFrame:
        """Timeouts of machines that were on before the replay and sent nothing in it."""
        silent = found_silent(F.col("status"), F.col("last_ping"), self.heartbeat, self.as_of)
        heard = ingest.accepted(self.normalised).select(F.col("machine_id").alias("id"))
        event_id = idle_timeout_id(F.col("id"))
        if "last_seq" in self.machines.columns:
            event_id = F.coalesce(open_timeout_id(F.col("last_seq")), event_id)
        return self.machines.where(silent).join(heard, "id", "left_anti").select(
            F.col("id").alias("machine_id"),
            event_id.alias("id"),
            F.lit("machine_off").alias("type"),
            silence_time(F.col("last_ping"), self.heartbeat).alias("timestamp"),
            _auto("timeout").alias("data"),
            F.lit("timeout").alias("origin"),
            F.lit(True).alias("alert"),
        )

    def coin_outcomes(self) -> DataFrame:
        """Coin messages with their final disposition."""
        admitted = coin_dedup.admission(F.col("status_after"), F.col("test_mode"))
        disposition = F.when(F.col("verdict") == coin_dedup.ACCEPTED, admitted).otherwise(F.col("verdict"))
        return self.states.where(F.col("event") == "coin_inserted").withColumn("disposition", disposition)

    def coins(self) -> DataFrame:
        """Coin ledger, stamped with the ingest time."""
        kept = self.coin_outcomes().where(F.col("disposition") == coin_dedup.ACCEPTED)
        event_id = message_event_id(F.col("seq"))
        return kept.select(
            event_id.alias("id"), "machine_id", F.col("received_at").alias("timestamp"),
            event_id.alias("event_id"), F.col("uid").alias("unique_id"),
            local_day(F.col("received_at")).alias("local_day"),
        )

    def audit(self) -> DataFrame:
        """What became of every message, rejected ones included."""
        admitted = coin_dedup.admission(F.col("status_after"), F.col("test_mode"))
        disposition = (
            F.when(F.col("verdict") != coin_dedup.ACCEPTED, F.col("verdict"))
            .when(F.col("event") == "coin_inserted", admitted)
            .otherwise(coin_dedup.ACCEPTED)
        )
        seen = self.states.select("seq", "machine_id", disposition.alias("disposition"))
        return seen.unionByName(ingest.rejected(self.normalised))

    def snapshot(self) -> DataFrame:
        """Registry after the replay, swept at ``as_of`` when given."""
        current = snapshot(self.states, self.machines)
        if self.as_of is not None:
            current = after_sweep(current, self.heartbeat, self.as_of)
        return current

    def alert_feed(self) -> DataFrame:
        """Source rows of alerts: ledger coins and every on and off in the log."""
        return self.events().where("alert")

    def kept(self) -> "Replay":
        """Same replay with its states in the shared checkpoint folder, when a query wants several results."""
        return replace(self, states=blocks.checkpoint(self.states))

    def stored(self, folder: str) -> "Replay":
        """Same replay reading its states from a table written to a shared folder.

        Worth it when several results are wanted: the state scan runs once and lost
        executors cost a re-read, not a replay.
        """
        path = f"{folder.rstrip('/')}/states"
        self.states.write.mode("overwrite").parquet(path)
        return replace(self, states=self.states.sparkSession.read.schema(self.states.schema).parquet(path))


def replay(
    messages: DataFrame,
    machines: DataFrame,
    heartbeat: Heartbeat | None = None,
    dedup_ms: int = S.COIN_DEDUP_MS,
    as_of: Column | None = None,
    known_ids: coin_dedup.KnownIds = None,
    last_coins: DataFrame | None = None,
    block_rows: int = blocks.BLOCK_ROWS,
    with_coins: bool = True,
    max_delay_ms: int | None = None,
) -> Replay:
    """Replay messages in arrival order from the registry's present state.

    ``known_ids`` (machine_id, uid, or a look-up of them) and ``last_coins`` (machine_id, last_coin_ts) carry
    coin history from before these messages. ``with_coins=False`` skips the coin
    checks for callers that need only machine states. ``max_delay_ms`` turns away
    messages whose device time lies further behind their arrival; by default none.
    Event ids are four times the arrival number, so that stays below 2**61 in size.
    """
    heartbeat = heartbeat or Heartbeat()
    normalised = ingest.normalise(messages, machines, max_delay_ms)
    accepted = ingest.accepted(normalised)
    # counted ahead of the registry lookup: a key column scan, no join
    named = ingest.merge_aliases(messages).where(F.col("machine_id").isNotNull()).select("machine_id", "seq")
    hot = blocks.find_hot_keys(named, "machine_id", block_rows)
    if with_coins:
        is_coin = F.col("event") == "coin_inserted"
        coins = coin_dedup.judge_coins(accepted.where(is_coin), dedup_ms, known_ids, last_coins, hot)
        others = accepted.where(~is_coin).withColumn("verdict", F.lit(coin_dedup.ACCEPTED))
        judged = others.unionByName(coins)
    else:
        judged = accepted.withColumn("verdict", F.lit(coin_dedup.ACCEPTED))
    return Replay(machines, normalised, track_states(judged, heartbeat, hot), heartbeat, as_of, hot)
