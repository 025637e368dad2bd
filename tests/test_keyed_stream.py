"""The keyed stream agrees with one batch replay, over several files, late messages, bursts of coins and a restart."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import Row, functions as F

from fichaflow.operators.machine_state import Heartbeat
from fichaflow.plans.replay import replay
from fichaflow.sources.tables import read_device_events
from fichaflow.streaming.keyed import KeyedIngestJob, MachineProcessor, keyed_session, machine_states

START = dt.datetime(2024, 1, 1, 12)
REGISTRY = "id string, name string, status string, location string, last_ping timestamp_ntz, test_mode boolean, type string"
MINUTE = 60_000


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def registry(spark):
    return spark.createDataFrame([
        ("a", "a", "inactive", "l", None, False, "boxeo"), ("b", "b", "active", "l", at(-30), False, "boxeo"),
        ("c", "c", "active", "l", at(-20), True, "boxeo"), ("idle", "i", "active", "l", at(-5), False, "boxeo"),
        ("m", "m", "maintenance", "l", at(-900), False, "boxeo"), ("never", "n", "active", "l", None, False, "boxeo"),
    ], REGISTRY)


def message(seq, seconds, machine, event, uid=None, device=None):
    out = {"seq": seq, "received_at": at(seconds).isoformat(timespec="milliseconds"), "machineId": machine, "event": event}
    if uid is not None:
        out["id_unico"] = uid
    if device is not None:
        out["timestamp"] = at(device).isoformat(timespec="milliseconds") + "Z"
    return out


def send(folder, number, messages):
    """One more file, later than those before, whatever the clock's grain."""
    folder.mkdir(exist_ok=True)
    file = folder / f"part{number}.json"
    file.write_text("\n".join(map(json.dumps, messages)))
    os.utime(file, (1_700_000_000 + number,) * 2)


def many(rng, first, n, start):
    """Bursts and gaps, repeated coin ids, late device times, unknown machines and missing fields."""
    out, clock = [], start
    for seq in range(first, first + n):
        clock += rng.choice([0.2, 0.7, 1.1, 2.9, 3.0, 14.0, 70.0])
        kind = rng.choice(["ENCENDIDO", "ping", "APAGADO", "MONEDA", "MONEDA", "MONEDA", "coin_inserted", "odd"])
        late = clock - rng.choice([0, 0, 0, 1.4, 2.8, 40])
        uid = rng.choice([None, None, f"u{rng.randrange(12)}"])
        out.append(message(seq, clock, rng.choice(["a", "b", "c", "m", "ghost", None]), rng.choice([kind, kind, kind, kind, None]), uid, late))
    return out, clock


def run_all(job, source, checkpoint):
    query = job.start(source, str(checkpoint), availableNow=True)
    query.awaitTermination(600)
    assert query.exception() is None


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def stream(spark, tmp_path_factory):
    """Two files, a restart, two more; then one message of another machine, long after."""
    keyed_session(spark)
    root, rng = tmp_path_factory.mktemp("keyed"), random.Random(11)
    everything, clock = [], 0.0
    job = KeyedIngestJob(spark, str(root / "out"), registry(spark), Heartbeat(MINUTE))
    source = lambda: read_device_events(spark, str(root / "in"), streaming=True, max_files=1)
    for number in range(4):
        part, clock = many(rng, 1 + 150 * number, 150, clock)
        everything += part
        send(root / "in", number, part)
        if number in (1, 3):
            run_all(job, source(), root / "cp")
    ends = message(9000, clock + 1000, "a", "APAGADO")
    everything.append(ends)
    send(root / "in", 9, [ends])
    run_all(job, source(), root / "cp")
    send(root / "all", 0, everything)
    batch = replay(read_device_events(spark, str(root / "all")), registry(spark), Heartbeat(MINUTE),
                   as_of=F.lit(str(at(clock + 1000))).cast("timestamp_ntz"))
    return job, batch, root


def test_log_ledger_audit_and_alerts_match_the_batch(stream):
    job, batch, _ = stream
    assert job.read("judged").select("batch").distinct().count() >= 5
    for name, want, columns in (
        ("machine_events", batch.events(), ("machine_id", "type", "timestamp", "origin", "local_day")),
        ("coins", batch.coins(), ("id", "machine_id", "timestamp", "event_id", "unique_id")),
        ("ingest_audit", batch.audit(), ("seq", "machine_id", "disposition")),
    ):
        assert rows(job.read(name), *columns) == rows(want, *columns), name
    kinds = {r.disposition for r in job.read("ingest_audit").collect()}
    assert kinds >= {"accepted", "duplicate", "rate_limit", "ghost_coin", "test_coin", "unknown_machine", "missing_field"}
    assert job.read("alerts").count() == batch.alert_feed().count()
    assert job.read("machine_events").groupBy("id").count().where("count > 1").count() == 0


def test_payloads_match_the_batch(stream):
    job, batch, _ = stream
    got = job.read("machine_events").where("origin = 'message'")
    assert rows(got, "id", "data") == rows(batch.events().where("origin = 'message'").withColumn("data", F.to_json("data")), "id", "data")


def test_states_match_the_batch(stream, spark):
    job, batch, root = stream
    states = machine_states(spark, str(root / "cp"))
    want = {r.id: (r.status, r.last_ping, r.last_seq) for r in batch.snapshot().collect()}
    got = {r.id: (r.status, r.last_ping, r.last_seq) for r in states.collect()}
    assert got == want
    assert got["idle"][0] == got["b"][0] == "inactive" and got["never"][0] == "active"


def test_silent_machine_is_switched_off_without_a_message_of_its_own(spark, tmp_path):
    """Only other machines speak; its timer fires as they move the watermark."""
    keyed_session(spark)
    job = KeyedIngestJob(spark, str(tmp_path / "out"), registry(spark), Heartbeat(MINUTE))
    source = lambda: read_device_events(spark, str(tmp_path / "in"), streaming=True, max_files=1)
    send(tmp_path / "in", 0, [message(1, 0, "a", "machine_on"), message(2, 1, "b", "ping")])
    run_all(job, source(), tmp_path / "cp")
    off = lambda: rows(job.read("machine_events").where("type = 'machine_off'"), "machine_id", "timestamp", "id")
    assert off() == []
    send(tmp_path / "in", 1, [message(3, 60, "b", "ping")])  # just at the limit: not passed yet
    run_all(job, source(), tmp_path / "cp")
    assert [x[:2] for x in off()] == [("c", at(40)), ("idle", at(55))]
    send(tmp_path / "in", 2, [message(4, 61, "b", "ping")])
    run_all(job, source(), tmp_path / "cp")
    assert ("a", at(60), 4 * 1 + 2) in off()
    send(tmp_path / "in", 3, [message(5, 70, "a", "ping")])  # wakes up: no second off, an automatic on
    run_all(job, source(), tmp_path / "cp")
    assert len(off()) == 3
    assert [r.origin for r in job.read("machine_events").where("machine_id = 'a'").orderBy("id").collect()] == ["message", "timeout", "message", "auto_on"]


@pytest.mark.parametrize("delay, late", [("0 seconds", {3, 5}), ("30 seconds", {5}), ("10 minutes", set())])
def test_late_messages_go_to_the_audit(spark, tmp_path, delay, late):
    keyed_session(spark)
    job = KeyedIngestJob(spark, str(tmp_path / "out"), registry(spark), Heartbeat(None), delay=delay, route_late=True)
    send(tmp_path / "in", 0, [message(1, 0, "a", "machine_on"), message(2, 100, "b", "ping")])
    send(tmp_path / "in", 1, [message(3, 110, "a", "MONEDA", "x", device=90), message(4, 111, "a", "MONEDA", "y", device=110),
                              message(5, 112, "b", "ping", device=20), message(6, 113, "nobody", "ping", device=20)])
    run_all(job, read_device_events(spark, str(tmp_path / "in"), streaming=True, max_files=1), tmp_path / "cp")
    verdicts = {r.seq: r.disposition for r in job.read("ingest_audit").collect()}
    assert {s for s, d in verdicts.items() if d == "late"} == late
    assert sorted(verdicts) == [1, 2, 3, 4, 5, 6] and verdicts[6] == "unknown_machine" and verdicts[4] == "accepted"
    logged = {r.id // 4 for r in job.read("machine_events").collect()}
    assert logged == {1, 2, 3, 4, 5} - late


def test_messages_delivered_again_are_late(spark, tmp_path):
    """A message at or behind the machine's last number changes nothing, even in the same micro-batch."""
    keyed_session(spark)
    job = KeyedIngestJob(spark, str(tmp_path / "out"), registry(spark), Heartbeat(MINUTE))
    first = [message(1, 0, "a", "machine_on"), message(2, 5, "a", "MONEDA"), message(2, 5, "a", "MONEDA")]
    send(tmp_path / "in", 0, first)
    send(tmp_path / "in", 1, first[:2])
    run_all(job, read_device_events(spark, str(tmp_path / "in"), streaming=True, max_files=1), tmp_path / "cp")
    assert rows(job.read("ingest_audit"), "seq", "disposition") == [(1, "accepted"), (1, "late"), (2, "accepted"), (2, "late"), (2, "late")]
    assert job.read("coins").count() == 1


class Held:
    """State of one key in memory, with the number of look-ups."""

    def __init__(self, value=None):
        self.value, self.ids, self.asked = value, {}, 0

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def containsKey(self, key):  # noqa: N802
        self.asked += 1
        return key in self.ids

    def updateValue(self, key, value):  # noqa: N802
        self.ids[key] = value


class Timers:
    def getCurrentWatermarkInMs(self):  # noqa: N802
        return 0


def coin(seq, uid):
    return Row(seq=seq, received_us=seq * 10**6, machine_id="a", event="coin_inserted", ts_us=seq * 10**6, uid=uid, raw_data=None,
               cantidad=None, test_mode=False, reject=None, status0="active")


def test_ids_of_a_first_batch_are_not_looked_up_in_the_store():
    processor = MachineProcessor(lambda ping: None, 3_000_000, False)
    processor.machine, processor.coin_ids = Held(("active", None, None, None, None)), Held()
    judge = lambda rows: [r["verdict"] for r in processor.handleInputRows(("a",), iter(rows), Timers())]
    assert judge([coin(1, "x"), coin(2, "y"), coin(3, "x")]) == ["accepted", "accepted", "duplicate"]
    assert processor.coin_ids.asked == 0
    assert judge([coin(4, "y"), coin(5, "z"), coin(6, "z")]) == ["duplicate", "accepted", "duplicate"]
    assert processor.coin_ids.asked == 2
