"""Block scans agree with plain loops, whatever the block size and the order of device times."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fichaflow.operators import coin_dedup, events as event_ops, machines as machine_ops, sales as sale_ops
from fichaflow.operators.blocks import BLK, find_hot_keys, with_blocks
from fichaflow.operators.machine_state import Heartbeat, track_states

START = dt.datetime(2024, 1, 1)


def at(ms):
    return START + dt.timedelta(milliseconds=ms)


def test_hot_keys_are_those_above_the_limit(spark):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(["hot"] * 20 + ["cold"] * 3)], "k string, seq long")
    hot = find_hot_keys(rows, "k", 5)
    assert [r.k for r in hot.keys.collect()] == ["hot"] and hot.block_rows == 5
    assert find_hot_keys(rows, "k", 100) is None


@pytest.mark.parametrize("spread", [1, 2**22])
def test_blocks_follow_ranks_not_numbers(spark, spread):
    """However sparse the positions and however many the hot keys, blocks are full."""
    rows = [("hot" if i % 2 else f"k{i % 40}", i * spread) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, seq long").repartition(5)
    hot = find_hot_keys(df, "k", 30)
    cuts = with_blocks(df, "k", hot).groupBy("k", BLK).count().collect()
    keys = {k for k, _ in rows}
    assert {r.k for r in cuts} == keys and hot.keys.count() == len(keys)
    assert sum(r["count"] for r in cuts) == 4000 and max(r["count"] for r in cuts) == 30
    assert len(cuts) <= 4000 / 30 + len(keys)
    order = with_blocks(df, "k", hot).orderBy("k", "seq").select("k", BLK).collect()
    assert all(a[BLK] <= b[BLK] for a, b in zip(order, order[1:]) if a.k == b.k)


# ---- coins ------------------------------------------------------------------
def coin_rows(seed, spread, late):
    rnd = random.Random(seed)
    rows, clock = [], 0
    for seq in range(1500):
        clock += rnd.choice([0, 100, 400, 900, 1500, 2900, 3000, spread])
        ts = clock - (rnd.randint(0, 20000) if rnd.random() < late else 0)
        machine = "hot" if rnd.random() < 0.8 else rnd.choice(["m1", "m2"])
        uid = str(rnd.randint(1, 300)) if rnd.random() < 0.15 else None
        rows.append((seq, machine, "coin_inserted", at(ts), uid))
    return rows


def coin_loop(rows, window_ms):
    last, seen, out = {}, set(), {}
    for seq, machine, _, ts, uid in rows:
        if uid is not None:
            if (machine, uid) in seen:
                out[seq] = "duplicate"
                continue
            seen.add((machine, uid))
        elif machine in last and abs(ts - last[machine]) < dt.timedelta(milliseconds=window_ms):
            out[seq] = "rate_limit"
            continue
        last[machine] = max(last.get(machine, ts), ts)
        out[seq] = "accepted"
    return out


@pytest.mark.parametrize("seed,spread,late,block", [
    (1, 5000, 0.0, None), (2, 5000, 0.3, 7), (3, 800, 0.0, 5), (4, 800, 0.4, 11), (5, 100, 0.1, 3), (6, 100, 0.0, 50),
])
def test_coin_chain(spark, seed, spread, late, block):
    rows = coin_rows(seed, spread, late)
    df = spark.createDataFrame(rows, "seq long, machine_id string, event string, ts timestamp_ntz, uid string")
    hot = find_hot_keys(df, "machine_id", block) if block else None
    got = {r.seq: r.verdict for r in coin_dedup.judge_coins(df, 3000, hot=hot).collect()}
    assert got == coin_loop(rows, 3000)


def test_burst_keeps_first_and_third_second(spark):
    rows = [(i, "m", "coin_inserted", at(i * 1000), None) for i in range(5)] + [
        (5, "m", "coin_inserted", at(6000), None),       # exactly the window after 3 s
        (6, "m", "coin_inserted", at(1000), None),       # late by more than the window
        (7, "m", "coin_inserted", at(7000), "a"),        # an id passes inside the window
        (8, "m", "coin_inserted", at(9999), None),       # and moves the reference
    ]
    df = spark.createDataFrame(rows, "seq long, machine_id string, event string, ts timestamp_ntz, uid string")
    kept = [r.seq for r in coin_dedup.judge_coins(df, 3000).where("verdict = 'accepted'").orderBy("seq").collect()]
    assert kept == [0, 3, 5, 6, 7]


def test_history_before_the_batch(spark):
    rows = [(0, "m", "coin_inserted", at(1000), None), (1, "m", "coin_inserted", at(2000), "a"),
            (2, "m", "coin_inserted", at(9000), "b")]
    df = spark.createDataFrame(rows, "seq long, machine_id string, event string, ts timestamp_ntz, uid string")
    known = spark.createDataFrame([("m", "a")], "machine_id string, uid string")
    last = spark.createDataFrame([("m", at(0))], "machine_id string, last_coin_ts timestamp_ntz")
    got = {r.seq: r.verdict for r in coin_dedup.judge_coins(df, 3000, known, last).collect()}
    assert got == {0: "rate_limit", 1: "duplicate", 2: "accepted"}


# ---- machine states ---------------------------------------------------------
def state_rows(seed):
    rnd = random.Random(seed)
    rows, clock = [], 0
    for seq in range(1500):
        clock += rnd.choice([1, 10, 30, 59, 61, 200]) * 1000
        machine = "hot" if rnd.random() < 0.8 else rnd.choice(["m1", "m2"])
        event = rnd.choice(["machine_on", "machine_off", "ping", "coin_inserted", "game_start", "coin_inserted"])
        rows.append((seq, machine, event, at(clock)))
    return rows


def state_loop(rows, initial, off_at):
    state, out = {}, {}
    for seq, machine, event, now in rows:
        status, ping = state.get(machine, initial)
        off = None
        if status == "active" and ping is not None and off_at(ping) < now:
            off, status = off_at(ping), "inactive"
        before = status
        if event == "machine_on" and status == "active":
            event = "ping"
        status = {"machine_on": "active", "ping": "active", "machine_off": "inactive"}.get(event, status)
        out[seq] = (event, before, status, event == "ping" and before != "active", off)
        state[machine] = (status, now)
    return out, {m: max(s for s, k, _, _ in rows if k == m) for m in state}


@pytest.mark.parametrize("initial", [("inactive", None), ("active", None), ("maintenance", START), ("active", START)])
@pytest.mark.parametrize("mode,block", [("exact", None), ("exact", 9), ("tick", 40)])
def test_state_scan(spark, initial, mode, block):
    rows = state_rows(hash((initial[0], mode)) % 1000)
    df = spark.createDataFrame(rows, "seq long, machine_id string, event string, received_at timestamp_ntz")
    df = df.withColumns({"status0": F.lit(initial[0]), "ping0": F.lit(initial[1]).cast("timestamp_ntz")})
    hot = find_hot_keys(df, "machine_id", block) if block else None
    minute = dt.timedelta(seconds=60)

    def off_at(ping):
        if mode == "exact":
            return ping + minute
        return at(0) + ((ping + minute - at(0)) // minute + 1) * minute

    want, last = state_loop(rows, initial, off_at)
    got = track_states(df, Heartbeat(60_000, mode=mode), hot).collect()
    assert {r.seq: (r.event, r.status_before, r.status_after, r.auto_on, r.off_at) for r in got} == want
    assert {r.machine_id: r.seq for r in got if r.is_last} == last


# ---- balances, sessions, ids, pages -----------------------------------------
@pytest.mark.parametrize("block", [None, 6])
def test_balance(spark, block):
    rnd = random.Random(7)
    entries, resets, want, balance = [], [], {}, {}
    for seq in range(800):
        who = 1 if rnd.random() < 0.8 else 2
        if rnd.random() < 0.1:
            resets.append((seq, who))
            balance[who] = 200
        else:
            coins = rnd.choice([0, 5, 30, 90])
            entries.append((seq, who, coins))
            balance[who] = max(0, balance.get(who, 200) - coins)
        want[seq] = balance[who]
    e = spark.createDataFrame(entries, "id long, employee_id long, coins int")
    r = spark.createDataFrame(resets, "seq long, employee_id long")
    got = sale_ops.operator_balance(e, r, **({"block_rows": block} if block else {})).collect()
    assert {x.seq: x.balance for x in got} == want
    users = spark.createDataFrame([(1, None), (2, None), (3, 120)], "id long, operator_coin_balance int")
    now = {x.employee_id: x.remaining_coins for x in sale_ops.current_balance(users, e, r).collect()}
    assert now == {1: balance[1], 2: balance[2], 3: 120}


def test_balance_computes_its_movements_once(spark):
    """Counting, cutting and summing read them as stored, also with hot employees."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(seq):
        seen.add(1)
        return seq

    e = spark.range(60).select(counted("id").alias("id"), (F.col("id") % 2).alias("employee_id"), F.lit(3).alias("coins"))
    r = spark.createDataFrame([(100, 0), (101, 5)], "seq long, employee_id long")
    got = {x.seq: x.balance for x in sale_ops.operator_balance(e, r, block_rows=7).collect()}
    assert got == {**{k: 200 - 3 * (k // 2 + 1) for k in range(60)}, 100: 200, 101: 200}
    assert seen.value == 60


@pytest.mark.parametrize("block", [None, 8])
def test_power_sessions(spark, block):
    rnd = random.Random(3)
    rows, clock = [], 0
    for i in range(400):
        clock += rnd.choice([0, 10, 29_999, 30_000, 3_600_000])
        rows.append((i, "hot" if rnd.random() < 0.8 else "m", rnd.choice(["machine_on", "machine_off", "ping"]), at(clock)))
    df = spark.createDataFrame(rows, "id long, machine_id string, type string, timestamp timestamp_ntz")
    want, opened = {}, {}
    for i, machine, kind, ts in rows:
        if kind == "machine_on":
            want[i], opened[machine] = None, (i, ts)
        elif kind == "machine_off":
            want[i] = None
            on = opened.pop(machine, None)
            if on and ts > on[1]:
                want[on[0]] = int((ts - on[1]).total_seconds() * 1000 / 60000 + 0.5)
    got = event_ops.power_sessions(df, **({"block_rows": block} if block else {})).collect()
    assert {r.id: r.dur for r in got} == want


def test_ids_follow_explicit_ones(spark):
    machines = spark.createDataFrame([("Maquina_Boxeo_99",), ("Maquina_Agilidad_03",)], "id string")
    batch = [(0, None, "Boxeo A", None), (1, None, "x", None), (2, "Maquina_Agilidad_07", "y", None),
             (3, None, "z", "agilidad"), (4, None, "z", "Boxeo"), (5, "otra", "Boxeo B", None), (6, None, "z", "boxeo")]
    df = spark.createDataFrame(batch, "seq long, id string, name string, type string")
    want = ["Maquina_Boxeo_100", "Maquina_Agilidad_04", "Maquina_Agilidad_07", "Maquina_Agilidad_08", "Maquina_Boxeo_101",
            "otra", "Maquina_Agilidad_09"]
    for block in (1, 2, 1000):
        got = machine_ops.assign_sequential_ids(df, machines, block).orderBy("seq").collect()
        assert [r.id for r in got] == want


def test_deep_page_is_narrowed(spark, monkeypatch):
    monkeypatch.setattr(event_ops, "SLICE_ROWS", 3)
    rows = [(i, at(i * 40_000 + (i % 7) * 200)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, timestamp timestamp_ntz")
    order = [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]), reverse=True)]
    for page, size in ((1, 10), (7, 10), (50, 10), (51, 10), (3, 150)):
        got = [r.id for r in event_ops.page_events(df, page, size).collect()]
        assert got == order[(page - 1) * size: page * size]
