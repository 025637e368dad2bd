"""Stored tables: what is written comes back, and filters reach the scan."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from fichaflow.operators import coins as coin_ops, events as event_ops
from fichaflow.operators.machine_state import Heartbeat
from fichaflow.plans.replay import replay
from fichaflow.sources import tables
from fichaflow.sources.sample_views import SampleViews

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    views = SampleViews(spark, FOLDER)
    hours = 6 * 3600 * 1000
    run = replay(views.device_messages(), views.machines(), Heartbeat(hours), hours).stored(folder + "/work")
    tables.append_events(run.events(), folder)
    tables.append_coins(run.coins(), folder)
    tables.write_table(run.snapshot(), folder, "machines")
    return folder, run


def test_round_trip(spark, stored):
    folder, run = stored
    loaded = tables.load_tables(spark, folder, "machine_events", "coins", "machines")
    same = lambda a, b, *c: sorted(map(str, a.select(*c).collect())) == sorted(map(str, b.select(*c).collect()))
    assert same(tables.parsed_events(loaded["machine_events"]), run.events(), "id", "machine_id", "type", "timestamp", "data")
    assert same(loaded["coins"], run.coins(), "id", "machine_id", "timestamp", "event_id", "unique_id", "local_day")
    assert same(loaded["machines"], run.snapshot(), "id", "status", "last_ping", "type")


def test_income_prunes_days_and_columns(spark, stored):
    coins = tables.read_table(spark, stored[0], "coins")
    plan = plan_of(coin_ops.daily_income(coins, "Maquina_Boxeo_03", "2024-01-10", "2024-01-12"))
    assert "PartitionFilters: [isnotnull(local_day" in plan
    assert "PushedFilters: [IsNotNull(machine_id), EqualTo(machine_id,Maquina_Boxeo_03)]" in plan
    assert "ReadSchema: struct<machine_id:string>" in plan


def test_event_filter_is_pushed(spark, stored):
    events = tables.read_table(spark, stored[0], "machine_events")
    rows = event_ops.filter_events(events, dt.datetime(2024, 1, 31), "7d").select("id")
    assert "GreaterThanOrEqual(timestamp,2024-01-24T00:00)" in plan_of(rows)
    assert "local_day#" in plan_of(rows).split("PartitionFilters: [")[1].split("]")[0]
    page = plan_of(event_ops.page_events(events, 1))
    assert "TakeOrderedAndProject" in page and "local_day#" in page.split("PartitionFilters: [")[1].split("]")[0]


def test_appending_twice_adds_nothing(spark, tmp_path):
    views = SampleViews(spark, FOLDER)
    run = replay(views.device_messages(), views.machines(), Heartbeat())
    for _ in range(2):
        tables.append_coins(run.coins(), str(tmp_path))
        tables.append_events(run.events(), str(tmp_path))
    assert tables.read_table(spark, str(tmp_path), "coins").count() == run.coins().count()
    assert tables.read_table(spark, str(tmp_path), "machine_events").count() == run.events().count()


def test_state_scan_shuffles_once(spark, stored):
    views = SampleViews(spark, FOLDER)
    machines = tables.read_table(spark, stored[0], "machines")
    run = replay(views.device_messages(), machines, Heartbeat(), with_coins=False)
    plan = plan_of(run.states)
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastExchange" in plan


def test_coin_dedup_joins_on_the_arrival_number(spark):
    views = SampleViews(spark, FOLDER)
    run = replay(views.device_messages(), views.machines(), Heartbeat())
    assert "SortMergeJoin [seq" in plan_of(run.states) or "HashJoin [seq" in plan_of(run.states)


def test_json_messages(spark, tmp_path):
    (tmp_path / "m.json").write_text(
        '{"seq": 1, "received_at": "2024-01-01T10:00:00.5", "maquina_id": "m", "evento": "MONEDA", "data": {"a": 1}, "cantidad": 2}\n')
    row = tables.read_device_events(spark, str(tmp_path)).first()
    assert (row.seq, row.received_at, row.cantidad) == (1, dt.datetime(2024, 1, 1, 10, 0, 0, 500000), "2")
    assert json.loads(row.data) == {"a": 1}
    assert tables.read_device_events(spark, str(tmp_path), streaming=True).isStreaming


def test_checkpoint_folder_comes_from_the_session(spark):
    from fichaflow.operators.blocks import checkpoint

    assert checkpoint(spark.range(3)).agg(F.sum("id")).first()[0] == 3
    assert spark.sparkContext.getCheckpointDir()
