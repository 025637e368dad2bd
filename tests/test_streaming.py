"""The ingest job over several micro-batches agrees with one batch replay."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fichaflow.operators.machine_state import Heartbeat
from fichaflow.plans.replay import replay
from fichaflow.sources.sample_views import SampleViews
from fichaflow.sources.tables import read_device_events
from fichaflow.streaming.jobs import IngestJob, daily_income_stream, drop_repeated_coins

FOLDER = "/root/testdata/sf0.001"
SIX_HOURS = 6 * 3600 * 1000


@pytest.fixture(scope="module")
def stream(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stream")
    views = SampleViews(spark, FOLDER)
    messages = views.device_messages()
    total = messages.count()
    for i in range(3):
        part = messages.where((F.col("seq") * 3 / total).cast("int") == i).coalesce(1)
        part.write.json(str(root / "in" / f"part{i}"))
    files = str(root / "in" / "*")
    job = IngestJob(spark, str(root / "out"), views.machines(), Heartbeat(SIX_HOURS), SIX_HOURS)
    query = job.start(read_device_events(spark, files, streaming=True, max_files=1), str(root / "cp"), availableNow=True)
    query.awaitTermination(300)
    last = messages.agg(F.date_trunc("millisecond", F.max("received_at")).cast("timestamp_ntz")).first()[0]
    run = replay(messages, views.machines(), Heartbeat(SIX_HOURS), SIX_HOURS, F.lit(str(last)).cast("timestamp_ntz"))
    return job, run, root


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_micro_batches_match_batch(stream):
    job, run, _ = stream
    assert job.read("snapshots").select("batch").distinct().count() == 3
    assert rows(job.read("machine_events"), "machine_id", "type", "timestamp") == rows(
        run.events(), "machine_id", "type", "timestamp")
    assert rows(job.read("coins"), "id", "machine_id", "timestamp", "unique_id") == rows(
        run.coins(), "id", "machine_id", "timestamp", "unique_id")
    assert rows(job.read("ingest_audit"), "seq", "disposition") == rows(run.audit(), "seq", "disposition")
    assert rows(job.snapshot(2), "id", "status", "last_ping") == rows(run.snapshot(), "id", "status", "last_ping")
    assert job.read("alerts").count() == run.alert_feed().count()
    ids = job.read("machine_events").groupBy("id").count()
    assert ids.where("count > 1").count() == 0


def test_retried_batch_changes_nothing(stream, spark):
    job, _, root = stream
    before = rows(job.read("machine_events"), "id", "type", "timestamp")
    again = read_device_events(spark, str(root / "in" / "part2"))
    job.process(again, 2)
    assert rows(job.read("machine_events"), "id", "type", "timestamp") == before


def test_income_stream(stream, spark):
    job, run, root = stream
    path = str(root / "out" / "coins")
    coins = spark.readStream.schema("machine_id string, timestamp timestamp_ntz").parquet(path + "/*/*")
    query = daily_income_stream(coins).writeStream.format("memory").queryName("income").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    want = run.coins().groupBy("machine_id", F.col("local_day").alias("date")).agg(F.count("*").alias("income"))
    assert rows(spark.table("income"), "machine_id", "date", "income") == rows(want, "machine_id", "date", "income")


def test_repeated_coin_stream(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    data = [(1, "a", "x", at), (2, "a", "x", at), (3, "b", "x", at), (4, "a", "y", at)]
    schema = "seq long, machine_id string, uid string, ts timestamp_ntz"
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "c"))
    for delay in (None, "1 hour"):
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "c"))
        query = drop_repeated_coins(source, delay).writeStream.format("memory").queryName("kept").start()
        query.processAllAvailable()
        query.stop()
        assert [tuple(r) for r in spark.sql("select machine_id, uid from kept order by 1, 2").collect()] == [
            ("a", "x"), ("a", "y"), ("b", "x")]
        spark.catalog.dropTempView("kept")


def test_the_registry_is_read_in_each_batch(spark, tmp_path):
    """A machine added after the first batch and a test mode switched on count from the next batch on."""
    at = dt.datetime(2024, 1, 1, 12)
    columns = "id string, name string, status string, location string, last_ping timestamp_ntz, test_mode boolean, type string"
    registry = [[("a", "a", "inactive", "l", None, False, "boxeo")]]
    job = IngestJob(spark, str(tmp_path), lambda: spark.createDataFrame(registry[-1], columns), Heartbeat())

    def send(batch, *rows):
        path = str(tmp_path / f"in{batch}")
        out = []
        for seq, machine, event in rows:
            when = (at + dt.timedelta(seconds=30 * seq)).isoformat()
            out.append(f'{{"seq": {seq}, "received_at": "{when}", "machineId": "{machine}", "event": "{event}"}}')
        (tmp_path / f"in{batch}").mkdir()
        (tmp_path / f"in{batch}" / "m.json").write_text("\n".join(out))
        job.process(read_device_events(spark, path), batch)

    send(0, (1, "a", "machine_on"), (2, "b", "machine_on"))
    registry.append([("a", "a", "inactive", "l", None, True, "boxeo"), ("b", "b", "inactive", "l", None, False, "boxeo")])
    send(1, (3, "a", "coin_inserted"), (4, "b", "machine_on"), (5, "b", "coin_inserted"))
    verdicts = {r.seq: r.disposition for r in job.read("ingest_audit").collect()}
    assert verdicts[2] == "unknown_machine" and verdicts[3] == "test_coin" and verdicts[5] == "accepted"
    assert {r.id: r.status for r in job.snapshot(1).collect()} == {"a": "active", "b": "active"}


def test_income_stream_follows_the_zone(spark, tmp_path):
    """Half past four was the start of the local day in 2010."""
    rows = [("m", dt.datetime(2010, 6, 1, 4, 10)), ("m", dt.datetime(2010, 6, 1, 4, 40)), ("m", dt.datetime(2024, 1, 5, 4, 10))]
    spark.createDataFrame(rows, "machine_id string, timestamp timestamp_ntz").write.parquet(str(tmp_path / "c"))
    coins = spark.readStream.schema("machine_id string, timestamp timestamp_ntz").parquet(str(tmp_path / "c"))
    query = daily_income_stream(coins).writeStream.format("memory").queryName("zoned").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {str(r.date): r.income for r in spark.table("zoned").collect()} == {"2010-05-31": 1, "2010-06-01": 1, "2024-01-05": 1}
