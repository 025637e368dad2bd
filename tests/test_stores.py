"""Stored tables that are appended to and merged into: only what a batch touches is read and rewritten."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from fichaflow import schemas as S
from fichaflow.operators import coins as coin_ops, events as event_ops, reports as report_ops, sales as sale_ops
from fichaflow.operators.machine_state import Heartbeat
from fichaflow.plans.replay import replay
from fichaflow.sources import files, tables
from fichaflow.sources.known_ids import KnownIds
from fichaflow.sources.sample_views import SampleViews

FOLDER = "/root/testdata/sf0.001"
COINS = "id long, machine_id string, timestamp timestamp_ntz, event_id long, unique_id string, local_day date"


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files_read(df):
    """Files that the frame's one scan reads, after pruning."""
    df.collect()
    scans = df._jdf.queryExecution().executedPlan().collectLeaves()
    assert scans.size() == 1
    return scans.head().metrics().apply("numFiles").value()


def coin(i, machine, day, uid=None):
    at = dt.datetime(2024, 1, day, 12, i % 60)
    return (i, machine, at, i, uid, at.date())


@pytest.fixture(scope="module")
def run(spark):
    views = SampleViews(spark, FOLDER)
    hours = 6 * 3600 * 1000
    return replay(views.device_messages(), views.machines(), Heartbeat(hours), hours).kept()


# ---- known ids --------------------------------------------------------------
def test_known_ids_equal_the_exact_anti_join(spark, tmp_path):
    """Also with filters far too small, which read more buckets but answer the same."""
    rng = random.Random(1)
    for number, bits in enumerate((1 << 20, 64)):
        index, have = KnownIds(spark, str(tmp_path / f"ids{number}"), buckets=8, bits=bits), set()
        assert index.known(spark.createDataFrame([("a", "x")], "machine_id string, uid string")) is None
        for batch in range(3):
            ids = [(rng.choice("abc"), rng.choice([None, f"u{rng.randrange(60)}"])) for _ in range(40)]
            frame = spark.createDataFrame(ids, "machine_id string, uid string")
            if batch:
                assert {tuple(r) for r in index.known(frame).collect()} == set(ids) & have
                # a retried batch must not see itself
                assert {tuple(r) for r in index.known(frame, F.col("batch") < str(batch)).collect()} == set(ids) & have
            index.add(frame, str(batch))
            index.add(frame, str(batch))
            have |= {x for x in ids if x[1] is not None}
        assert spark.read.parquet(str(tmp_path / f"ids{number}" / "ids")).count() >= len(have)


def test_known_ids_read_only_buckets_they_may_hit(spark, tmp_path):
    index = KnownIds(spark, str(tmp_path), buckets=32)
    index.add(spark.range(2000).selectExpr("'m' as machine_id", "concat('u', id) as uid"), "0")
    asked = spark.createDataFrame([("m", "u7"), ("m", "new1"), ("m", "new2"), ("n", "u7")], "machine_id string, uid string")
    assert rows(index.hits(asked), "machine_id", "uid") == [("m", "u7")]
    plan = plan_of(index.known(asked))
    bucket = index.hits(asked).first()["bucket"]
    assert re.search(rf"PartitionFilters: \[[^\]]*\(bucket#\d+ = {bucket}\)", plan) or f"IN ({bucket})" in plan
    assert files_read(index._read("ids", "machine_id string, uid string", None).where(F.col("bucket").isin([bucket]))) == 1
    none = index.known(asked.where("uid like 'new%'"))
    assert none.count() == 0


# ---- appends ----------------------------------------------------------------
def test_appends_by_halves_and_again_are_the_whole(spark, tmp_path, run):
    half = F.lit("2024-01-16").cast("date")
    folder = str(tmp_path)
    for early, batch in ((True, "1"), (False, "2"), (False, "2"), (True, None)):
        pick = F.col("local_day") < half if early else F.col("local_day") >= half
        tables.append_events(run.events().where(pick), folder, batch)
        tables.append_coins(run.coins().where(pick), folder, batch)
    for name, want in (("machine_events", tables.event_rows(run.events())), ("coins", run.coins())):
        columns = S.TABLES[name].names
        assert rows(tables.read_table(spark, folder, name), *columns) == rows(want, *columns)
    counts = tables.coin_counts(spark, folder)
    ledger = tables.read_table(spark, folder, "coins")
    for wanted in ((None, None, None), ("Maquina_Boxeo_03", "2024-01-10", "2024-01-20"), (None, "2024-01", None)):
        assert coin_ops.daily_income(counts, *wanted).collect() == coin_ops.daily_income(ledger, *wanted).collect()
    assert rows(coin_ops.coins_by_machine(counts), "*") == rows(coin_ops.coins_by_machine(ledger), "*")
    assert coin_ops.total_coins(counts).first() == coin_ops.total_coins(ledger).first()
    assert "/coins/" not in "".join(counts.inputFiles())


def test_append_reads_only_the_days_it_touches(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    days = [[coin(10 * d + i, "ab"[i % 2], d, f"u{d}{i}" if i else None) for i in range(6)] for d in (1, 2, 3)]
    for d, data in enumerate(days):
        tables.append_coins(spark.createDataFrame(data, COINS), folder, str(d))
    read = []
    plain = tables.by_batch
    monkeypatch.setattr(tables, "by_batch", lambda *a: read.append(plain(*a)) or read[-1])
    # an old id on a new day, an old coin again, and a new one
    new = [coin(90, "b", 2, "u11"), coin(20, "a", 2), coin(91, "a", 2), coin(92, "a", 2, "new")]
    tables.append_coins(spark.createDataFrame(new, COINS), folder, "9")
    assert [files_read(df) for df in read] == [1, 2]  # of three files, then with the new batch's own
    assert "PartitionFilters: [isnotnull(local_day" in plan_of(read[0])
    assert sorted(r.id for r in tables.read_table(spark, folder, "coins").collect()) == sorted([c[0] for d in days for c in d] + [91, 92])


def test_append_that_stopped_is_made_whole_by_a_retry(spark, tmp_path, monkeypatch):
    """The ledger was written, ids and counts were not; the same batch, or a new one, puts it right."""
    for number, batch in enumerate(("7", None)):
        folder = str(tmp_path / str(number))
        frame = spark.createDataFrame([coin(1, "a", 1, "x"), coin(2, "a", 1), coin(3, "b", 2, "x")], COINS)
        with monkeypatch.context() as broken:
            broken.setattr(KnownIds, "add", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(RuntimeError):
                tables.append_coins(frame, folder, "7")
        tables.append_coins(frame, folder, batch)
        assert [r.id for r in tables.read_table(spark, folder, "coins").orderBy("id").collect()] == [1, 2, 3]
        if batch:
            assert rows(tables.coin_counts(spark, folder), "machine_id", "n") == [("a", 2), ("b", 1)]
        assert not list((tmp_path / str(number) / "staging").iterdir())


def test_empty_appends(spark, tmp_path, run):
    tables.append_coins(run.coins().limit(0), str(tmp_path))
    tables.append_events(run.events().limit(0), str(tmp_path))
    tables.append_coins(spark.createDataFrame([coin(1, "a", 1, "x")], COINS), str(tmp_path))
    assert tables.read_table(spark, str(tmp_path), "coins").count() == 1


# ---- pages and histories -----------------------------------------------------
@pytest.fixture(scope="module")
def log(spark, tmp_path_factory, run):
    folder = str(tmp_path_factory.mktemp("log"))
    half = F.lit("2024-01-16").cast("date")
    tables.append_events(run.events().where(F.col("local_day") < half), folder, "a")
    tables.append_events(run.events().where(F.col("local_day") >= half), folder, "b")
    return folder


@pytest.mark.parametrize("page, size, pings, bounds", [
    (1, 20, False, {}), (3, 7, True, {}), (9, 25, False, {"start": "2024-01-05", "end": "2024-01-20"}),
    (2, 10, True, {"start": "2024-01-10T10:17:30", "end": "2024-01-10T19:41:00"}), (10_000, 20, False, {}),
    (1, 20, False, {"as_of": dt.datetime(2024, 1, 20, 7, 30), "range_": "7d"}), (1, 5, False, {"start": "2030-01-01"}),
])
def test_page_by_kept_counts(spark, log, page, size, pings, bounds):
    events = event_ops.filter_events(tables.read_table(spark, log, "machine_events"), include_pings=pings, **bounds)
    found, info = tables.events_page(spark, log, page, size, pings, **bounds)
    want = events.orderBy(F.col("timestamp").desc(), F.col("id").desc()).offset((page - 1) * size).limit(size)
    assert [r.id for r in found.collect()] == [r.id for r in want.collect()]
    assert info.first() == event_ops.page_info(events, page, size).first()


def test_page_counts_nothing_in_the_log(spark, log):
    """What finds the page reads kept counts alone; the page itself reads the files of a few days."""
    found, info = tables.events_page(spark, log, 2)
    days = spark.read.parquet(log + "/machine_events").select("local_day").distinct().count()
    assert days > 20 and 0 < files_read(found) <= 4
    assert all("/event_counts/" in f for f in info.inputFiles())


def test_history_skips_row_groups_of_other_machines(spark, tmp_path):
    """Rows of a day lie by machine, so one machine's history reads a part of them; Bloom filters are written."""
    machines, n = 200, 40_000
    at = F.expr("timestamp_ntz'2024-01-05 12:00:00' + make_interval(0, 0, 0, 0, 0, 0, id / 10)")
    events = spark.range(n).select(
        "id", F.concat(F.lit("m"), F.format_string("%03d", F.pmod(F.col("id") * 7919, F.lit(machines)))).alias("machine_id"),
        F.lit("machine_on").alias("type"), at.alias("timestamp"), F.create_map(F.lit("k"), F.lit("v")).alias("data"),
        F.lit("2024-01-05").cast("date").alias("local_day"))
    spark.conf.set("parquet.block.size", str(16 * 1024))
    spark.conf.set("parquet.block.size.row.check.min", "100")
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", str(16 * 1024))
    try:
        tables.append_events(events, str(tmp_path))
    finally:
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
        spark.conf.unset("parquet.block.size")
        spark.conf.unset("parquet.block.size.row.check.min")
    import pyarrow.parquet as pq

    files_ = [pq.ParquetFile(f) for f in (tmp_path / "machine_events").rglob("*.parquet")]
    groups = [f.metadata.row_group(g).column(1).statistics for f in files_ for g in range(f.num_row_groups)]
    assert len(groups) > 3 and sum(g.min <= "m123" <= g.max for g in groups) <= len(files_) + 1
    history = tables.read_table(spark, str(tmp_path), "machine_events").where("machine_id = 'm123'").select("id")
    assert len(history.collect()) == n // machines
    plan = history._jdf.queryExecution().executedPlan()
    scanned = plan.collectLeaves().head().metrics().apply("numOutputRows").value()
    assert scanned < n // 3


# ---- upserts ------------------------------------------------------------------
def test_sales_by_batches_are_the_whole_log(spark, tmp_path):
    """In any order, the later ones first."""
    views = SampleViews(spark, FOLDER)
    changes = views.sale_changes().where("sale_date < '1995-04-01'")
    for third in (1, 0, 2):
        tables.upsert_sales(changes.where(F.col("seq") % 3 == third), str(tmp_path))
    columns = S.TABLES["employee_daily_sales"].names
    assert rows(tables.read_table(spark, str(tmp_path), "employee_daily_sales"), *columns) == rows(sale_ops.upsert_daily_sales(changes), *columns)


def test_reports_by_batches_are_the_whole_log(spark, tmp_path):
    from fichaflow.plans.queries_people import report_changes

    changes = report_changes(SampleViews(spark, FOLDER)).where("week_end_date < '1995-07-01'")
    for half in (1, 0):
        tables.upsert_reports(changes.where(F.col("seq") % 2 == half), str(tmp_path))
    columns = S.TABLES["employee_weekly_reports"].names
    assert rows(tables.read_table(spark, str(tmp_path), "employee_weekly_reports"), *columns) == rows(report_ops.upsert_weekly_reports(changes), *columns)


def sale(seq, employee, day, coins):
    return (seq, employee, "m", dt.date(2024, 1, day), coins, None, None, 0, 0, dt.datetime(2024, 1, 20, 0, seq))


SALES = ("seq long, employee_id long, machine_id string, sale_date date, coins int, record_message string, prize_bs decimal(12,2), "
         "lost int, returned int, changed_at timestamp_ntz")


def test_upsert_of_one_day_rewrites_one_partition(spark, tmp_path):
    tables.upsert_sales(spark.createDataFrame([sale(1, 1, 1, 5), sale(2, 1, 2, 6), sale(3, 2, 3, 7)], SALES), str(tmp_path))
    root = tmp_path / "employee_daily_sales"
    before = {p: p.stat().st_mtime_ns for p in root.rglob("*.parquet")}
    tables.upsert_sales(spark.createDataFrame([sale(4, 1, 2, 9), sale(5, 3, 2, 1)], SALES), str(tmp_path))
    after = {p: p.stat().st_mtime_ns for p in root.rglob("*.parquet")}
    assert {p.parent.name for p in before.keys() ^ after.keys()} == {"sale_date=2024-01-02"}
    assert all(after[p] == before[p] for p in before.keys() & after.keys())
    got = rows(tables.read_table(spark, str(tmp_path), "employee_daily_sales"), "id", "employee_id", "coins")
    assert got == [(1, 1, 5), (2, 1, 9), (3, 2, 7), (5, 3, 1)]


def test_failure_before_the_swap_keeps_the_table(spark, tmp_path, monkeypatch):
    first = spark.createDataFrame([sale(1, 1, 1, 5)], SALES)
    tables.upsert_sales(first, str(tmp_path))
    second = spark.createDataFrame([sale(2, 1, 1, 8)], SALES)
    with monkeypatch.context() as broken:
        broken.setattr(tables, "swap_days", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            tables.upsert_sales(second, str(tmp_path))
    table = lambda: rows(tables.read_table(spark, str(tmp_path), "employee_daily_sales"), "id", "coins")
    assert table() == [(1, 5)]
    tables.upsert_sales(second, str(tmp_path))
    assert table() == [(1, 8)]


def test_replaced_table_survives_a_failure(spark, tmp_path, monkeypatch):
    machines = SampleViews(spark, FOLDER).machines()
    folder, n = str(tmp_path), machines.count()
    tables.write_table(machines, folder, "machines")
    broken = machines.withColumn("name", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        tables.write_table(broken, folder, "machines")
    assert tables.read_table(spark, folder, "machines").count() == n
    # rows read from the table itself
    tables.write_table(tables.read_table(spark, folder, "machines").where("id <> 'x'").limit(3), folder, "machines")
    assert tables.read_table(spark, folder, "machines").count() == 3
    # stopped between the two renames of a swap
    files._rename(spark, folder + "/machines", folder + "/machines.old")
    assert tables.read_table(spark, folder, "machines").count() == 3


def test_the_first_upsert_stages_its_changes_only(spark, tmp_path, monkeypatch):
    """Nothing stored is read, so the merged days go to the table at once; later ones are finished beside it."""
    staged, names = files.staged, []
    monkeypatch.setattr(files, "staged", lambda rows, folder, name, *by: names.append(name) or staged(rows, folder, name, *by))
    change = lambda seq, coins: (seq, 1, "m", dt.date(2024, 1, 5), coins, None, None, 0, 0, None, dt.datetime(2024, 1, 5, seq))
    changes = "seq long, employee_id long, machine_id string, sale_date date, coins int, record_message string, prize_bs decimal(12,2), lost int, returned int, entry_coins int, changed_at timestamp_ntz"
    for batch in ([change(2, 20), change(3, 30), change(3, 30)], [change(1, 10), change(4, 40)]):
        tables.upsert_sales(spark.createDataFrame(batch, changes), str(tmp_path), "month")
    name = "employee_daily_sales"
    assert names == [f"{name}-changes", f"{name}-changes", name]
    assert rows(tables.read_table(spark, str(tmp_path), name), "id", "coins") == [(1, 40)]
