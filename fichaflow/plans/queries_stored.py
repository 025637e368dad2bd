"""Queries that go through stored tables and the keyed stream: written in batches, read back, compared with the same SQL.

Each run has a new folder under the shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from fichaflow.operators import blocks, coins as coin_ops, events as event_ops
from fichaflow.operators.machine_state import Heartbeat
from fichaflow.plans import oracles as O
from fichaflow.plans.queries_devices import AS_OF_SQL, HISTORY, MACHINE, sql
from fichaflow.plans.queries_people import REPORTS, SALES, report_changes, sql as people_sql
from fichaflow.plans.registration import SIX_HOURS_MS, query, replayed
from fichaflow.sources import tables
from fichaflow.sources.known_ids import KnownIds
from fichaflow.sources.tables import read_device_events
from fichaflow.streaming.keyed import KeyedIngestJob, keyed_session, machine_states

#: Least partitions of keyed state; their number is fixed for the life of a stream.
STATE_PARTITIONS = 8
#: Least files of the message stream, all of one micro-batch.
STREAM_FILES = 3
MIDDLE = "2024-01-16"


def folder_of(spark: SparkSession) -> str:
    blocks.ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/stored-{uuid.uuid4().hex}"


def halves(rows: DataFrame) -> list[DataFrame]:
    day = F.lit(MIDDLE).cast("date")
    return [rows.where(F.col("local_day") < day), rows.where(F.col("local_day") >= day)]


def stored_ledger(v) -> str:
    """The ledger appended by halves, the second one twice."""
    folder, coins = folder_of(v.spark), replayed(v).kept().coins()
    first, second = halves(coins)
    for rows, batch in ((first, "1"), (second, "2"), (second, "3")):
        tables.append_coins(rows, folder, batch)
    return folder


def stored_log(v) -> str:
    folder, events = folder_of(v.spark), replayed(v).kept().events()
    for batch, rows in enumerate(halves(events)):
        tables.append_events(rows, folder, str(batch))
    return folder


@query("stored_ledger", sql("SELECT id, machine_id, timestamp, event_id, unique_id, local_day FROM coins"))
def _(v):
    return tables.read_table(v.spark, stored_ledger(v), "coins")


@query("daily_income_by_counts", sql("SELECT machine_id, local_day AS date, count(*) AS income FROM coins GROUP BY ALL"))
def _(v):
    return coin_ops.daily_income(tables.coin_counts(v.spark, stored_ledger(v)))


@query("known_coin_ids", sql(f"""
SELECT DISTINCT machine_id, uid FROM judged j WHERE uid IS NOT NULL AND rcv >= TIMESTAMP '{MIDDLE} 00:00:00' AND EXISTS (
  SELECT 1 FROM judged e WHERE e.machine_id = j.machine_id AND e.uid = j.uid AND e.rcv < TIMESTAMP '{MIDDLE} 00:00:00')"""))
def _(v):
    """Ids of the second half that the first half had."""
    coins = replayed(v, with_coins=False).states.where("event = 'coin_inserted'").select("machine_id", "uid", "received_at")
    early = F.col("received_at") < F.lit(f"{MIDDLE} 00:00:00").cast("timestamp_ntz")
    index = KnownIds(v.spark, folder_of(v.spark))
    index.add(coins.where(early), "1")
    return index.known(coins.where(~early))


@query("events_page_by_counts", sql(f"""
SELECT id, machine_id, type, timestamp FROM log WHERE type <> 'ping' AND timestamp >= {AS_OF_SQL} - INTERVAL 7 DAY
ORDER BY timestamp DESC, id DESC LIMIT 20 OFFSET 40"""))
def _(v):
    import datetime as dt

    page, _ = tables.events_page(v.spark, stored_log(v), 3, as_of=dt.datetime(2024, 1, 31), range_="7d")
    return page.select("id", "machine_id", "type", "timestamp")


@query("machine_history_stored", sql(HISTORY + f" AND machine_id = '{MACHINE}' AND {O.day('timestamp')} >= DATE '2024-01-05'"))
def _(v):
    log, ledger = stored_log(v), stored_ledger(v)
    events, coins = tables.read_table(v.spark, log, "machine_events"), tables.read_table(v.spark, ledger, "coins")
    return event_ops.machine_history(events, coins, MACHINE, "2024-01-05").select("id", "machine_id", "type", "timestamp")


@query("daily_sales_upserted", people_sql("SELECT * REPLACE (CAST(prize_bs AS DOUBLE) AS prize_bs) FROM sales", SALES))
def _(v):
    """Changes in two batches, the later ones of each key first."""
    folder, changes = folder_of(v.spark), v.sale_changes()
    for odd in (1, 0):
        tables.upsert_sales(changes.where(F.col("seq") % 2 == odd), folder, "month")
    return tables.read_table(v.spark, folder, "employee_daily_sales")


@query("weekly_reports_upserted", people_sql("SELECT * FROM weekly", REPORTS))
def _(v):
    folder, changes = folder_of(v.spark), blocks.checkpoint(report_changes(v))
    for odd in (1, 0):
        tables.upsert_reports(changes.where(F.col("seq") % 2 == odd), folder, "month")
    return tables.read_table(v.spark, folder, "employee_weekly_reports")


# ---- keyed stream ---------------------------------------------------------------
def keyed_run(v) -> tuple[KeyedIngestJob, str]:
    """All messages as a stream of files, in arrival order; the last message of all moves no timer of its own.

    Files and state partitions are as many as the cluster has cores, so no step leaves some of them idle.
    """
    folder, cores = folder_of(v.spark), v.spark.sparkContext.defaultParallelism
    files, partitions = max(STREAM_FILES, cores), max(STATE_PARTITIONS, cores)
    v.device_messages().repartitionByRange(files, "seq").sortWithinPartitions("seq").write.json(folder + "/messages")
    before = {k: v.spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass")}
    v.spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    job = KeyedIngestJob(keyed_session(v.spark), folder, v.machines(), Heartbeat(SIX_HOURS_MS), SIX_HOURS_MS)
    try:
        source = read_device_events(v.spark, folder + "/messages", streaming=True, max_files=files)
        job.start(source, folder + "/state", availableNow=True).awaitTermination()
    finally:
        for key, value in before.items():
            v.spark.conf.unset(key) if value is None else v.spark.conf.set(key, value)
    return job, folder + "/state"


@query("keyed_audit", sql("""
SELECT seq, machine_id, disposition FROM states
UNION ALL SELECT seq, CASE WHEN NOT nameless THEN machine_id END,
  CASE WHEN nameless THEN 'missing_field' ELSE 'unknown_machine' END FROM raw
WHERE nameless OR machine_id NOT IN (SELECT id FROM machines)"""))
def _(v):
    """State, coin chain, known ids and rejects of the stream, by what became of each message."""
    return keyed_run(v)[0].read("ingest_audit").select("seq", "machine_id", "disposition")


@query("keyed_states", sql("""
SELECT machine_id AS id, last_ping, last_seq, CASE WHEN status = 'active' AND last_ping + INTERVAL 6 HOUR < (SELECT max(rcv) FROM raw)
  THEN 'inactive' ELSE status END AS status FROM final"""))
def _(v):
    """Machines as the stream's timers left them: silent ones are off, as of the last message of all."""
    _, checkpoint = keyed_run(v)
    return machine_states(v.spark, checkpoint).select("id", "last_ping", "last_seq", "status")
