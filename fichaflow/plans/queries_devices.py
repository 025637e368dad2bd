"""Queries over messages, machines, the event log and the coin ledger."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from fichaflow.functions.times import device_time, lower_day, upper_day
from fichaflow.operators import alerts as alert_ops
from fichaflow.operators import coin_dedup, coins as coin_ops, events as event_ops, ingest, machines as machine_ops
from fichaflow.operators.machine_state import last_heartbeat
from fichaflow.plans import oracles as O
from fichaflow.plans.registration import AS_OF, as_of, query, replayed

AS_OF_PY = dt.datetime.fromisoformat(AS_OF)
AS_OF_SQL = f"TIMESTAMP '{AS_OF}'"
MACHINE = "Maquina_Boxeo_03"


def sql(body, **kw):
    return O.over(body, replay=True, **kw)


# ---- sources and normalisation ----------------------------------------------
@query("disposition_counts", sql("""
SELECT disposition, count(*) AS n FROM (
  SELECT disposition FROM states
  UNION ALL SELECT CASE WHEN nameless THEN 'missing_field' ELSE 'unknown_machine' END FROM raw
  WHERE nameless OR machine_id NOT IN (SELECT id FROM machines)) GROUP BY ALL"""))
def _(v):
    return replayed(v).audit().groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))


@query("ingest_audit", sql("""
SELECT seq, machine_id, disposition FROM states
UNION ALL SELECT seq, CASE WHEN NOT nameless THEN machine_id END,
  CASE WHEN nameless THEN 'missing_field' ELSE 'unknown_machine' END FROM raw
WHERE nameless OR machine_id NOT IN (SELECT id FROM machines)"""))
def _(v):
    return replayed(v).audit()


@query("required_fields", O.over(
    "SELECT seq, CASE WHEN NOT nameless THEN machine_id END AS machine_id, NOT nameless AS complete FROM raw"))
def _(v):
    m = ingest.merge_aliases(v.device_messages())
    return m.select("seq", "machine_id", (F.col("machine_id").isNotNull() & F.col("raw_event").isNotNull()).alias("complete"))


@query("known_messages", O.over(
    "SELECT seq, machine_id, ev AS event, uid, ts, test_mode FROM msgs"))
def _(v):
    n = ingest.accepted(ingest.normalise(v.device_messages(), v.machines()))
    return n.select("seq", "machine_id", "event", "uid", "ts", "test_mode")


@query("unknown_machines", O.over("""
SELECT machine_id, count(*) AS messages FROM raw
WHERE NOT nameless AND machine_id NOT IN (SELECT id FROM machines) GROUP BY ALL"""))
def _(v):
    n = ingest.normalise(v.device_messages(), v.machines())
    return n.where(F.col("reject") == ingest.UNKNOWN_MACHINE).groupBy("machine_id").agg(F.count(F.lit(1)).alias("messages"))


@query("event_vocabulary", O.over(
    "SELECT event_type, ev AS event, count(*) AS n FROM raw GROUP BY ALL"))
def _(v):
    m = ingest.merge_aliases(v.device_messages()).select("seq", ingest.map_event(F.col("raw_event")).alias("event"))
    kinds = v.table("events").select(F.col("event_id").alias("seq"), "event_type")
    return m.join(kinds, "seq").groupBy("event_type", "event").agg(F.count(F.lit(1)).alias("n"))


@query("merged_payload", O.over("""
SELECT seq, CASE WHEN ev = 'coin_inserted' AND seq % 5 = 0 THEN NULL ELSE value END AS cantidad,
  CASE WHEN ev = 'game_end' THEN value END AS score FROM raw"""))
def _(v):
    m = v.device_messages().select("seq", ingest.payload(F.col("data"), F.col("cantidad")).alias("p"))
    get = lambda k: F.element_at("p", k).try_cast("double")
    return m.select("seq", get("cantidad").alias("cantidad"), get("score").alias("score"))


@query("device_times", O.over("""
SELECT seq, CASE seq % 4 WHEN 1 THEN rcv WHEN 2 THEN date_trunc('second', told) ELSE told END AS ts FROM raw"""))
def _(v):
    m = v.device_messages()
    received = F.date_trunc("millisecond", "received_at").cast("timestamp_ntz")
    return m.select("seq", device_time(F.col("timestamp"), received).alias("ts"))


@query("logged_payload", sql("""
SELECT id, type, reason, CASE WHEN test THEN 'true' END AS test, cantidad, uid FROM log"""))
def _(v):
    e = replayed(v).events()
    get = lambda k: F.element_at("data", k)
    return e.select("id", "type", get("reason").alias("reason"), get("test").alias("test"),
                    get("cantidad").try_cast("double").alias("cantidad"), get("id_unico").alias("uid"))


# ---- state ------------------------------------------------------------------
STATES_SQL = "SELECT seq, machine_id, event, status_before, status_after, auto_on, off_at FROM states"


def _states(v, **kw):
    return replayed(v, with_coins=False, **kw).states.select(
        "seq", "machine_id", "event", "status_before", "status_after", "auto_on", "off_at"
    )


@query("machine_states", sql(STATES_SQL))
def _(v):
    return _states(v)


@query("machine_states_ticks", sql(STATES_SQL, tick="3600000000"))
def _(v):
    return _states(v, mode="tick")


@query("machine_states_in_blocks", sql(STATES_SQL))
def _(v):
    """The same scan with every busy machine cut into small blocks."""
    return _states(v, block_rows=50)


@query("repeated_on", sql("SELECT machine_id, count(*) AS n FROM states WHERE suppressed_on GROUP BY ALL"))
def _(v):
    s = replayed(v, with_coins=False).states
    return s.where("suppressed_on").groupBy("machine_id").agg(F.count(F.lit(1)).alias("n"))


@query("auto_power_on", sql("SELECT id, machine_id, timestamp FROM log WHERE origin = 'auto_on'"))
def _(v):
    return replayed(v, with_coins=False).events().where("origin = 'auto_on'").select("id", "machine_id", "timestamp")


@query("heartbeat_timeouts", sql("SELECT id, machine_id, timestamp FROM log WHERE origin = 'timeout'"))
def _(v):
    return replayed(v, with_coins=False).events().where("origin = 'timeout'").select("id", "machine_id", "timestamp")


@query("last_heartbeat", O.over("SELECT machine_id, max(rcv) AS last_ping FROM msgs GROUP BY ALL"))
def _(v):
    return last_heartbeat(ingest.accepted(ingest.normalise(v.device_messages(), v.machines())))


@query("machine_snapshot", sql("""
SELECT machine_id AS id, name, location, type, last_ping, CASE WHEN off_at IS NOT NULL THEN 'inactive'
  ELSE status END AS status FROM final"""))
def _(v):
    return replayed(v, with_coins=False).snapshot().select("id", "name", "location", "type", "last_ping", "status")


@query("late_messages_turned_away", O.over("""
SELECT seq, machine_id, 'late' AS disposition FROM msgs WHERE rcv - ts > INTERVAL 1 HOUR"""))
def _(v):
    n = ingest.normalise(v.device_messages(), v.machines(), max_delay_ms=3600 * 1000)
    return ingest.rejected(n).where(F.col("disposition") == ingest.LATE)


@query("late_messages", O.over("""
SELECT machine_id, count(*) AS messages, sum(CASE WHEN rcv - ts > INTERVAL 1 HOUR THEN 1 ELSE 0 END) AS late
FROM msgs GROUP BY ALL"""))
def _(v):
    n = ingest.accepted(ingest.normalise(v.device_messages(), v.machines()))
    late = F.count_if(F.col("received_at") - F.col("ts") > F.make_dt_interval(F.lit(0), F.lit(1)))
    return n.groupBy("machine_id").agg(F.count(F.lit(1)).alias("messages"), late.alias("late"))


# ---- coins ------------------------------------------------------------------
COINS_SQL = """SELECT seq, machine_id, uid, CASE WHEN disposition IN ('duplicate', 'rate_limit') THEN disposition
  ELSE 'accepted' END AS verdict FROM states WHERE ev = 'coin_inserted'"""


@query("coin_verdicts", sql(COINS_SQL))
def _(v):
    return replayed(v).coin_outcomes().select("seq", "machine_id", "uid", "verdict")


@query("coin_verdicts_in_blocks", sql(COINS_SQL))
def _(v):
    return replayed(v, block_rows=40).coin_outcomes().select("seq", "machine_id", "uid", "verdict")


@query("coin_id_duplicates", O.over("""
SELECT machine_id, uid, count(*) - 1 AS repeats FROM msgs WHERE uid IS NOT NULL GROUP BY ALL HAVING count(*) > 1"""))
def _(v):
    n = ingest.accepted(ingest.normalise(v.device_messages(), v.machines())).where("event = 'coin_inserted'")
    marked = coin_dedup.mark_id_duplicates(n).where("duplicate")
    return marked.groupBy("machine_id", "uid").agg(F.count(F.lit(1)).alias("repeats"))


@query("coin_admission", sql("""
SELECT seq, machine_id, disposition FROM states WHERE ev = 'coin_inserted'"""))
def _(v):
    return replayed(v).coin_outcomes().select("seq", "machine_id", "disposition")


@query("coin_ledger", sql("SELECT id, machine_id, timestamp, event_id, unique_id, local_day FROM coins"))
def _(v):
    return replayed(v).coins()


APPEND_SQL = sql("""
SELECT id, machine_id, unique_id FROM coins c WHERE timestamp >= TIMESTAMP '2024-01-16 00:00:00' AND (unique_id IS NULL
  OR NOT EXISTS (SELECT 1 FROM coins o WHERE o.machine_id = c.machine_id AND o.unique_id = c.unique_id
                 AND o.timestamp < TIMESTAMP '2024-01-16 00:00:00'))""")


def _halves(v):
    coins = replayed(v).kept().coins()
    half = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    return coins.where(F.col("timestamp") < half), coins.where(F.col("timestamp") >= half)


@query("ledger_append", APPEND_SQL)
def _(v):
    """Second half of the month appended to the first half's ledger."""
    first, second = _halves(v)
    return coin_dedup.new_ledger_rows(second, first).select("id", "machine_id", "unique_id")


@query("ledger_append_twice", APPEND_SQL)
def _(v):
    """The same half appended twice: the second run finds all of its coins in the ledger."""
    first, second = _halves(v)
    once = coin_dedup.new_ledger_rows(second, first)
    twice = coin_dedup.new_ledger_rows(second, first.unionByName(once))
    return once.unionByName(twice).select("id", "machine_id", "unique_id")


@query("coins_by_machine", sql("SELECT machine_id, count(*) AS total_coins FROM coins GROUP BY ALL"))
def _(v):
    return coin_ops.coins_by_machine(replayed(v).coins())


@query("total_coins", sql("SELECT count(*) AS total_coins FROM coins"))
def _(v):
    return coin_ops.total_coins(replayed(v).coins())


@query("daily_income_of_month", sql("""
SELECT machine_id, local_day AS date, count(*) AS income FROM coins
WHERE local_day BETWEEN DATE '2024-01-10' AND DATE '2024-01-31' GROUP BY ALL"""))
def _(v):
    """From a day to the end of the month."""
    return coin_ops.daily_income(replayed(v).coins(), start="2024-01-10", end="2024-01")


@query("income_bounds", O.over("""
SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start,
  last_day(o_orderdate) AS month_end, CAST(o_orderdate AS DATE) AS day, NULL AS unreadable FROM orders"""
  .replace("NULL AS unreadable", "CAST(NULL AS DATE) AS unreadable"), extra="unused AS (SELECT 1)"))
def _(v):
    o = v.table("orders")
    month, ymd = F.date_format("o_orderdate", "yyyy-MM"), F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select("o_orderkey", lower_day(month).alias("month_start"), upper_day(month).alias("month_end"),
                    upper_day(ymd).alias("day"), lower_day(F.date_format("o_orderdate", "d/M/yyyy")).alias("unreadable"))


VALUES = """
values_now AS (
  SELECT type, value, updated_at FROM (
    SELECT o_orderkey AS seq, CASE o_orderkey % 4 WHEN 0 THEN 'boxeo' WHEN 1 THEN 'agilidad' WHEN 2 THEN lower(o_orderpriority) ELSE '' END AS type,
      CASE WHEN o_orderkey % 13 <> 0 THEN CAST((CAST(round(o_totalprice * 100) AS BIGINT) % 1000 - 50) / 100 AS DECIMAL(12, 2)) END AS value,
      o_orderdate AS updated_at FROM orders)
  WHERE type <> '' AND value > 0
  QUALIFY row_number() OVER (PARTITION BY type ORDER BY seq DESC) = 1),"""


@query("coin_value_upsert", O.over(
    "SELECT type, CAST(value AS DOUBLE) AS value, updated_at FROM values_now", extra=VALUES))
def _(v):
    return coin_ops.coin_value_upsert(v.coin_value_changes())


@query("coin_value_map", O.over(
    "SELECT string_agg(type || '=' || printf('%.2f', CAST(value AS DOUBLE)), ',' ORDER BY type) AS coin_values FROM values_now",
    extra=VALUES))
def _(v):
    m = coin_ops.coin_value_map(coin_ops.coin_value_upsert(v.coin_value_changes()))
    text = F.transform(F.map_entries("coin_values"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.2f", e["value"])))
    return m.select(F.array_join(text, ",").alias("coin_values"))


@query("coin_revenue", sql("""
SELECT c.machine_id, m.type, c.n AS total_coins, CAST(c.n * coalesce(v.value, 2) AS DOUBLE) AS revenue
FROM (SELECT machine_id, count(*) AS n FROM coins GROUP BY ALL) c JOIN machines m ON m.id = c.machine_id
LEFT JOIN values_now v ON v.type = m.type""", extra=VALUES))
def _(v):
    return coin_ops.coin_revenue(replayed(v).coins(), v.machines(), coin_ops.coin_value_upsert(v.coin_value_changes()))


# ---- event log --------------------------------------------------------------
def log(v):
    return replayed(v).events()


def kept_log(v):
    return replayed(v).kept().events()


@query("events_in_range", sql(f"""
SELECT id, machine_id, type, timestamp FROM log WHERE type <> 'ping' AND timestamp >= {AS_OF_SQL} - INTERVAL 7 DAY
  AND timestamp >= TIMESTAMP '2024-01-20 04:00:00' AND timestamp <= TIMESTAMP '2024-01-29 04:00:00.999'"""))
def _(v):
    rows = event_ops.filter_events(log(v), AS_OF_PY, "7d", "2024-01-20", "2024-01-28")
    return rows.select("id", "machine_id", "type", "timestamp")


@query("events_without_pings", sql("SELECT type, count(*) AS n FROM log WHERE type <> 'ping' GROUP BY ALL"))
def _(v):
    return event_ops.exclude_pings(log(v)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("events_page", sql("""
SELECT id, machine_id, type, timestamp FROM log WHERE type <> 'ping' ORDER BY timestamp DESC, id DESC LIMIT 20 OFFSET 40"""))
def _(v):
    return event_ops.page_events(event_ops.filter_events(kept_log(v)), 3).select("id", "machine_id", "type", "timestamp")


@query("events_page_deep", sql("""
SELECT id, machine_id, type, timestamp FROM log WHERE type <> 'ping' ORDER BY timestamp DESC, id DESC LIMIT 20 OFFSET 400"""))
def _(v):
    return event_ops.page_events(event_ops.filter_events(kept_log(v)), 21).select("id", "machine_id", "type", "timestamp")


@query("events_page_info", sql("""
SELECT count(*) AS total, 3 AS page, 20 AS page_size, greatest(1, CAST(ceil(count(*) / 20) AS BIGINT)) AS total_pages
FROM log WHERE type <> 'ping'"""))
def _(v):
    return event_ops.page_info(event_ops.filter_events(log(v)), 3)


@query("machine_liveness", sql("""
SELECT machine_id AS id, name, CASE WHEN off_at IS NOT NULL THEN 'inactive' ELSE status END AS status,
  last_ping AS "lastPing", coalesce(TIMESTAMP '2024-01-31 00:00:00' - last_ping < INTERVAL 6 HOUR, false) AS connected FROM final"""))
def _(v):
    return event_ops.liveness(replayed(v, with_coins=False).snapshot(), as_of(), 6 * 3600 * 1000)


LAST_POWER = """SELECT m.id, m.name, m.location, m.type, m.test_mode,
  max(CASE WHEN l.type = 'machine_on' THEN l.timestamp END) AS last_on,
  max(CASE WHEN l.type = 'machine_off' THEN l.timestamp END) AS last_off
FROM machines m LEFT JOIN log l ON l.machine_id = m.id {where} GROUP BY ALL"""


def power_log(v):
    return replayed(v, with_coins=False).events()


@query("machines_last_power", sql(LAST_POWER.format(where="")))
def _(v):
    return event_ops.machines_with_last_power(v.machines(), power_log(v)).drop("status", "last_ping")


@query("machine_by_id", sql(LAST_POWER.format(where=f"WHERE m.id = '{MACHINE}'")))
def _(v):
    return event_ops.machine_by_id(v.machines(), power_log(v), MACHINE).drop("status", "last_ping")


SESSIONS = """
SELECT machine_id, id, CASE WHEN type = 'machine_on' THEN 'Encendido' ELSE 'Apagado' END AS event, timestamp AS ts,
  CASE WHEN type = 'machine_on' AND lead(type) OVER w = 'machine_off' AND lead(timestamp) OVER w > timestamp
    THEN CAST(floor(epoch_us(lead(timestamp) OVER w) / 60000000 - epoch_us(timestamp) / 60000000 + 0.5) AS BIGINT) END AS dur
FROM log WHERE type IN ('machine_on', 'machine_off') {where}
WINDOW w AS (PARTITION BY machine_id ORDER BY timestamp, id)"""
SESSIONS_US = SESSIONS.replace(
    "floor(epoch_us(lead(timestamp) OVER w) / 60000000 - epoch_us(timestamp) / 60000000 + 0.5)",
    "floor((epoch_us(lead(timestamp) OVER w) - epoch_us(timestamp)) / 60000000.0 + 0.5)")


@query("power_sessions", sql(SESSIONS_US.format(where="")))
def _(v):
    r = replayed(v, with_coins=False)
    return event_ops.power_sessions(r.events(), hot=r.hot)


@query("power_sessions_in_blocks", sql(SESSIONS_US.format(where="")))
def _(v):
    """The same pairing with every busy machine cut into small blocks."""
    r = replayed(v, with_coins=False, block_rows=30)
    return event_ops.power_sessions(r.events(), hot=r.hot)


@query("power_sessions_in_days", sql(SESSIONS_US.format(
    where=f"AND {O.day('timestamp')} BETWEEN DATE '2024-01-10' AND DATE '2024-01-15'")))
def _(v):
    r = replayed(v, with_coins=False)
    return event_ops.power_sessions(r.events(), start="2024-01-10", end="2024-01-15", hot=r.hot)


HISTORY = "SELECT id, machine_id, type, timestamp FROM log l WHERE (type <> 'coin_inserted' OR EXISTS (SELECT 1 FROM coins c WHERE c.event_id = l.id))"


@query("machine_history", sql(HISTORY + f" AND machine_id = '{MACHINE}' AND {O.day('timestamp')} >= DATE '2024-01-05'"))
def _(v):
    r = replayed(v).kept()
    return event_ops.machine_history(r.events(), r.coins(), MACHINE, "2024-01-05").select("id", "machine_id", "type", "timestamp")


@query("all_machine_history", sql(HISTORY))
def _(v):
    r = replayed(v).kept()
    return event_ops.machine_history(r.events(), r.coins()).select("id", "machine_id", "type", "timestamp")


STATS = """
SELECT m.id AS machine_id, (SELECT count(*) FROM coins c WHERE c.machine_id = m.id) AS "totalIncome",
  coalesce(CAST(sum(CASE WHEN l.type = 'game_end' THEN CAST(round(l.score * 100) AS BIGINT) END) AS DOUBLE) / 100, 0) AS "totalScore",
  count(CASE WHEN l.type = 'game_start' THEN 1 END) AS "activeSessions",
  CASE WHEN count(l.id) > 0 THEN 45.5::DOUBLE ELSE 0 END AS "usageRate"
FROM machines m LEFT JOIN log l ON l.machine_id = m.id AND {keep} GROUP BY m.id"""


@query("machine_stats", sql(STATS.format(keep="NOT CASE WHEN l.test THEN true END")))
def _(v):
    r = replayed(v).kept()
    return event_ops.machine_stats(v.machines(), r.events(), r.coins())


@query("machine_stats_untested", sql(STATS.format(keep="NOT l.test")))
def _(v):
    r = replayed(v).kept()
    return event_ops.machine_stats(v.machines(), r.events(), r.coins(), faithful=False)


@query("events_per_local_day", sql(f"SELECT {O.day('timestamp')} AS local_day, type, count(*) AS n FROM log GROUP BY ALL"))
def _(v):
    return log(v).groupBy("local_day", "type").agg(F.count(F.lit(1)).alias("n"))


# ---- registry ---------------------------------------------------------------
GIVEN = f"""
batch AS (
  SELECT p_partkey AS seq, p_name, p_brand, CASE WHEN p_partkey % 101 = 5 THEN {O.mid('p_partkey')} END AS given,
    CASE WHEN p_partkey % 3 = 0 THEN 'Boxeo' WHEN p_partkey % 3 = 1 THEN 'agilidad' END AS label,
    CASE WHEN p_partkey % 2 = 0 THEN 'Boxeo ' || p_name ELSE p_name END AS name,
    CASE WHEN p_partkey % 4 = 0 THEN p_brand END AS place FROM part),"""


def _batch(v):
    from fichaflow.sources.sample_views import machine_id

    key = F.col("p_partkey")
    return v.table("part").select(
        key.alias("seq"), F.when(key % 101 == 5, machine_id(key)).alias("id"),
        F.when(key % 3 == 0, "Boxeo").when(key % 3 == 1, "agilidad").alias("type"),
        F.when(key % 2 == 0, F.concat(F.lit("Boxeo "), F.col("p_name"))).otherwise(F.col("p_name")).alias("name"),
        F.when(key % 4 == 0, F.col("p_brand")).alias("location"),
    )


NUMBERED = GIVEN + """
keyed AS (
  SELECT *, CASE WHEN given IS NOT NULL THEN regexp_extract(given, '^Maquina_(Boxeo|Agilidad)_', 0)
    WHEN coalesce(label = 'Boxeo', starts_with(name, 'Boxeo')) THEN 'Maquina_Boxeo_' ELSE 'Maquina_Agilidad_' END AS prefix,
    TRY_CAST(regexp_extract(given, '_(\\d+)$', 1) AS BIGINT) AS e FROM batch),
counted AS (
  SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY seq) AS rn FROM keyed),
top AS (
  SELECT p.prefix, coalesce(max(CAST(regexp_extract(m.id, '_(\\d+)$', 1) AS BIGINT)), 0) AS top
  FROM (SELECT DISTINCT prefix FROM keyed WHERE prefix <> '') p
  LEFT JOIN (SELECT id FROM machines WHERE id LIKE 'Maquina%') m ON starts_with(m.id, p.prefix) GROUP BY ALL),
walk AS (
  SELECT prefix, CAST(0 AS BIGINT) AS rn, top AS n FROM top
  UNION ALL
  SELECT c.prefix, c.rn, CASE WHEN c.given IS NULL THEN w.n + 1 ELSE greatest(w.n, c.e) END
  FROM walk w JOIN counted c ON c.prefix = w.prefix AND c.rn = w.rn + 1),
numbered AS (
  SELECT c.seq, coalesce(c.given, c.prefix || CASE WHEN w.n < 10 THEN '0' ELSE '' END || CAST(w.n AS VARCHAR)) AS id,
    c.name, c.label, c.place FROM counted c LEFT JOIN walk w ON w.prefix = c.prefix AND w.rn = c.rn),"""
NUMBERED_SQL = O.over("SELECT seq, id FROM numbered /* machines */", extra=NUMBERED)


@query("sequential_ids", NUMBERED_SQL)
def _(v):
    return machine_ops.assign_sequential_ids(_batch(v), v.machines()).select("seq", "id")


@query("sequential_ids_in_blocks", NUMBERED_SQL)
def _(v):
    return machine_ops.assign_sequential_ids(_batch(v), v.machines(), block_rows=100).select("seq", "id")


@query("new_machines", O.over("""
SELECT id, name, 'inactive' AS status, coalesce(place, 'Unknown') AS location, false AS test_mode,
  CASE WHEN label = 'Boxeo' THEN 'boxeo' WHEN label = 'agilidad' THEN 'agilidad' WHEN id LIKE 'Maquina_Boxeo%' THEN 'boxeo'
    WHEN id LIKE 'Maquina_Agi%' THEN 'agilidad' ELSE 'default' END AS type FROM numbered /* machines */""", extra=NUMBERED))
def _(v):
    return machine_ops.new_machines(_batch(v), v.machines(), as_of()).drop("last_ping")


@query("machine_types", O.over("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'boxeo' WHEN 1 THEN 'agilidad' WHEN 2 THEN 'default' WHEN 3 THEN
    CASE p_partkey % 3 WHEN 0 THEN 'boxeo' WHEN 1 THEN 'agilidad' ELSE 'default' END ELSE 'default' END AS faithful,
  CASE p_partkey % 5 WHEN 0 THEN 'boxeo' WHEN 1 THEN 'agilidad' WHEN 2 THEN 'default' WHEN 3 THEN
    CASE p_partkey % 3 WHEN 0 THEN 'boxeo' WHEN 1 THEN 'agilidad' ELSE 'boxeo' END ELSE 'boxeo' END AS lenient
FROM part""", extra="unused AS (SELECT 1)"))
def _(v):
    from fichaflow.functions.machine_types import classify
    from fichaflow.sources.sample_views import machine_id

    key = F.col("p_partkey")
    label = F.when(key % 5 == 0, " BOXing").when(key % 5 == 1, "Agi").when(key % 5 == 2, "otra").otherwise("  ")
    mid = F.when(key % 5 == 3, machine_id(key)).otherwise(F.lit("M-1"))
    name = F.concat(F.lit("Gran BOXEO "), F.col("p_name"))
    return v.table("part").select("p_partkey", classify(label, mid, name).alias("faithful"),
                                  classify(label, mid, name, faithful=False).alias("lenient"))


@query("backfilled_types", O.over("""
SELECT id, CASE WHEN s % 4 = 0 THEN 'vieja' WHEN s % 3 = 0 THEN 'boxeo' WHEN s % 3 = 1 THEN 'agilidad'
  WHEN s % 2 = 0 THEN 'agilidad' ELSE 'default' END AS type
FROM (SELECT id, CAST(regexp_extract(name, '(\\d+)$', 1) AS BIGINT) AS s FROM machines)"""))
def _(v):
    m = v.machines()
    s = F.regexp_extract("name", r"(\d+)$", 1).cast("long")
    m = m.withColumn("type", F.when(s % 4 == 0, "vieja").when(s % 4 == 1, " ")).withColumn("id0", F.col("id"))
    m = m.withColumns({"id": F.lower("id"), "name": F.when(s % 2 == 0, "La AGILIDAD").otherwise(F.col("name"))})
    return machine_ops.backfill_machine_type(m).select(F.col("id0").alias("id"), "type")


CHANGES = """
changes AS (
  SELECT m.*, s AS seq, CASE WHEN s % 3 = 1 THEN 'Otra ' || m.name WHEN s % 17 = 0 THEN 'Boxeo ' || m.name END AS new_name,
    CASE WHEN s % 4 = 0 THEN 'Sala' END AS new_location, CASE WHEN s % 5 = 0 THEN 'maintenance' END AS new_status,
    CASE WHEN s % 7 = 0 THEN 'Boxeo' WHEN s % 7 = 1 THEN 'agilidad' WHEN s % 7 = 2 THEN 'otra' END AS new_type,
    CASE WHEN s % 6 = 0 THEN s % 12 = 0 END AS new_test_mode,
    CASE WHEN starts_with(m.id, 'Maquina_Boxeo_') THEN 'Boxeo' ELSE 'Agilidad' END AS old_group
  FROM (SELECT *, CAST(regexp_extract(name, '(\\d+)$', 1) AS BIGINT) AS s FROM machines) m),
planned AS (
  SELECT *, CASE WHEN new_type IS NOT NULL THEN CASE WHEN new_type = 'Boxeo' THEN 'Boxeo' ELSE 'Agilidad' END
      WHEN new_name IS NOT NULL THEN CASE WHEN lower(new_name) LIKE '%boxeo%' THEN 'Boxeo' ELSE 'Agilidad' END ELSE old_group END AS new_group,
    CASE new_type WHEN 'Boxeo' THEN 'boxeo' WHEN 'agilidad' THEN 'agilidad' WHEN 'otra' THEN 'default' ELSE
      CASE WHEN starts_with(id, 'Maquina_Boxeo_') THEN 'boxeo' WHEN starts_with(id, 'Maquina_Agilidad_') THEN 'agilidad' ELSE 'default' END
    END AS new_key FROM changes),
rekeyed AS (
  SELECT old_id, 'Maquina_' || new_group || '_' || CASE WHEN n < 10 THEN '0' ELSE '' END || CAST(n AS VARCHAR) AS new_id
  FROM (SELECT id AS old_id, new_group, row_number() OVER (PARTITION BY new_group ORDER BY seq) +
    (SELECT coalesce(max(CAST(regexp_extract(m.id, '_(\\d+)$', 1) AS BIGINT)), 0) FROM machines m
     WHERE starts_with(m.id, 'Maquina_' || new_group || '_')) AS n
  FROM planned WHERE new_group <> old_group)),"""


def _changes(v):
    s = F.regexp_extract("name", r"(\d+)$", 1).cast("long")
    late = v.machines().select(
        (s + 1_000_000).alias("seq"), "id",
        F.when(s % 3 == 1, F.concat(F.lit("Otra "), F.col("name"))).when(s % 17 == 0, F.concat(F.lit("Boxeo "), F.col("name"))).alias("name"),
        F.when(s % 4 == 0, "Sala").alias("location"), F.when(s % 5 == 0, "maintenance").alias("status"),
        F.when(s % 7 == 0, "Boxeo").when(s % 7 == 1, "agilidad").when(s % 7 == 2, "otra").alias("type"),
        F.when(s % 6 == 0, s % 12 == 0).alias("test_mode"),
    )
    # an earlier change of each machine: the values that the later one gives, too, do not stand
    early = late.withColumns({
        "seq": F.col("seq") - 1_000_000, "name": F.when(F.col("name").isNotNull(), "Vieja"), "type": F.lit("Boxeo"),
        "location": F.when(F.col("location").isNotNull(), "Patio"),
    })
    return late.unionByName(early)


UPDATED = """coalesce(new_name, name) AS name, coalesce(new_status, status0) AS status,
  coalesce(new_location, location) AS location, coalesce(new_test_mode, test_mode) AS test_mode, new_key AS type"""


@query("machine_updates", O.over(f"""
SELECT id, {UPDATED} FROM planned WHERE new_group = old_group
UNION ALL SELECT id, name, status0, location, test_mode, type FROM planned WHERE new_group <> old_group /* machines */""", extra=CHANGES))
def _(v):
    return machine_ops.apply_machine_updates(v.machines(), _changes(v)).drop("last_ping")


@query("rekeyed_machines", O.over(f"""
SELECT coalesce(r.new_id, p.id) AS id, {UPDATED} FROM planned p LEFT JOIN rekeyed r ON r.old_id = p.id /* machines */""", extra=CHANGES))
def _(v):
    return machine_ops.rekey_machines({"machines": v.machines()}, _changes(v))["machines"].drop("last_ping")


@query("rekeyed_dependants", sql("""
SELECT 'coins' AS part, coalesce(new_id, machine_id) AS machine_id, count(*) AS n FROM coins LEFT JOIN rekeyed ON old_id = machine_id GROUP BY ALL
UNION ALL SELECT 'events', coalesce(new_id, machine_id), count(*) FROM log LEFT JOIN rekeyed ON old_id = machine_id GROUP BY ALL
UNION ALL SELECT 'assignments', machine_id, count(*) FROM user_machines WHERE machine_id NOT IN (SELECT old_id FROM rekeyed) GROUP BY ALL
""", people=True, extra=CHANGES))
def _(v):
    r = replayed(v).kept()
    out = machine_ops.rekey_machines(
        {"machines": v.machines(), "coins": r.coins(), "machine_events": r.events(), "user_machines": v.user_machines()},
        _changes(v),
    )
    count = lambda part, df: df.groupBy("machine_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "machine_id", "n")
    return count("coins", out["coins"]).unionByName(count("events", out["machine_events"])).unionByName(
        count("assignments", out["user_machines"]))


@query("machines_cascade", sql("""
SELECT 'machines' AS part, count(*) AS n FROM machines WHERE NOT test_mode
UNION ALL SELECT 'coins', count(*) FROM coins WHERE machine_id NOT IN (SELECT id FROM machines WHERE test_mode)
UNION ALL SELECT 'machine_events', count(*) FROM log WHERE machine_id NOT IN (SELECT id FROM machines WHERE test_mode)
UNION ALL SELECT 'user_machines', count(*) FROM user_machines WHERE machine_id NOT IN (SELECT id FROM machines WHERE test_mode)
""", people=True))
def _(v):
    r = replayed(v).kept()
    tables = {"machines": v.machines(), "coins": r.coins(), "machine_events": r.events(), "user_machines": v.user_machines()}
    out = machine_ops.cascade_delete_machines(tables, v.machines().where("test_mode").select("id"))
    frames = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("part"), "n") for k, df in out.items()]
    total = frames[0]
    for f in frames[1:]:
        total = total.unionByName(f)
    return total


@query("deleted_events", sql("""
SELECT c.id, c.machine_id, CASE WHEN l.timestamp < TIMESTAMP '2024-01-15 00:00:00' THEN NULL ELSE event_id END AS event_id
FROM coins c JOIN log l ON l.id = c.event_id"""))
def _(v):
    r = replayed(v).kept()
    events = r.events()
    old = events.where(F.col("timestamp") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("id")
    out = machine_ops.delete_events({"machine_events": events, "coins": r.coins()}, old)
    return out["coins"].select("id", "machine_id", "event_id")


# ---- alerts -----------------------------------------------------------------
FEED = """
feed AS (
  SELECT l.*, coalesce(m.name, l.machine_id) AS name, '• ' || m.location AS place,
    (l.timestamp AT TIME ZONE 'UTC') AT TIME ZONE 'America/Caracas' AS local
  FROM log l LEFT JOIN machines m ON m.id = l.machine_id
  WHERE l.type IN ('machine_on', 'machine_off') OR l.id IN (SELECT event_id FROM coins)),"""
LOCAL_TEXT = """(strftime(local, '%-d/%-m/%Y, %-I:%M:%S') || CASE WHEN hour(local) < 12 THEN ' a. m.' ELSE ' p. m.' END)"""


@query("alerts", sql(f"""
SELECT id AS alert_id, machine_id, type,
  CASE type WHEN 'coin_inserted' THEN 'Moneda ingresada' WHEN 'machine_on' THEN 'Máquina encendida' ELSE 'Máquina apagada' END AS title,
  CASE WHEN type = 'coin_inserted' THEN name || ' ' || place
    WHEN origin = 'auto_on' THEN name || ' ' || place || ' — reconectada'
    WHEN origin = 'timeout' THEN name || ' ' || place || ' — timeout (' || {LOCAL_TEXT} || ')'
    ELSE name || ' ' || place || ' ' || CASE WHEN type = 'machine_on' THEN 'encendida' ELSE 'apagada' END
      || ' (' || {LOCAL_TEXT} || ')' || coalesce(' — ' || reason, '') END AS body,
  CASE WHEN type = 'coin_inserted' THEN coalesce(cantidad, 1) END AS amount FROM feed""", extra=FEED))
def _(v):
    return alert_ops.build_alerts(replayed(v).alert_feed(), v.machines()).drop("data", "timestamp")


@query("alert_feed", sql("SELECT id, machine_id, type, origin, timestamp FROM feed", extra=FEED))
def _(v):
    return replayed(v).alert_feed().select("id", "machine_id", "type", "origin", "timestamp")


@query("allowed_users_of_machine", sql(f"""
SELECT id FROM users WHERE role = 'admin' UNION SELECT user_id FROM user_machines JOIN users ON id = user_id WHERE machine_id = '{MACHINE}'""",
    people=True))
def _(v):
    return alert_ops.allowed_users(v.users(), v.user_machines(), MACHINE)


@query("allowed_user_counts", sql("""
SELECT m.id AS machine_id, count(u.id) AS users FROM machines m LEFT JOIN users u ON u.role = 'admin'
  OR EXISTS (SELECT 1 FROM user_machines a WHERE a.user_id = u.id AND a.machine_id = m.id) GROUP BY ALL""", people=True))
def _(v):
    return alert_ops.allowed_user_counts(v.users(), v.user_machines(), v.machines())


SUBSCRIPTIONS = """
subs AS (
  SELECT c_custkey AS seq, 'https://push.example/' || CAST(c_custkey % 1000 AS VARCHAR) AS endpoint, c_custkey % 13 = 0 AS removed,
    c_custkey % 11 = 0 AS keyless, c_custkey % 17 = 0 AS strange FROM customer
  QUALIFY row_number() OVER (PARTITION BY c_custkey % 1000 ORDER BY c_custkey DESC) = 1),
valid AS (SELECT endpoint, seq AS user_id FROM subs WHERE NOT removed AND NOT keyless AND NOT strange),"""


def _current(v):
    return alert_ops.subscriptions_current(v.subscription_changes())


@query("current_subscriptions", O.over("SELECT endpoint, seq FROM subs WHERE NOT removed", extra=SUBSCRIPTIONS))
def _(v):
    seq = F.regexp_extract("subscription", r'"__userId":"?x?(\d+)', 1).cast("long")
    return _current(v).select("endpoint", seq.alias("seq"))


@query("valid_subscriptions", O.over("SELECT endpoint, user_id FROM valid", extra=SUBSCRIPTIONS))
def _(v):
    return alert_ops.valid_subscriptions(_current(v)).select("endpoint", "user_id")


@query("delivery_counts", sql("""
SELECT v.endpoint, v.user_id, sum(f.n) AS alerts FROM valid v JOIN users u ON u.id = v.user_id
JOIN (SELECT machine_id, count(*) AS n FROM feed GROUP BY ALL) f
  ON u.role = 'admin' OR EXISTS (SELECT 1 FROM user_machines a WHERE a.user_id = u.id AND a.machine_id = f.machine_id) GROUP BY ALL""",
    people=True, extra=FEED + SUBSCRIPTIONS).replace("sum(f.n)", "CAST(sum(f.n) AS BIGINT)"))
def _(v):
    return alert_ops.delivery_counts(
        replayed(v).alert_feed(), v.users(), v.user_machines(), alert_ops.valid_subscriptions(_current(v)))


@query("broadcast_counts", sql("SELECT endpoint, user_id, (SELECT count(*) FROM feed) AS alerts FROM valid", extra=FEED + SUBSCRIPTIONS))
def _(v):
    return alert_ops.broadcast_counts(replayed(v).alert_feed(), alert_ops.valid_subscriptions(_current(v)))


