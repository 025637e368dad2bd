"""DuckDB SQL stating what each registered query must return.

``DOMAIN`` builds the domain tables straight from the generated tables and runs the
device-message rules row by row with a recursive query; each body then states one
operator over them.
"""

from __future__ import annotations

MID = """CASE {k} % 3 WHEN 0 THEN 'Maquina_Boxeo_' || CASE WHEN {k} < 10 THEN '0' ELSE '' END || CAST({k} AS VARCHAR)
  WHEN 1 THEN 'Maquina_Agilidad_' || CASE WHEN {k} < 10 THEN '0' ELSE '' END || CAST({k} AS VARCHAR)
  ELSE 'X-' || CAST({k} AS VARCHAR) END"""
TYPE = """CASE {k} % 3 WHEN 0 THEN 'boxeo' WHEN 1 THEN 'agilidad' ELSE 'default' END"""
LOCAL_DAY = "CAST(({t} AT TIME ZONE 'UTC') AT TIME ZONE 'America/Caracas' AS DATE)"


def mid(key: str) -> str:
    return MID.format(k=key)


def day(ts: str) -> str:
    return LOCAL_DAY.format(t=ts)


HOURS6 = "INTERVAL 6 HOUR"

MESSAGES = f"""
machines AS (
  SELECT {mid('s_suppkey')} AS id, s_name AS name, n_name AS location, s_suppkey % 10 = 0 AS test_mode,
         {TYPE.format(k='s_suppkey')} AS type,
         CASE s_suppkey % 4 WHEN 1 THEN 'active' WHEN 2 THEN 'maintenance' ELSE 'inactive' END AS status0,
         CASE WHEN s_suppkey % 8 = 1 THEN TIMESTAMP '2023-12-31 20:00:00' WHEN s_suppkey % 4 = 2 THEN TIMESTAMP '2023-12-31 12:00:00'
           WHEN s_suppkey % 8 = 3 THEN TIMESTAMP '2023-12-31 23:00:00' END AS ping0
  FROM supplier JOIN nation ON n_nationkey = s_nationkey),
raw AS (
  SELECT event_id AS seq, date_trunc('millisecond', ts) AS rcv, user_id,
         {mid('user_id')} AS machine_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CASE event_type WHEN 'signup' THEN 'machine_on' WHEN 'error' THEN 'machine_off'
           WHEN 'purchase' THEN 'coin_inserted' WHEN 'click' THEN 'game_start'
           ELSE CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0 THEN 'game_end' ELSE 'ping' END
         END AS ev,
         date_trunc('millisecond', ts) - CASE WHEN event_id % 50 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS told,
         event_id % 2 = 1 AND event_id % 101 = 0 AS nameless
  FROM events),
msgs AS (
  SELECT seq, rcv, r.machine_id, ev, value,
         CASE WHEN ev = 'coin_inserted' AND k < 50 AND k <> 0 THEN CAST(k AS VARCHAR) END AS uid,
         CASE seq % 4 WHEN 1 THEN rcv WHEN 2 THEN date_trunc('second', told) ELSE told END AS ts,
         CASE WHEN ev = 'coin_inserted' AND seq % 5 = 0 THEN NULL ELSE value END AS cantidad,
         m.test_mode, m.name, m.location,
         row_number() OVER (PARTITION BY r.machine_id ORDER BY seq) AS rn
  FROM raw r JOIN machines m ON m.id = r.machine_id WHERE NOT nameless),
judged AS (
  SELECT *, uid IS NOT NULL AND row_number() OVER (PARTITION BY machine_id, ev, uid ORDER BY seq) > 1 AS dup FROM msgs),
"""


def _replay(timeout: str, tick: str | None = None) -> str:
    """Row-by-row state machine: status, last ping and last accepted coin per machine."""
    if tick:
        off = (f"make_timestamp((epoch_us(last_ping + {timeout}) // {tick} + 1) * {tick})")
        off_s = f"make_timestamp((epoch_us(s.last_ping + {timeout}) // {tick} + 1) * {tick})"
    else:
        off, off_s = f"last_ping + {timeout}", f"s.last_ping + {timeout}"
    stale = f"(s.status = 'active' AND s.last_ping IS NOT NULL AND {off_s} < j.rcv)"
    before = f"(CASE WHEN {stale} THEN 'inactive' ELSE s.status END)"
    limited = ("(j.ev = 'coin_inserted' AND NOT j.dup AND j.uid IS NULL AND s.last_coin IS NOT NULL "
               "AND j.ts - s.last_coin < INTERVAL 6 HOUR AND s.last_coin - j.ts < INTERVAL 6 HOUR)")
    return f"""
st AS (
  SELECT id AS machine_id, CAST(0 AS BIGINT) AS rn, status0 AS status, ping0 AS last_ping,
         CAST(NULL AS TIMESTAMP) AS last_coin, CAST(NULL AS VARCHAR) AS status_before, CAST(NULL AS TIMESTAMP) AS off_at,
         false AS limited
  FROM machines
  UNION ALL
  SELECT j.machine_id, j.rn,
         CASE WHEN j.ev IN ('machine_on', 'ping') THEN 'active' WHEN j.ev = 'machine_off' THEN 'inactive'
              ELSE {before} END,
         j.rcv,
         CASE WHEN j.ev = 'coin_inserted' AND NOT j.dup AND NOT {limited}
              THEN greatest(coalesce(s.last_coin, j.ts), j.ts) ELSE s.last_coin END,
         {before},
         CASE WHEN {stale} THEN {off_s} END,
         {limited}
  FROM st s JOIN judged j ON j.machine_id = s.machine_id AND j.rn = s.rn + 1),
states AS (
  SELECT j.*, s.status AS status_after, s.status_before, s.off_at, s.limited,
         CASE WHEN j.ev = 'machine_on' AND s.status_before = 'active' THEN 'ping' ELSE j.ev END AS event,
         j.ev = 'machine_on' AND s.status_before = 'active' AS suppressed_on,
         (j.ev = 'ping' AND s.status_before <> 'active') AS auto_on,
         CASE WHEN dup THEN 'duplicate' WHEN s.limited THEN 'rate_limit'
              WHEN j.ev = 'coin_inserted' AND j.test_mode THEN 'test_coin'
              WHEN j.ev = 'coin_inserted' AND s.status <> 'active' THEN 'ghost_coin'
              ELSE 'accepted' END AS disposition
  FROM judged j JOIN st s ON s.machine_id = j.machine_id AND s.rn = j.rn),
final AS (
  SELECT m.id AS machine_id, m.name, m.location, m.type, coalesce(s.status, m.status0) AS status,
         coalesce(s.last_ping, m.ping0) AS last_ping, s.seq AS last_seq,
         CASE WHEN s.status = 'active' AND {off} < TIMESTAMP '2024-01-31 00:00:00' THEN {off} END AS off_at
  FROM machines m LEFT JOIN (
    SELECT st.*, j.seq FROM st JOIN judged j ON j.machine_id = st.machine_id AND j.rn = st.rn
    QUALIFY row_number() OVER (PARTITION BY st.machine_id ORDER BY st.rn DESC) = 1) s ON s.machine_id = m.id),
log AS (
  SELECT seq * 4 AS id, machine_id, event AS type, ts AS timestamp, 'message' AS origin,
         CASE WHEN suppressed_on THEN 'duplicate_on' END AS reason, test_mode AS test,
         cantidad, uid, CASE WHEN ev = 'game_end' THEN value END AS score
  FROM states WHERE disposition NOT IN ('duplicate', 'rate_limit')
  UNION ALL SELECT seq * 4 + 1, machine_id, 'machine_on', ts, 'auto_on', 'ping', false, NULL, NULL, NULL FROM states WHERE auto_on
  UNION ALL SELECT seq * 4 - 1, machine_id, 'machine_off', off_at, 'timeout', 'timeout', false, NULL, NULL, NULL
            FROM states WHERE off_at IS NOT NULL
  UNION ALL SELECT last_seq * 4 + 2, machine_id, 'machine_off', off_at, 'timeout', 'timeout', false, NULL, NULL, NULL
            FROM final WHERE off_at IS NOT NULL),
coins AS (
  SELECT seq * 4 AS id, machine_id, rcv AS timestamp, seq * 4 AS event_id, uid AS unique_id, {day('rcv')} AS local_day
  FROM states WHERE event = 'coin_inserted' AND disposition = 'accepted'),
"""


PEOPLE = f"""
users AS (
  SELECT c_custkey AS id, 'user' || CAST(c_custkey AS VARCHAR) AS username,
         CASE WHEN c_custkey % 50 = 0 THEN 'admin' ELSE 'employee' END AS role, c_name AS name,
         CASE WHEN c_nationkey % 2 = 0 THEN 'manana' ELSE 'tarde' END AS shift,
         CASE WHEN c_custkey % 7 <> 0 THEN 'V-' || CAST(c_custkey AS VARCHAR) END AS document_id,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'Supervisor de turno' WHEN 'FURNITURE' THEN 'Supervisores'
           WHEN 'HOUSEHOLD' THEN NULL ELSE 'Operador' END AS job_role,
         CASE WHEN c_custkey % 3 = 1 THEN CAST(c_custkey % 150 AS INTEGER) END AS operator_coin_balance
  FROM customer),
user_machines AS (
  SELECT DISTINCT o_custkey AS user_id, {mid('l_suppkey')} AS machine_id
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
order_lines AS (
  SELECT l_orderkey, l_linenumber, o_custkey, CAST(o_orderdate AS DATE) AS day, o_orderpriority, o_orderstatus,
         min(l_suppkey) AS suppkey, sum(l_quantity) AS quantity, min(l_extendedprice) AS price,
         min(l_discount) AS discount, min(l_tax) AS tax, min(l_returnflag) AS flag
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
sale_changes AS (
  SELECT l_orderkey * 8 + l_linenumber AS seq, o_custkey AS employee_id, {mid('suppkey')} AS machine_id,
         day AS sale_date, CAST(quantity AS INTEGER) AS coins, CASE WHEN flag = 'A' THEN 'record' END AS record_message,
         CASE WHEN discount > 0.05 THEN CAST((CAST(round(price * 100) AS BIGINT) // 100) / 100 AS DECIMAL(12, 2)) END AS prize_bs,
         CAST(round(tax * 100) AS INTEGER) AS lost, CASE WHEN flag = 'R' THEN 1 ELSE 0 END AS returned,
         CASE WHEN l_linenumber % 2 = 1 THEN CAST(quantity AS INTEGER) END AS entry_coins,
         CAST(day AS TIMESTAMP) AS changed_at
  FROM order_lines),
resets AS (
  SELECT o_orderkey * 8 + 8 AS seq, o_custkey + CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END AS employee_id FROM orders),
"""


def over(body: str, *, replay: bool = False, people: bool = False, tick: str | None = None, extra: str = "") -> str:
    """SQL text with the domain tables the body needs."""
    parts = []
    if replay:
        parts.append(MESSAGES + _replay(HOURS6, tick))
    elif "machines" in body or "msgs" in body or "raw" in body:
        parts.append(MESSAGES)
    if people:
        parts.append(PEOPLE)
    ctes = "".join(parts) + extra
    return f"WITH RECURSIVE {ctes.strip().rstrip(',')}\n{body}"
