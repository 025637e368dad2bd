"""Queries over users, assignments, sales, balances, reports and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from fichaflow import schemas as S
from fichaflow.operators import machines as machine_ops
from fichaflow.operators import quality, reports as report_ops, sales as sale_ops, users as user_ops
from fichaflow.plans import oracles as O
from fichaflow.plans.registration import query, replayed

# a supervisor and a plain employee of the sample users, chosen at run time by smallest id
SUPERVISOR, OPERATOR = "Supervisor de turno", "Operador"


def sql(body, extra="", **kw):
    return O.over(body, people=True, extra=extra, **kw)


def someone(v, job_role):
    """Smallest employee id with a role: stands for the signed-in user."""
    mine = v.users().where((F.col("role") == "employee") & (F.col("job_role") == job_role))
    return mine.agg(F.min("id")).first()[0]


def someone_sql(job_role):
    return f"(SELECT min(id) FROM users WHERE role = 'employee' AND job_role = '{job_role}')"


def many(parts):
    """Union of (name, frame) as part, n."""
    frames = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n") for name, df in parts]
    total = frames[0]
    for f in frames[1:]:
        total = total.unionByName(f)
    return total


# ---- sales ------------------------------------------------------------------
PAYLOADS = """
payloads AS (
  SELECT seq, employee_id AS actor_id, CASE WHEN seq % 41 = 0 THEN NULL WHEN seq % 6 = 0 THEN 7 END AS requested, machine_id,
    sale_date, coins, record_message, prize_bs, lost, returned, entry_coins, changed_at,
    CASE WHEN seq % 43 = 0 OR seq % 47 = 0 OR seq % 53 = 0 OR (seq % 59 <> 0 AND seq % 61 = 0 AND coins > 0) THEN 'invalid_payload'
      WHEN seq % 67 = 0 THEN 'invalid_prize' WHEN seq % 71 <> 0 AND seq % 73 = 0 THEN 'invalid_lost_returned'
      WHEN entry_coins IS NULL AND seq % 79 = 0 THEN 'invalid_entry_coins' END AS reject,
    CASE WHEN seq % 59 = 0 THEN 0 ELSE coins END AS coins_in, CASE WHEN seq % 71 = 0 THEN 2 ELSE lost END AS lost_in FROM sale_changes),
scoped AS (
  SELECT p.*, CASE WHEN u.role = 'admin' THEN coalesce(requested, actor_id) ELSE actor_id END AS employee_id,
    CASE WHEN u.id IS NULL THEN 'unknown_user' WHEN u.role <> 'admin' AND a.user_id IS NULL THEN 'forbidden' END AS scope_reject
  FROM payloads p LEFT JOIN users u ON u.id = actor_id
  LEFT JOIN user_machines a ON a.user_id = actor_id AND a.machine_id = CASE WHEN p.seq % 43 = 0 THEN '' ELSE p.machine_id END),"""


@query("sale_validation", sql("""
SELECT seq, reject, CASE WHEN reject IS NULL THEN coins_in END AS coins,
  CASE WHEN reject IS NULL THEN CAST(prize_bs AS DOUBLE) END AS prize_bs, entry_coins FROM payloads""", PAYLOADS))
def _(v):
    return sale_ops.validate_sales(v.sale_payloads()).select("seq", "reject", "coins", "prize_bs", "entry_coins")


@query("sale_write_scope", sql("SELECT seq, actor_id, employee_id, scope_reject FROM scoped", PAYLOADS))
def _(v):
    judged = sale_ops.write_scope(v.sale_payloads(), v.users(), v.user_machines())
    return judged.select("seq", "actor_id", "employee_id", "scope_reject")


@query("accepted_sales", sql("""
SELECT seq, employee_id, machine_id, sale_date, coins_in AS coins, lost_in AS lost, returned FROM scoped
WHERE reject IS NULL AND scope_reject IS NULL""", PAYLOADS))
def _(v):
    kept = sale_ops.accepted_sales(v.sale_payloads(), v.users(), v.user_machines())
    return kept.select("seq", "employee_id", "machine_id", "sale_date", "coins", "lost", "returned")


SALES = """
sales AS (
  SELECT min(seq) OVER k AS id, employee_id, machine_id, sale_date, coins, record_message, prize_bs, lost, returned,
    first_value(changed_at) OVER (PARTITION BY employee_id, machine_id, sale_date ORDER BY seq) AS created_at, changed_at AS updated_at
  FROM sale_changes WINDOW k AS (PARTITION BY employee_id, machine_id, sale_date)
  QUALIFY row_number() OVER (PARTITION BY employee_id, machine_id, sale_date ORDER BY seq DESC) = 1),
entries AS (
  SELECT seq AS id, employee_id, machine_id, sale_date, coalesce(entry_coins, 0) AS coins, record_message, prize_bs, lost, returned,
    changed_at AS created_at
  FROM sale_changes WHERE entry_coins IS NOT NULL OR record_message <> '' OR prize_bs IS NOT NULL OR lost > 0 OR returned > 0),"""


def sales(v):
    return sale_ops.upsert_daily_sales(v.sale_changes())


def entries(v):
    return sale_ops.derive_sale_entries(v.sale_changes())


@query("daily_sales", sql("SELECT * REPLACE (CAST(prize_bs AS DOUBLE) AS prize_bs) FROM sales", SALES))
def _(v):
    return sales(v)


@query("sale_entries", sql("SELECT * REPLACE (CAST(prize_bs AS DOUBLE) AS prize_bs) FROM entries", SALES))
def _(v):
    return entries(v)


MOVES = SALES + """
moves AS (
  SELECT *, row_number() OVER (PARTITION BY employee_id ORDER BY seq) AS rn FROM (
    SELECT employee_id, id AS seq, coins AS spent, false AS is_reset FROM entries
    UNION ALL SELECT employee_id, seq, 0, true FROM resets)),
walk AS (
  SELECT employee_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS seq, false AS is_reset, 
         CAST(coalesce(operator_coin_balance, 200) AS BIGINT) AS balance
  FROM (SELECT DISTINCT employee_id FROM moves) LEFT JOIN users ON id = employee_id
  UNION ALL
  SELECT m.employee_id, m.rn, m.seq, m.is_reset, CASE WHEN m.is_reset THEN 200 ELSE greatest(0, w.balance - m.spent) END
  FROM walk w JOIN moves m ON m.employee_id = w.employee_id AND m.rn = w.rn + 1),"""
BALANCE_SQL = sql("SELECT employee_id, seq, is_reset, balance FROM walk WHERE rn > 0", MOVES)


@query("operator_balance", BALANCE_SQL)
def _(v):
    return sale_ops.operator_balance(entries(v), v.balance_resets(), v.users())


@query("operator_balance_in_blocks", BALANCE_SQL)
def _(v):
    return sale_ops.operator_balance(entries(v), v.balance_resets(), v.users(), block_rows=30)


@query("current_balance", sql("""
SELECT u.id AS employee_id, coalesce(w.balance, u.operator_coin_balance, 200) AS remaining_coins FROM users u LEFT JOIN (
  SELECT employee_id, balance FROM walk QUALIFY row_number() OVER (PARTITION BY employee_id ORDER BY rn DESC) = 1) w
ON w.employee_id = u.id""", MOVES))
def _(v):
    return sale_ops.current_balance(v.users(), entries(v), v.balance_resets())


@query("reset_requests", sql("""
SELECT r.seq, actor_id, employee_id, CASE WHEN a.id IS NULL THEN 'unknown_user'
  WHEN a.role <> 'admin' AND coalesce(a.job_role, '') <> 'Supervisor de turno' THEN 'forbidden'
  WHEN t.id IS NULL THEN 'unknown_employee'
  WHEN t.role <> 'employee' OR coalesce(t.job_role, '') <> 'Operador' THEN 'not_an_operator'
  WHEN a.role <> 'admin' AND NOT EXISTS (SELECT 1 FROM user_machines x JOIN user_machines y ON x.machine_id = y.machine_id
    WHERE x.user_id = actor_id AND y.user_id = r.employee_id) THEN 'forbidden' END AS reject
FROM (SELECT o_orderkey AS seq, o_custkey AS actor_id, CASE WHEN o_orderkey % 9 = 0 THEN -1 ELSE (o_custkey + o_orderkey) % 150 END AS employee_id FROM orders) r
LEFT JOIN users a ON a.id = actor_id LEFT JOIN users t ON t.id = r.employee_id"""))
def _(v):
    return sale_ops.judge_resets(_requests(v), v.users(), v.user_machines())


def _requests(v):
    key = F.col("o_orderkey")
    return v.table("orders").select(
        key.alias("seq"), F.col("o_custkey").alias("actor_id"),
        F.when(key % 9 == 0, F.lit(-1)).otherwise((F.col("o_custkey") + key) % 150).cast("long").alias("employee_id"),
    )


LISTED = """s.id, s.machine_id, m.name AS machine_name, m.type AS machine_type, s.employee_id, u.username AS employee_username,
  u.name AS employee_name, s.sale_date, s.coins, s.record_message, CAST(s.prize_bs AS DOUBLE) AS prize_bs, s.lost, s.returned"""
FROM_ALL = "JOIN users u ON u.id = s.employee_id JOIN machines m ON m.id = s.machine_id"
NOT_SUPERVISOR = "coalesce(u.job_role, '') NOT ILIKE '%supervisor%'"
MY_MACHINES = f"SELECT machine_id FROM user_machines WHERE user_id = {someone_sql(SUPERVISOR)}"


@query("sales_of_admin", sql(
    f"SELECT {LISTED}, m.location AS machine_location, s.created_at, s.updated_at FROM sales s {FROM_ALL} WHERE {NOT_SUPERVISOR}", SALES))
def _(v):
    return sale_ops.list_daily_sales(sales(v), v.users(), v.machines(), v.user_machines())


@query("sales_of_admin_filtered", sql(
    f"""SELECT {LISTED}, m.location AS machine_location, s.created_at, s.updated_at FROM sales s {FROM_ALL} WHERE {NOT_SUPERVISOR}
    AND s.sale_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND s.machine_id = 'Maquina_Boxeo_03'""", SALES))
def _(v):
    return sale_ops.list_daily_sales(sales(v), v.users(), v.machines(), v.user_machines(), start="1996-01-01",
                                     end="1998-12-31", machine_id="Maquina_Boxeo_03")


@query("sales_of_employee", sql(
    f"SELECT {LISTED}, m.location AS machine_location, s.created_at, s.updated_at FROM sales s {FROM_ALL} WHERE u.id = {someone_sql(OPERATOR)}", SALES))
def _(v):
    return sale_ops.list_daily_sales(sales(v), v.users(), v.machines(), v.user_machines(), "employee", someone(v, OPERATOR), employee_id=5)


@query("sales_of_supervisor", sql(
    f"SELECT {LISTED}, m.location AS machine_location, s.created_at, s.updated_at FROM sales s {FROM_ALL} WHERE s.machine_id IN ({MY_MACHINES})", SALES))
def _(v):
    return sale_ops.list_daily_sales(sales(v), v.users(), v.machines(), v.user_machines(), "supervisor", someone(v, SUPERVISOR))


@query("entries_of_admin", sql(f"SELECT {LISTED}, s.created_at FROM entries s {FROM_ALL} WHERE {NOT_SUPERVISOR}", SALES))
def _(v):
    return sale_ops.list_sale_entries(entries(v), v.users(), v.machines(), v.user_machines())


@query("entries_of_employee", sql(f"SELECT {LISTED}, s.created_at FROM entries s {FROM_ALL} WHERE u.id = {someone_sql(OPERATOR)}", SALES))
def _(v):
    return sale_ops.list_sale_entries(entries(v), v.users(), v.machines(), v.user_machines(), "employee", someone(v, OPERATOR))


@query("entries_of_supervisor", sql(f"SELECT {LISTED}, s.created_at FROM entries s {FROM_ALL} WHERE s.machine_id IN ({MY_MACHINES})", SALES))
def _(v):
    return sale_ops.list_sale_entries(entries(v), v.users(), v.machines(), v.user_machines(), "supervisor", someone(v, SUPERVISOR))


SUMMARY = """SELECT u.id AS employee_id, u.username AS employee_username, u.name AS employee_name,
  coalesce((SELECT string_agg(DISTINCT coalesce(m.name, a.machine_id), ',' ORDER BY coalesce(m.name, a.machine_id)) FROM user_machines a
    LEFT JOIN machines m ON m.id = a.machine_id WHERE a.user_id = u.id {mine_a}), '') AS machine_names,
  coalesce((SELECT CAST(sum(coins) AS BIGINT) FROM sales s WHERE s.employee_id = u.id AND s.sale_date >= DATE '1996-01-01'
    AND s.sale_date <= DATE '1999-06-30' {mine_s}), 0) AS total_coins
FROM users u WHERE u.role = 'employee' AND coalesce(u.job_role, '') NOT ILIKE '%supervisor%' {mine_u}"""


@query("summary_of_admin", sql(SUMMARY.format(mine_a="", mine_s="", mine_u=""), SALES))
def _(v):
    return sale_ops.employee_summary(sales(v), v.users(), v.machines(), v.user_machines(), start="1996-01-01", end="1999-06-30")


@query("summary_of_supervisor", sql(SUMMARY.format(
    mine_a=f"AND a.machine_id IN ({MY_MACHINES})", mine_s=f"AND s.machine_id IN ({MY_MACHINES})",
    mine_u=f"AND u.id IN (SELECT user_id FROM user_machines WHERE machine_id IN ({MY_MACHINES}))"), SALES))
def _(v):
    return sale_ops.employee_summary(sales(v), v.users(), v.machines(), v.user_machines(), "supervisor",
                                     someone(v, SUPERVISOR), "1996-01-01", "1999-06-30")


@query("viewer_scopes", sql("""
SELECT id, CASE WHEN role = 'admin' THEN 'admin' WHEN job_role = 'Supervisor de turno' THEN 'supervisor' ELSE 'employee' END AS scope,
  coalesce(job_role, '') NOT ILIKE '%supervisor%' AS listed, coalesce(job_role = 'Operador', false) AS operator FROM users"""))
def _(v):
    return sale_ops.viewer_scope(v.users())


# ---- reports ----------------------------------------------------------------
REPORTS = """
report_lines AS (
  SELECT l_orderkey AS seq, o_custkey AS actor_id, day, o_orderstatus,
    CAST(sum(CASE WHEN suppkey % 2 = 0 THEN quantity ELSE 0 END) AS INTEGER) AS boxeo_coins,
    CAST(sum(CASE WHEN suppkey % 2 = 0 THEN round(tax * 100) ELSE 0 END) AS INTEGER) AS boxeo_lost,
    CAST(sum(CASE WHEN suppkey % 2 = 0 AND flag = 'R' THEN 1 ELSE 0 END) AS INTEGER) AS boxeo_returned,
    CAST(sum(CASE WHEN suppkey % 2 = 1 THEN quantity ELSE 0 END) AS INTEGER) AS agilidad_coins,
    CAST(sum(CASE WHEN suppkey % 2 = 1 THEN round(tax * 100) ELSE 0 END) AS INTEGER) AS agilidad_lost,
    CAST(sum(CASE WHEN suppkey % 2 = 1 AND flag = 'R' THEN 1 ELSE 0 END) AS INTEGER) AS agilidad_returned,
    CAST(sum(l_linenumber) AS INTEGER) AS remaining_coins,
    CAST(sum(CAST((CAST(round(price * 100) AS BIGINT) // 100) / 100 AS DECIMAL(12, 2))) AS DOUBLE) AS pago_movil,
    CAST(sum(CAST(round(discount, 2) AS DECIMAL(12, 2))) AS DOUBLE) AS dolares,
    CAST(sum(CAST(round(tax, 2) AS DECIMAL(12, 2))) AS DOUBLE) AS bolivares,
    CAST(sum(CAST((CAST(round(price * 100) AS BIGINT) // 1000) / 100 AS DECIMAL(12, 2))) AS DOUBLE) AS premio,
    CAST(sum(CAST(round(price, 2) AS DECIMAL(12, 2))) AS DOUBLE) AS total
  FROM order_lines GROUP BY ALL),
report_changes AS (
  SELECT r.* EXCLUDE (day, actor_id), actor_id, CASE WHEN u.role = 'admin' AND r.seq % 5 = 0 THEN 11 ELSE actor_id END AS employee_id,
    CAST(day + CAST((7 - isodow(day)) AS INTEGER) AS DATE) AS week_end_date, CAST(day AS TIMESTAMP) AS changed_at, o_orderstatus = 'F' AS daily,
    CASE WHEN r.seq % 89 = 0 THEN 'invalid_date' WHEN r.seq % 97 = 0 THEN 'invalid_payload' END AS reject
  FROM report_lines r JOIN users u ON u.id = actor_id),
weekly AS (
  SELECT min(seq) OVER (PARTITION BY employee_id, week_end_date) AS id, * EXCLUDE (seq, actor_id, o_orderstatus, changed_at, daily, reject),
    first_value(changed_at) OVER (PARTITION BY employee_id, week_end_date ORDER BY seq) AS created_at, changed_at AS updated_at
  FROM report_changes WHERE reject IS NULL AND NOT daily
  QUALIFY row_number() OVER (PARTITION BY employee_id, week_end_date ORDER BY seq DESC) = 1),
daily AS (
  SELECT seq AS id, * EXCLUDE (seq, actor_id, o_orderstatus, week_end_date, changed_at, daily, reject), week_end_date AS report_date, changed_at AS created_at
  FROM report_changes WHERE reject IS NULL AND daily),"""


def report_changes(v):
    judged = sale_ops.write_scope(report_ops.validate_reports(v.report_payloads()), v.users(), None)
    return judged.where(F.col("reject").isNull() & F.col("scope_reject").isNull())


def weekly(v):
    return report_ops.upsert_weekly_reports(report_changes(v))


def daily(v):
    return report_ops.append_daily_reports(report_changes(v))


@query("report_validation", sql("""
SELECT seq, reject, daily, boxeo_coins, CASE WHEN seq % 97 = 0 THEN NULL ELSE premio END AS premio,
  CASE WHEN seq % 89 = 0 THEN NULL ELSE week_end_date END AS week_end_date FROM report_changes""", REPORTS))
def _(v):
    return report_ops.validate_reports(v.report_payloads()).select(
        "seq", "reject", "daily", "boxeo_coins", "premio", "week_end_date")


@query("report_kinds", sql("SELECT daily, count(*) AS n FROM report_changes GROUP BY ALL", REPORTS))
def _(v):
    return report_ops.validate_reports(v.report_payloads()).groupBy("daily").agg(F.count(F.lit(1)).alias("n"))


@query("weekly_reports", sql("SELECT * FROM weekly", REPORTS))
def _(v):
    return weekly(v)


@query("daily_reports", sql("SELECT * FROM daily", REPORTS))
def _(v):
    return daily(v)


PEOPLE_NAMES = "u.username AS employee_username, u.name AS employee_name"
SHARING = f"SELECT user_id FROM user_machines WHERE machine_id IN ({MY_MACHINES})"
DAILY = "r.* EXCLUDE (report_date), report_date AS week_end_date, CAST(NULL AS TIMESTAMP) AS updated_at"
REPORT_SCOPES = {
    "admin": (NOT_SUPERVISOR, None),
    "employee": (f"u.id = {someone_sql(OPERATOR)}", OPERATOR),
    "supervisor": (f"u.id IN ({SHARING})", SUPERVISOR),
}


def _register_report_lists():
    for scope, (where, role) in REPORT_SCOPES.items():
        for name, columns, lister, source in (
            ("weekly", "r.*", report_ops.list_weekly, weekly), ("daily", DAILY, report_ops.list_daily, daily),
        ):
            def run(v, scope=scope, role=role, lister=lister, source=source):
                me = someone(v, role) if role else None
                return lister(source(v), v.users(), v.user_machines(), scope, me)

            query(f"{name}_reports_of_{scope}", sql(
                f"SELECT {columns}, {PEOPLE_NAMES} FROM {name} r JOIN users u ON u.id = r.employee_id WHERE {where}", REPORTS))(run)


_register_report_lists()


# ---- users ------------------------------------------------------------------
USER_COLUMNS = "u.id, u.username, u.role, u.name, u.shift, u.document_id, u.job_role, u.operator_coin_balance"
IDS = "coalesce((SELECT string_agg(machine_id, ',' ORDER BY machine_id) FROM user_machines a WHERE a.user_id = u.id), '')"


@query("users_with_machines", sql(f"SELECT {USER_COLUMNS}, {IDS} AS assigned_machine_ids FROM users u"))
def _(v):
    return user_ops.users_with_machines(v.users(), v.user_machines())


@query("user_profile", sql(f"SELECT {USER_COLUMNS}, {IDS} AS assigned_machine_ids FROM users u WHERE u.id = {someone_sql(OPERATOR)}"))
def _(v):
    return user_ops.user_profile(v.users(), v.user_machines(), someone(v, OPERATOR))


@query("assigned_machines", sql(f"SELECT u.id AS user_id, {IDS} AS ids FROM users u"))
def _(v):
    return user_ops.assigned_machines(v.users(), v.user_machines())


@query("primary_machine", sql(
    "SELECT u.id, (SELECT min(machine_id) FROM user_machines a WHERE a.user_id = u.id) AS assigned_machine_id FROM users u"))
def _(v):
    return user_ops.primary_machine(v.users(), v.user_machines())


def _assignment_changes(v):
    key = F.col("o_orderkey")
    mid = F.concat(F.lit("M-"), (key % 13).cast("string"))
    many_ids = F.array(mid, F.lit(""), F.concat(F.lit("M-"), (key % 7).cast("string")))
    # users with even numbers get the changes of two customers
    return v.table("orders").select(
        key.alias("seq"), (F.col("o_custkey") - F.col("o_custkey") % 2).alias("user_id"),
        F.when(key % 3 == 0, many_ids).alias("machine_ids"), F.when(key % 3 == 1, mid).alias("machine_id"),
    )


@query("replaced_assignments", sql("""
SELECT user_id, machine_id FROM user_machines WHERE user_id NOT IN (SELECT user_id FROM last)
UNION ALL SELECT user_id, 'M-' || CAST(seq % 13 AS VARCHAR) FROM last WHERE seq % 3 < 2
UNION ALL SELECT user_id, 'M-' || CAST(seq % 7 AS VARCHAR) FROM last WHERE seq % 3 = 0 AND seq % 7 <> seq % 13""", """
last AS (SELECT o_custkey - o_custkey % 2 AS user_id, max(o_orderkey) AS seq FROM orders GROUP BY ALL),"""))
def _(v):
    return user_ops.replace_assignments(v.user_machines(), _assignment_changes(v))


@query("restored_assignment", sql(
    "SELECT u.* EXCLUDE (operator_coin_balance), (SELECT min(machine_id) FROM user_machines a WHERE a.user_id = u.id) AS assigned_machine_id FROM users u"))
def _(v):
    return user_ops.restore_single_assignment(v.users(), v.user_machines()).drop("operator_coin_balance")


@query("migrated_assignment", sql("SELECT user_id, min(machine_id) AS machine_id FROM user_machines GROUP BY ALL"))
def _(v):
    return user_ops.migrate_single_assignment(user_ops.restore_single_assignment(v.users(), v.user_machines()))


@query("remapped_roles", sql("""SELECT id, CASE WHEN id % 5 = 0 THEN 'employee' ELSE role END AS role FROM users"""))
def _(v):
    old = v.users().withColumn("role", F.when(F.col("id") % 5 == 0, "supervisor").otherwise(F.col("role")))
    return user_ops.remap_roles(old).select("id", "role")


PROFILE_CHANGES = """
asked AS (
  SELECT id, CASE WHEN id % 4 = 0 THEN '' WHEN id % 4 = 1 THEN 'N' WHEN id % 4 = 2 THEN 'Nombre' ELSE '' END AS new_name,
    CASE WHEN id % 6 = 0 THEN 'ab' WHEN id % 6 = 1 THEN 'user' || CAST(id + 1 AS VARCHAR) WHEN id % 6 = 2 THEN 'nuevo' || CAST(id // 2 AS VARCHAR)
      WHEN id % 6 = 3 THEN 'nuevo' || CAST((id - 1) // 2 AS VARCHAR) ELSE '' END AS new_username FROM users),
judged_profiles AS (
  SELECT a.*, CASE WHEN new_name = '' AND new_username = '' THEN 'no_changes' WHEN new_username <> '' AND length(new_username) < 3 THEN 'username_too_short'
    WHEN new_name <> '' AND length(new_name) < 2 THEN 'name_too_short'
    WHEN EXISTS (SELECT 1 FROM users o WHERE o.username = new_username AND o.id <> a.id) THEN 'username_exists'
    WHEN new_username <> '' AND EXISTS (SELECT 1 FROM asked b WHERE b.new_username = a.new_username AND b.id < a.id) THEN 'username_exists' END AS reject
  FROM asked a),"""


def _profile_changes(v):
    key = F.col("id")
    text = lambda p, n: F.concat(F.lit(p), n.cast("long").cast("string"))
    return v.users().select(
        key.alias("seq"), "id",
        F.when(key % 4 == 1, " N ").when(key % 4 == 2, " Nombre").alias("name"),
        F.when(key % 6 == 0, "ab").when(key % 6 == 1, text("user", key + 1)).when(key % 6 == 2, text(" nuevo", F.floor(key / 2)))
        .when(key % 6 == 3, text("nuevo", F.floor((key - 1) / 2))).otherwise(" ").alias("username"),
    )


@query("profile_verdicts", sql("SELECT id, reject FROM judged_profiles", PROFILE_CHANGES))
def _(v):
    return user_ops.judge_profile_updates(v.users(), _profile_changes(v)).select("id", "reject")


@query("profile_updates", sql("""
SELECT u.id, CASE WHEN j.reject IS NULL AND new_name <> '' THEN new_name ELSE u.name END AS name,
  CASE WHEN j.reject IS NULL AND new_username <> '' THEN new_username ELSE u.username END AS username
FROM users u JOIN judged_profiles j ON j.id = u.id""", PROFILE_CHANGES))
def _(v):
    return user_ops.apply_profile_updates(v.users(), _profile_changes(v)).select("id", "name", "username")


@query("user_updates", sql("""
SELECT id, CASE WHEN id % 3 = 0 THEN name ELSE 'n' END AS name, CASE WHEN id % 3 = 0 THEN shift END AS shift,
  CASE WHEN id % 3 = 0 THEN document_id END AS document_id, CASE WHEN id % 3 = 0 THEN job_role ELSE 'Operador' END AS job_role,
  CASE WHEN id % 3 = 0 THEN role WHEN id % 3 = 1 THEN 'employee' ELSE 'admin' END AS role FROM users"""))
def _(v):
    key = F.col("id")
    changes = v.users().select(
        (key + 1_000_000_000).alias("seq"), "id", F.lit("n").alias("name"), F.lit(None).cast("string").alias("shift"), F.lit(None).cast("string").alias("document_id"),
        F.lit("Operador").alias("job_role"), F.when(key % 3 == 0, "jefe").when(key % 3 == 2, "admin").alias("role"),
    )
    # an earlier change of each user, which the one above overwrites
    changes = changes.unionByName(changes.withColumns({"seq": key, "name": F.lit("old"), "job_role": F.lit("old")}))
    return user_ops.apply_user_updates(v.users(), changes).select("id", "name", "shift", "document_id", "job_role", "role")


DOCUMENT_CHANGES = """
asked AS (
  SELECT id + k * 1000000000 AS seq, CASE WHEN id % 41 = 0 THEN -id ELSE id END AS id,
    CASE WHEN id % 37 = 0 THEN 'jefe' WHEN id % 5 = 0 THEN 'admin' END AS role, name, shift, job_role,
    CASE (id + k) % 6 WHEN 0 THEN 'V-' || CAST(id + 1 AS VARCHAR) WHEN 1 THEN document_id WHEN 2 THEN 'N-' || CAST(id % 40 AS VARCHAR)
      WHEN 3 THEN '' WHEN 4 THEN 'V-' || CAST(id * 7 AS VARCHAR) END AS document_id
  FROM users, (SELECT unnest([0, 1]) AS k)),
checked AS (
  SELECT *, CASE WHEN role = 'jefe' THEN 'invalid_role' WHEN id < 0 THEN 'unknown_user'
    WHEN EXISTS (SELECT 1 FROM users u WHERE u.document_id = asked.document_id AND u.id <> asked.id) THEN 'document_exists' END AS bad
  FROM asked),
claims AS (SELECT document_id, arg_min(id, seq) AS claimed_by FROM checked WHERE bad IS NULL AND document_id <> '' GROUP BY 1),
verdicts AS (
  SELECT c.*, coalesce(bad, CASE WHEN claimed_by <> c.id THEN 'document_exists' END) AS reject
  FROM checked c LEFT JOIN claims ON claims.document_id = c.document_id),
"""


def document_changes(v):
    """Two changes of each user: another's document, the own one, one of a few new ones, a blank, a multiple's, none."""
    key = F.col("id")
    text = lambda n, prefix="V-": F.concat(F.lit(prefix), n.cast("string"))
    rows = v.users().withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    kind = (key + F.col("k")) % 6
    document = (
        F.when(kind == 0, text(key + 1)).when(kind == 1, F.col("document_id")).when(kind == 2, text(key % 40, "N-"))
        .when(kind == 3, "").when(kind == 4, text(key * 7))
    )
    return rows.select(
        (key + F.col("k") * 1_000_000_000).alias("seq"), F.when(key % 41 == 0, -key).otherwise(key).alias("id"),
        F.when(key % 37 == 0, "jefe").when(key % 5 == 0, "admin").alias("role"), "name", "shift", document.alias("document_id"), "job_role",
    )


@query("user_update_verdicts", sql("SELECT seq, id, reject FROM verdicts", DOCUMENT_CHANGES))
def _(v):
    return user_ops.judge_user_updates(v.users(), document_changes(v)).select("seq", "id", "reject")


@query("user_updates_with_documents", sql("""
SELECT u.id, CASE WHEN n.id IS NULL THEN u.document_id ELSE n.document_id END AS document_id,
  CASE WHEN n.id IS NULL THEN u.role ELSE coalesce(n.role, 'employee') END AS role
FROM users u LEFT JOIN (SELECT id, l.d AS document_id, l.r AS role FROM (
  SELECT id, arg_max(struct_pack(d := nullif(document_id, ''), r := role), seq) AS l FROM verdicts WHERE reject IS NULL GROUP BY id)) n
  ON n.id = u.id""", DOCUMENT_CHANGES))
def _(v):
    return user_ops.apply_user_updates(v.users(), document_changes(v)).select("id", "document_id", "role")


SIGN_UPS = """
asked AS (
  SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 29 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN 'user' || CAST(o_custkey AS VARCHAR)
      ELSE 'nueva' || CAST(o_custkey AS VARCHAR) END AS username, o_orderkey % 31 <> 0 AS has_password,
    CASE WHEN o_orderkey % 37 = 0 THEN 'jefe' ELSE 'employee' END AS role, CASE WHEN o_orderkey % 2 = 0 THEN 'Ana' ELSE '' END AS name,
    CASE WHEN o_orderkey % 5 < 2 THEN 'D-' || CAST(o_orderkey % 1000 AS VARCHAR) WHEN o_orderkey % 5 = 2 THEN 'V-' || CAST(o_custkey AS VARCHAR) END AS document_id
  FROM orders),
first_check AS (
  SELECT *, CASE WHEN username = '' OR NOT has_password THEN 'missing_field' WHEN role = 'jefe' THEN 'invalid_role'
    WHEN username IN (SELECT username FROM users) THEN 'username_exists'
    WHEN document_id IN (SELECT document_id FROM users) THEN 'document_exists' END AS bad FROM asked),
second_check AS (
  SELECT * REPLACE (CASE WHEN bad IS NULL AND seq > min(CASE WHEN bad IS NULL THEN seq END) OVER (PARTITION BY username) THEN 'username_exists' ELSE bad END AS bad)
  FROM first_check),
third_check AS (
  SELECT * REPLACE (CASE WHEN bad IS NULL AND document_id IS NOT NULL AND seq > min(CASE WHEN bad IS NULL THEN seq END) OVER (PARTITION BY document_id)
    THEN 'document_exists' ELSE bad END AS bad) FROM second_check),"""


def _sign_ups(v):
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    return v.table("orders").select(
        key.alias("seq"),
        F.when(key % 29 == 0, "").when(key % 3 == 0, F.concat(F.lit("user"), cust)).otherwise(F.concat(F.lit("nueva"), cust)).alias("username"),
        (key % 31 != 0).alias("has_password"), F.when(key % 37 == 0, "jefe").otherwise("employee").alias("role"),
        F.when(key % 2 == 0, "Ana").otherwise("").alias("name"), F.lit(None).cast("string").alias("shift"),
        F.when(key % 5 == 0, F.concat(F.lit("D-"), (key % 1000).cast("string"))).alias("documentId"),
        F.when(key % 5 == 1, F.concat(F.lit("D-"), (key % 1000).cast("string"))).when(key % 5 == 2, F.concat(F.lit("V-"), cust)).alias("document_id"),
        F.lit(None).cast("string").alias("jobRole"), F.lit("Operador").alias("job_role"),
    )


@query("sign_up_verdicts", sql("SELECT seq, bad AS reject FROM third_check", SIGN_UPS))
def _(v):
    return user_ops.judge_new_users(v.users(), _sign_ups(v)).select("seq", "reject")


@query("new_users", sql("""
SELECT seq, username, role, CASE WHEN name = '' THEN username ELSE name END AS name, document_id, 'Operador' AS job_role, 200 AS operator_coin_balance
FROM third_check WHERE bad IS NULL""", SIGN_UPS))
def _(v):
    return user_ops.new_users(v.users(), _sign_ups(v)).drop("shift")


@query("users_cascade", sql("""
SELECT 'users' AS part, count(*) AS n FROM users WHERE role <> 'admin'
UNION ALL SELECT 'user_machines', count(*) FROM user_machines WHERE user_id NOT IN (SELECT id FROM users WHERE role = 'admin')
UNION ALL SELECT 'employee_daily_sales', count(*) FROM sales WHERE employee_id NOT IN (SELECT id FROM users WHERE role = 'admin')
UNION ALL SELECT 'employee_daily_sale_entries', count(*) FROM entries WHERE employee_id NOT IN (SELECT id FROM users WHERE role = 'admin')
""", SALES))
def _(v):
    tables = {"users": v.users(), "user_machines": v.user_machines(), "employee_daily_sales": sales(v),
              "employee_daily_sale_entries": entries(v)}
    out = machine_ops.cascade_delete_users(tables, v.users().where("role = 'admin'").select("id"))
    return many(out.items())


# ---- data quality -----------------------------------------------------------
@query("broken_rules", sql("""
SELECT seq, concat_ws(',', CASE WHEN coins - 25 < 0 THEN 'coins_negative' END, CASE WHEN lost - 2 < 0 THEN 'lost_negative' END) AS violations
FROM sale_changes WHERE coins < 25 OR lost < 2"""))
def _(v):
    odd = v.sale_changes().withColumns({"coins": F.col("coins") - 25, "lost": F.col("lost") - 2, "returned": F.lit(None).cast("int")})
    return quality.check_rules(odd, "employee_daily_sales").select("seq", "violations")


@query("broken_user_rules", sql("SELECT id, 'role_unknown' AS violations FROM users WHERE id % 9 = 0"))
def _(v):
    odd = v.users().withColumn("role", F.when(F.col("id") % 9 == 0, "supervisor").otherwise(F.col("role")))
    return quality.check_rules(odd, "users").select("id", "violations")


SHIFTS = {**dict.fromkeys(S.REPORT_COUNTS, 60), **dict.fromkeys(S.REPORT_MONEY, 100)}


def _broken_report_sql():
    parts = [f"SELECT 'employee_{t}_reports' AS \"table\", '{c}_negative' AS rule, count(*) AS n FROM {t} WHERE {c} < {k}"
             for t in ("weekly", "daily") for c, k in SHIFTS.items()]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE n > 0"


@query("broken_report_rules", sql(_broken_report_sql(), REPORTS))
def _(v):
    """Every value rule of both report tables, on values lowered so that some of them break."""
    found = []
    for table, rows in (("employee_weekly_reports", weekly(v)), ("employee_daily_reports", daily(v))):
        low = rows.withColumns({c: F.col(c) - k for c, k in SHIFTS.items()})
        rules = quality.check_rules(low, table).select(F.explode("violations").alias("rule"))
        found.append(rules.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).select(F.lit(table).alias("table"), "rule", "n"))
    return found[0].unionByName(found[1])


@query("repeated_keys", sql("""
SELECT employee_id, machine_id, sale_date, count(*) AS n FROM sale_changes GROUP BY ALL HAVING count(*) > 1"""))
def _(v):
    return quality.check_unique(v.sale_changes(), *quality.UNIQUE["employee_daily_sales"][0])


@query("unique_users", sql("""
SELECT 'username' AS part, count(*) AS n FROM (SELECT username FROM users GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'document_id', count(*) FROM (SELECT document_id FROM users WHERE document_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1)"""))
def _(v):
    return many([(k[0], quality.check_unique(v.users(), *k)) for k in quality.UNIQUE["users"][1:]])


@query("broken_references", sql("""
SELECT 'user_machines' AS "table", 'machine_id' AS "column", machine_id AS value, count(*) AS n FROM user_machines
WHERE machine_id NOT IN (SELECT id FROM machines WHERE NOT test_mode) GROUP BY ALL
UNION ALL SELECT 'employee_daily_sales', 'machine_id', machine_id, count(*) FROM sales
WHERE machine_id NOT IN (SELECT id FROM machines WHERE NOT test_mode) GROUP BY ALL
UNION ALL SELECT 'user_machines', 'user_id', CAST(user_id AS VARCHAR), count(*) FROM user_machines
WHERE user_id NOT IN (SELECT id FROM users WHERE role <> 'admin') GROUP BY ALL
UNION ALL SELECT 'employee_daily_sales', 'employee_id', CAST(employee_id AS VARCHAR), count(*) FROM sales
WHERE employee_id NOT IN (SELECT id FROM users WHERE role <> 'admin') GROUP BY ALL""", SALES))
def _(v):
    return quality.check_all_references({
        "machines": v.machines().where("not test_mode"), "users": v.users().where("role <> 'admin'"),
        "user_machines": v.user_machines(), "employee_daily_sales": sales(v),
    })


@query("missing_values", sql("""
SELECT 'users' AS "table", 'operator_coin_balance' AS "column", count(*) AS nulls FROM users WHERE operator_coin_balance IS NULL
UNION ALL SELECT 'employee_daily_sale_entries', 'coins', count(*) FROM sale_changes WHERE entry_coins IS NULL"""))
def _(v):
    raw = v.sale_changes().withColumn("coins", F.col("entry_coins"))
    return quality.check_not_null(v.users(), "users").unionByName(
        quality.check_not_null(raw, "employee_daily_sale_entries"))


@query("filled_defaults", sql("""
SELECT id, coalesce(operator_coin_balance, 200) AS operator_coin_balance FROM users"""))
def _(v):
    return quality.fill_defaults(v.users(), "users").select("id", "operator_coin_balance")


@query("ledger_references", sql("""
SELECT 'coins' AS "table", 'event_id' AS "column", CAST(event_id AS VARCHAR) AS value, count(*) AS n FROM coins
WHERE event_id NOT IN (SELECT id FROM log WHERE NOT test AND machine_id LIKE 'Maquina%') GROUP BY ALL""", replay=True))
def _(v):
    r = replayed(v).kept()
    events = r.events().where(F.col("machine_id").startswith("Maquina"))
    return quality.check_all_references({"coins": r.coins(), "machine_events": events})


