"""Hand-written cases per operator."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fichaflow.functions import machine_types, roles, times
from fichaflow.functions.values import number, whole_non_negative
from fichaflow.operators import alerts, coins, events, ingest, machines, quality, reports, sales, users

INGEST = dt.datetime(2024, 3, 1, 12)


def one(spark, value, fn, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(fn(F.col("v"))).first()[0]


@pytest.mark.parametrize("text,want", [
    (None, INGEST), ("  ", INGEST), ("garbage", INGEST),
    ("2024-01-05T10:00:00Z", dt.datetime(2024, 1, 5, 10)),
    ("2024-01-05T10:00:00.1239Z", dt.datetime(2024, 1, 5, 10, 0, 0, 123000)),
    ("2024-01-05T10:00:00+02:00", dt.datetime(2024, 1, 5, 8)),
    ("2024-01-05T10:00:00-0400", dt.datetime(2024, 1, 5, 14)),
    ("2024-01-05T10:00:00", dt.datetime(2024, 1, 5, 14)),
    (" 2024-01-05 10:00 ", dt.datetime(2024, 1, 5, 14)),
    ("2024-01-05", dt.datetime(2024, 1, 5, 4)),
    ("2024-02-30", dt.datetime(2024, 3, 1, 4)),
    ("2024-13-01", dt.datetime(2025, 1, 1, 4)),
    ("2024-01-01 25:61:61", dt.datetime(2024, 1, 2, 6, 2, 1)),
    ("2024-01-05T10:00:00.5", dt.datetime(2024, 1, 5, 14, 0, 0, 500000)),
    ("2024-13-01T00:00:00Z", INGEST),
    ("2010-06-01 00:00:00", dt.datetime(2010, 6, 1, 4)),
])
def test_device_time(spark, text, want):
    ingest_ts = F.lit(str(INGEST)).cast("timestamp_ntz")
    assert one(spark, text, lambda c: times.device_time(c, ingest_ts)) == want


def test_local_day_uses_the_zone_of_its_year(spark):
    cases = [(dt.datetime(2024, 1, 1, 3, 59), dt.date(2023, 12, 31)), (dt.datetime(2024, 1, 1, 4), dt.date(2024, 1, 1)),
             (dt.datetime(2010, 6, 1, 4, 29), dt.date(2010, 5, 31)), (dt.datetime(2010, 6, 1, 4, 30), dt.date(2010, 6, 1))]
    for ts, want in cases:
        assert one(spark, ts, times.local_day, "timestamp_ntz") == want


def test_day_bounds(spark):
    assert times.parse_bound("2024-02") == "2024-02-01" and times.parse_upper_bound("2024-02") == "2024-02-29"
    assert times.parse_upper_bound(" 2024-02-10 ") == "2024-02-10" and times.parse_bound("2/2024") is None
    assert times.parse_upper_bound(None) is None and times.parse_upper_bound("2023-12") == "2023-12-31"
    assert one(spark, "2023-02", times.upper_day) == dt.date(2023, 2, 28)


@pytest.mark.parametrize("text,want", [("", None), (" ", 0.0), ("1e3", 1000.0), ("NaN", None), ("1d", None), (" 7 ", 7.0), ("-.5", -0.5)])
def test_number(spark, text, want):
    assert one(spark, text, number) == want


@pytest.mark.parametrize("text,want", [("2.9", 2), ("-1", None), ("-0.5", 0), ("1e12", None), ("x", None)])
def test_whole(spark, text, want):
    assert one(spark, text, whole_non_negative) == want


def test_aliases_and_vocabulary(spark):
    rows = [("", "m1", "MONEDA", None), ("m2", "x", "", "ENCENDIDO"), (None, "", "ping", None), ("m3", None, "moneda", None)]
    df = spark.createDataFrame(rows, "machineId string, maquina_id string, event string, evento string")
    got = ingest.merge_aliases(df).select("machine_id", ingest.map_event(F.col("raw_event"))).collect()
    assert [tuple(r) for r in got] == [("m1", "coin_inserted"), ("m2", "machine_on"), (None, "ping"), ("m3", "ping")]


def test_payload_merge(spark):
    rows = [('{"cantidad": null, "a": 1}', "5"), ('{"a": 1}', "5"), (None, "5"), (None, None), ('{"cantidad": 2}', None)]
    df = spark.createDataFrame(rows, "data string, cantidad string")
    got = [r[0] for r in df.select(ingest.payload(F.col("data"), F.col("cantidad"))).collect()]
    assert got == [{"cantidad": None, "a": "1"}, {"a": "1", "cantidad": "5"}, {"cantidad": "5"}, {}, {"cantidad": "2"}]


def test_unique_id_order(spark):
    rows = [("", None, '{"idUnique": "x"}'), ("0", "b", None), (None, None, '{"id_unico": 0, "idUnique": 7}'), ("a", "b", "{}"), (None,) * 3]
    df = spark.createDataFrame(rows, "id_unico string, idUnique string, data string")
    assert [r[0] for r in df.select(ingest.unique_id(df)).collect()] == ["x", "b", "7", "a", None]


def test_logged_payload(spark):
    rows = [("ping", True, None, True, '{"reason": ""}', None), ("coin_inserted", False, "9", False, '{"id_unico": "1"}', "3"),
            ("ping", True, None, False, '{"reason": "r"}', None)]
    df = spark.createDataFrame(rows, "e string, s boolean, u string, t boolean, d string, c string")
    got = [r[0] for r in df.select(ingest.logged_data(*[F.col(c) for c in df.columns])).collect()]
    assert got == [{"reason": "duplicate_on", "test": "true"}, {"cantidad": "3", "id_unico": "9"}, {"reason": "r"}]


def test_roles_differ(spark):
    df = spark.createDataFrame([("Supervisor de turno",), ("SUPERVISOR",), ("supervisores",), (None,), (" operador ",)], "j string")
    j = F.col("j")
    got = df.select(roles.acts_as_supervisor(j), roles.not_listed_as_supervisor(j), roles.is_operator(j)).collect()
    assert [tuple(r) for r in got] == [(True, False, False), (True, False, False), (False, False, False), (False, True, False), (False, True, True)]


def test_type_names(spark):
    df = spark.createDataFrame([(" ", "X", "Boxeo 1"), ("BOXer", "X", ""), (None, "pre Maquina_Agilidad_1", "")], "t string, i string, n string")
    cols = [F.col(c) for c in df.columns]
    got = df.select(machine_types.classify(*cols), machine_types.classify(*cols, faithful=False)).collect()
    assert [tuple(r) for r in got] == [("default", "boxeo"), ("boxeo", "boxeo"), ("agilidad", "agilidad")]


def test_stats_drop_unmarked_events(spark):
    rows = [("m", "game_end", {"score": "5", "test": "false"}), ("m", "game_end", {"score": "7"}),
            ("m", "game_start", {"test": "false"}), ("m", "game_start", {"test": "true"}), ("n", "game_start", None)]
    ev = spark.createDataFrame(rows, "machine_id string, type string, data map<string,string>")
    ms = spark.createDataFrame([("m",), ("n",)], "id string")
    cs = spark.createDataFrame([("m",)], "machine_id string")
    stats = lambda f: {r.machine_id: tuple(r)[1:] for r in events.machine_stats(ms, ev, cs, f).collect()}
    assert stats(True) == {"m": (1, 5.0, 1, 45.5), "n": (0, 0.0, 0, 0.0)}
    assert stats(False) == {"m": (1, 12.0, 1, 45.5), "n": (0, 0.0, 1, 45.5)}


def test_event_filters_all_apply(spark):
    days = [dt.datetime(2024, 1, d, 4) for d in range(1, 31)]
    df = spark.createDataFrame([(i, t, "ping" if i % 2 else "x") for i, t in enumerate(days)], "id long, timestamp timestamp_ntz, type string")
    got = events.filter_events(df, dt.datetime(2024, 1, 31), "7d", "2024-01-10", "2024-01-28", include_pings=True)
    assert [r.id for r in got.orderBy("id").collect()] == [23, 24, 25, 26, 27, 28]  # a second of slack lets midnight in
    assert events.filter_events(df).count() == 15
    assert events.page_bounds("0", "5000") == (1, 1000) and events.page_bounds("x", "") == (1, 20)
    with pytest.raises(ValueError):
        events.filter_events(df, start="whenever")


def test_liveness(spark):
    now = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", "n", "active", None), ("b", "n", "active", now - dt.timedelta(seconds=119)),
                                ("c", "n", "active", now - dt.timedelta(seconds=120))], "id string, name string, status string, last_ping timestamp_ntz")
    got = events.liveness(df, F.lit(str(now)).cast("timestamp_ntz")).orderBy("id").collect()
    assert [r.connected for r in got] == [False, True, False]


def test_sale_validation(spark):
    ok = dict(seq=0, machine_id="m", date="2024-01-05", coins="5", record_message=None, prize_bs=None, lost=None, returned=None,
              entry_coins=None, has_entry_coins=False)
    cases = [({}, None), ({"coins": ""}, None), ({"coins": None}, "invalid_payload"), ({"coins": "-1"}, "invalid_payload"),
             ({"coins": "2.5"}, "fractional_coins"), ({"date": "5/1/2024"}, "invalid_payload"), ({"date": "2024-02-30"}, "invalid_payload"),
             ({"machine_id": ""}, "invalid_payload"), ({"prize_bs": "x"}, "invalid_prize"), ({"prize_bs": ""}, None),
             ({"lost": "-2"}, "invalid_lost_returned"), ({"lost": "2.9"}, None), ({"has_entry_coins": True}, "invalid_entry_coins"),
             ({"entry_coins": "", "has_entry_coins": True}, "invalid_entry_coins"), ({"entry_coins": "3", "has_entry_coins": True}, None)]
    schema = ("seq long, machine_id string, date string, coins string, record_message string, prize_bs string, lost string, "
              "returned string, entry_coins string, has_entry_coins boolean")
    names = [c.split()[0] for c in schema.split(", ")]
    rows = [tuple({**ok, **change, "seq": i}[n] for n in names) for i, (change, _) in enumerate(cases)]
    got = sales.validate_sales(spark.createDataFrame(rows, schema)).orderBy("seq").collect()
    assert [r.reject for r in got] == [want for _, want in cases]
    assert got[1].coins == 0 and got[11].lost == 2 and got[0].lost == 0


def test_upsert_keeps_first_creation(spark):
    t = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    rows = [(i, 1, "m", dt.date(2024, 1, 1), 10 + i, None, None, 0, 0, None, t[i]) for i in range(3)]
    df = spark.createDataFrame(rows, "seq long, employee_id long, machine_id string, sale_date date, coins int, record_message string, "
                                     "prize_bs decimal(12,2), lost int, returned int, entry_coins int, changed_at timestamp_ntz")
    got = sales.upsert_daily_sales(df).collect()
    assert [(r.id, r.coins, r.created_at, r.updated_at) for r in got] == [(0, 12, t[0], t[2])]
    assert sales.derive_sale_entries(df).count() == 0
    assert sales.derive_sale_entries(df.withColumn("entry_coins", F.lit(0))).count() == 3


def test_report_needs_every_value(spark):
    cols = [*reports.VALUES]
    rows = [(i, 1, "2024-01-07", kind, *vals, INGEST) for i, (kind, vals) in enumerate([
        (" DIARIO", ["1"] * 12), ("otro", ["1"] * 11 + [""]), (None, ["1.9"] + ["1"] * 11), ("x", ["-1"] + ["1"] * 11)])]
    df = spark.createDataFrame(rows, "seq long, employee_id long, week_end_date string, report_kind string, "
                                     + ", ".join(f"{c} string" for c in cols) + ", changed_at timestamp_ntz")
    got = reports.validate_reports(df).orderBy("seq").collect()
    assert [(r.reject, r.daily) for r in got] == [(None, True), ("invalid_payload", False), (None, False), ("invalid_payload", False)]
    assert got[2].boxeo_coins == 1


def test_supervisor_sees_each_report_once(spark):
    us = spark.createDataFrame([(1, "s", "S", "supervisor"), (2, "e", "E", None)], "id long, username string, name string, job_role string")
    um = spark.createDataFrame([(1, m) for m in "abc"] + [(2, m) for m in "abc"], "user_id long, machine_id string")
    rp = spark.createDataFrame([(9, 2, dt.date(2024, 1, 7))], "id long, employee_id long, week_end_date date")
    assert reports.list_weekly(rp, us, um, "supervisor", 1).count() == 1
    assert reports.list_weekly(rp, us, um, "employee", 1).count() == 0


def test_coin_values(spark):
    rows = [(0, " Boxeo", "1"), (1, "boxeo", "0"), (2, "BOXEO", "2.5"), (3, "boxeo", "x"), (4, " ", "3")]
    df = spark.createDataFrame([(*r, INGEST) for r in rows], "seq long, type string, value string, changed_at timestamp_ntz")
    values = coins.coin_value_upsert(df)
    assert [(r.type, float(r.value)) for r in values.collect()] == [("boxeo", 2.5)]
    assert coins.coin_value_map(values).first()[0] == {"boxeo": 2.5}
    ledger = spark.createDataFrame([("a",), ("a",), ("b",)], "machine_id string")
    reg = spark.createDataFrame([("a", "boxeo"), ("b", "rara")], "id string, type string")
    got = {r.machine_id: float(r.revenue) for r in coins.coin_revenue(ledger, reg, values).collect()}
    assert got == {"a": 5.0, "b": 2.0}
    assert coins.total_coins(ledger.limit(0)).first()[0] == 0


def test_subscriptions(spark):
    sub = lambda owner, keys: f'{{"endpoint":"e","keys":{keys},"__userId":{owner}}}'
    both = '{"p256dh":"p","auth":"a"}'
    rows = [("a", sub(12, both)), ("b", sub('"12"', both)), ("c", sub('"1a"', both)), ("d", sub(1, '{"p256dh":"p"}')),
            ("e", sub(1.5, both)), ("f", "not json"), ("g", sub(1, '{"p256dh":1,"auth":"a"}'))]
    df = spark.createDataFrame(rows, "endpoint string, subscription string")
    assert sorted((r.endpoint, r.user_id) for r in alerts.valid_subscriptions(df).collect()) == [("a", 12), ("b", 12)]
    feedback = spark.createDataFrame([(5, "a", 410), (6, "b", 500)], "seq long, endpoint string, status int")
    log = df.selectExpr("0L as seq", "'add' as action", "endpoint", "subscription").unionByName(alerts.gone_feedback(feedback))
    assert "a" not in [r.endpoint for r in alerts.subscriptions_current(log).collect()]


def test_deliveries(spark):
    us = spark.createDataFrame([(1, "admin"), (2, "employee"), (3, "employee")], "id long, role string")
    um = spark.createDataFrame([(1, "m"), (2, "m"), (3, "n")], "user_id long, machine_id string")
    valid = spark.createDataFrame([(f"e{i}", i) for i in (1, 2, 3)], "endpoint string, user_id long")
    al = spark.createDataFrame([(10, "m"), (11, "n"), (12, "m")], "alert_id long, machine_id string")
    counts = {r.user_id: r.alerts for r in alerts.delivery_counts(al, us, um, valid).collect()}
    assert counts == {1: 3, 2: 2, 3: 1}
    assert sorted(r.id for r in alerts.allowed_users(us, um, "m").collect()) == [1, 2]
    assert [r.alerts for r in alerts.broadcast_counts(al, valid).collect()] == [3, 3, 3]


def test_rekey_drops_or_moves_dependants(spark):
    reg = spark.createDataFrame([("Maquina_Boxeo_01", "n", "inactive", "l", INGEST, False, "boxeo")],
                                "id string, name string, status string, location string, last_ping timestamp_ntz, test_mode boolean, type string")
    ch = spark.createDataFrame([(0, "Maquina_Boxeo_01", None, None, None, "agilidad", None)],
                               "seq long, id string, name string, location string, status string, type string, test_mode boolean")
    tables = {"machines": reg, "coins": spark.createDataFrame([("Maquina_Boxeo_01", 1)], "machine_id string, id long"),
              "user_machines": spark.createDataFrame([(1, "Maquina_Boxeo_01")], "user_id long, machine_id string")}
    out = machines.rekey_machines(tables, ch)
    assert [r.id for r in out["machines"].collect()] == ["Maquina_Agilidad_01"]
    assert [r.machine_id for r in out["coins"].collect()] == ["Maquina_Agilidad_01"]
    assert out["user_machines"].count() == 0
    assert [r.machine_id for r in machines.rekey_machines(tables, ch, faithful=False)["user_machines"].collect()] == ["Maquina_Agilidad_01"]


def test_quality(spark):
    us = spark.createDataFrame([(1, "a", "boss", None, -1), (2, "a", "admin", None, None), (3, None, None, "d", 0)],
                               "id long, username string, role string, document_id string, operator_coin_balance int")
    got = {r.id: r.violations for r in quality.check_rules(us, "users").collect()}
    assert got == {1: ["operator_coin_balance_negative", "role_unknown"]}
    assert [r.n for r in quality.check_unique(us, "username").collect()] == [2]
    assert quality.check_unique(us, "document_id").count() == 0
    nulls = {r.column: r.nulls for r in quality.check_not_null(us, "users").collect()}
    assert nulls == {"username": 1, "role": 1, "operator_coin_balance": 1}
    assert [r[0] for r in quality.fill_defaults(us, "users").orderBy("id").select("operator_coin_balance").collect()] == [-1, 200, 0]
    um = spark.createDataFrame([(1, "x"), (9, "x"), (9, "y"), (None, "y")], "user_id long, machine_id string")
    assert [(r.value, r.n) for r in quality.check_references(um, "user_id", us, "id").collect()] == [(9, 2)]


def test_assignments(spark):
    um = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "user_id long, machine_id string")
    ch = spark.createDataFrame([(0, 1, ["x"], None), (1, 1, ["d", "", "d"], "z"), (2, 3, None, "e"), (3, 4, None, None)],
                               "seq long, user_id long, machine_ids array<string>, machine_id string")
    got = sorted(tuple(r) for r in users.replace_assignments(um, ch).collect())
    assert got == [(1, "d"), (2, "c"), (3, "e")]
    us = spark.createDataFrame([(1, "u", None)], "id long, username string, operator_coin_balance int").withColumns(
        {c: F.lit(None).cast("string") for c in ("role", "name", "shift", "document_id", "job_role")})
    me = users.sign_in_profile(us, um, "u").first()
    assert (me.operator_coin_balance, me.assigned_machine_id, me.assigned_machine_ids) == (200, "a", ["a", "b"])


def test_a_device_time_is_read_once(spark):
    plan = spark.range(1).select(F.lit("x").alias("t"), F.current_timestamp().cast("timestamp_ntz").alias("i")).select(
        times.device_time(F.col("t"), F.col("i")))
    text = plan._jdf.queryExecution().analyzed().toString()
    # repeated parts would be evaluated again for every rule that uses them
    assert text.count("btrim") <= 2 and text.count("regexp_extract") <= 6
