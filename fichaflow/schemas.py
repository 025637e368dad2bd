"""Table schemas and fixed values.

All instants are ``TIMESTAMP_NTZ`` holding UTC wall-clock time, so no result
depends on the session zone.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values -----------------------------------------------------------
LOCAL_ZONE = "America/Caracas"      # zone of day bucketing
DEVICE_OFFSET_HOURS = 4             # naive device times are UTC-4
COIN_DEDUP_MS = 3_000
HEARTBEAT_TIMEOUT_MS = 60_000       # sweep
STATUS_TIMEOUT_MS = 120_000         # status query
SWEEP_INTERVAL_MS = 60_000
MISSED_PINGS_THRESHOLD = 1
INITIAL_OPERATOR_COINS = 200
DEFAULT_PAGE_SIZE = 20
MAX_PAGE_SIZE = 1_000
USAGE_RATE = 45.5

DEVICE_ALIASES = {"ENCENDIDO": "machine_on", "APAGADO": "machine_off", "MONEDA": "coin_inserted"}
EVENT_TYPES = ("coin_inserted", "machine_on", "machine_off", "game_start", "game_end", "ping")
ROLES = ("admin", "employee")
MACHINE_STATUSES = ("active", "inactive", "maintenance")
DEFAULT_COIN_VALUES = {"boxeo": 1, "agilidad": 1, "default": 2}
# -----------------------------------------------------------------------------

MONEY = T.DecimalType(12, 2)
COIN_VALUE = T.DecimalType(18, 6)
REPORT_COUNTS = (
    "boxeo_coins", "boxeo_lost", "boxeo_returned",
    "agilidad_coins", "agilidad_lost", "agilidad_returned", "remaining_coins",
)
REPORT_MONEY = ("pago_movil", "dolares", "bolivares", "premio", "total")


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


_S, _I, _L, _TS, _D, _B = (
    T.StringType(), T.IntegerType(), T.LongType(), T.TimestampNTZType(), T.DateType(), T.BooleanType(),
)

RAW_MESSAGES = _table(
    ("seq", _L), ("received_at", _TS), ("machineId", _S), ("maquina_id", _S), ("event", _S),
    ("evento", _S), ("timestamp", _S), ("data", _S), ("cantidad", _S), ("id_unico", _S), ("idUnique", _S),
)
USERS = _table(
    ("id", _L), ("username", _S), ("role", _S), ("name", _S), ("shift", _S), ("document_id", _S),
    ("job_role", _S), ("operator_coin_balance", _I),
)
MACHINES = _table(
    ("id", _S), ("name", _S), ("status", _S), ("location", _S), ("last_ping", _TS),
    ("test_mode", _B), ("type", _S),
)
MACHINE_EVENTS = _table(
    ("id", _L), ("machine_id", _S), ("type", _S), ("timestamp", _TS), ("data", _S), ("local_day", _D),
)
COINS = _table(
    ("id", _L), ("machine_id", _S), ("timestamp", _TS), ("event_id", _L), ("unique_id", _S), ("local_day", _D),
)
COIN_VALUES = _table(("type", _S), ("value", COIN_VALUE), ("updated_at", _TS))
USER_MACHINES = _table(("user_id", _L), ("machine_id", _S))
DAILY_SALES = _table(
    ("id", _L), ("employee_id", _L), ("machine_id", _S), ("sale_date", _D), ("coins", _I),
    ("record_message", _S), ("prize_bs", MONEY), ("lost", _I), ("returned", _I),
    ("created_at", _TS), ("updated_at", _TS),
)
SALE_ENTRIES = T.StructType([f for f in DAILY_SALES if f.name != "updated_at"])
WEEKLY_REPORTS = _table(
    ("id", _L), ("employee_id", _L), ("week_end_date", _D), *[(c, _I) for c in REPORT_COUNTS],
    *[(c, MONEY) for c in REPORT_MONEY], ("created_at", _TS), ("updated_at", _TS),
)
DAILY_REPORTS = _table(
    ("id", _L), ("employee_id", _L), ("report_date", _D), *[(c, _I) for c in REPORT_COUNTS],
    *[(c, MONEY) for c in REPORT_MONEY], ("created_at", _TS),
)
SUBSCRIPTIONS = _table(("endpoint", _S), ("subscription", _S))

TABLES = {
    "users": USERS,
    "machines": MACHINES,
    "machine_events": MACHINE_EVENTS,
    "coins": COINS,
    "coin_values": COIN_VALUES,
    "user_machines": USER_MACHINES,
    "employee_daily_sales": DAILY_SALES,
    "employee_daily_sale_entries": SALE_ENTRIES,
    "employee_weekly_reports": WEEKLY_REPORTS,
    "employee_daily_reports": DAILY_REPORTS,
    "push_subscriptions": SUBSCRIPTIONS,
}
