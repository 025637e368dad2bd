"""Data-quality checks: value rules, uniqueness, references, required columns, defaults."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fichaflow import schemas as S

NON_NEGATIVE = {
    "users": ("operator_coin_balance",),
    "employee_daily_sales": ("coins", "lost", "returned"),
    "employee_weekly_reports": (*S.REPORT_COUNTS, *S.REPORT_MONEY),
    "employee_daily_reports": (*S.REPORT_COUNTS, *S.REPORT_MONEY),
}
ALLOWED = {"users": {"role": S.ROLES}, "machines": {"status": S.MACHINE_STATUSES}}
UNIQUE = {
    "users": (("id",), ("username",), ("document_id",)),
    "machines": (("id",),),
    "user_machines": (("user_id", "machine_id"),),
    "employee_daily_sales": (("employee_id", "machine_id", "sale_date"),),
    "employee_weekly_reports": (("employee_id", "week_end_date"),),
    "coin_values": (("type",),),
}
REFERENCES = (
    ("machine_events", "machine_id", "machines", "id"),
    ("coins", "machine_id", "machines", "id"),
    ("coins", "event_id", "machine_events", "id"),
    ("user_machines", "user_id", "users", "id"),
    ("user_machines", "machine_id", "machines", "id"),
    ("employee_daily_sales", "employee_id", "users", "id"),
    ("employee_daily_sales", "machine_id", "machines", "id"),
    ("employee_daily_sale_entries", "employee_id", "users", "id"),
    ("employee_daily_sale_entries", "machine_id", "machines", "id"),
    ("employee_weekly_reports", "employee_id", "users", "id"),
    ("employee_daily_reports", "employee_id", "users", "id"),
)
REQUIRED = {
    "users": ("id", "username", "role", "name", "operator_coin_balance"),
    "machines": ("id", "name", "status", "type"),
    "machine_events": ("id", "machine_id", "type", "timestamp"),
    "coins": ("id", "machine_id", "timestamp"),
    "coin_values": ("type", "value"),
    "user_machines": ("user_id", "machine_id"),
    "employee_daily_sales": ("employee_id", "machine_id", "sale_date", "coins", "lost", "returned"),
    "employee_daily_sale_entries": ("employee_id", "machine_id", "sale_date", "coins"),
    "employee_weekly_reports": ("employee_id", "week_end_date", *S.REPORT_COUNTS, *S.REPORT_MONEY),
    "employee_daily_reports": ("employee_id", "report_date", *S.REPORT_COUNTS, *S.REPORT_MONEY),
}
DEFAULTS = {
    "users": {"operator_coin_balance": S.INITIAL_OPERATOR_COINS},
    "machines": {"type": "default", "test_mode": False},
    "employee_daily_sales": dict.fromkeys(("coins", "lost", "returned"), 0),
    "employee_daily_sale_entries": {"coins": 0},
    "employee_weekly_reports": dict.fromkeys((*S.REPORT_COUNTS, *S.REPORT_MONEY), 0),
    "employee_daily_reports": dict.fromkeys((*S.REPORT_COUNTS, *S.REPORT_MONEY), 0),
}


def _rules(table: str) -> list[tuple[str, Column]]:
    rules = [(f"{c}_negative", F.col(c) < 0) for c in NON_NEGATIVE.get(table, ())]
    rules += [(f"{c}_unknown", ~F.col(c).isin(*values)) for c, values in ALLOWED.get(table, {}).items()]
    return rules


def check_rules(rows: DataFrame, table: str) -> DataFrame:
    """Rows that break a value rule, with the names of the rules. Nulls pass."""
    names = [F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in _rules(table) if name]
    return rows.withColumn("violations", F.array_compact(F.array(*names))).where(F.size("violations") > 0)


def check_unique(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once; a key with a null never does."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return rows.where(known).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def check_references(rows: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Values without a parent row, and how many rows hold each.

    Values are counted before the join, so a value held by most rows is one row there.
    """
    held = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return held.join(parents.select(F.col(key).alias("value")), "value", "left_anti")


def check_all_references(tables: dict[str, DataFrame]) -> DataFrame:
    """Every reference between the given tables, in one frame."""
    found = [
        check_references(tables[t], c, tables[p], k).select(
            F.lit(t).alias("table"), F.lit(c).alias("column"), F.col("value").cast("string").alias("value"), "n"
        )
        for t, c, p, k in REFERENCES if t in tables and p in tables
    ]
    return reduce(DataFrame.unionByName, found)


def check_not_null(rows: DataFrame, table: str) -> DataFrame:
    """Null count of every required column, one pass, one row each with any."""
    columns = [c for c in REQUIRED[table] if c in rows.columns]
    counts = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns]))
    return counts.select(pairs.alias("p")).select(F.lit(table).alias("table"), "p.*").where(F.col("nulls") > 0)


def fill_defaults(rows: DataFrame, table: str) -> DataFrame:
    """Column defaults of the table in place of nulls."""
    fills = {
        c: F.coalesce(F.col(c), F.lit(value).cast(rows.schema[c].dataType))
        for c, value in DEFAULTS.get(table, {}).items() if c in rows.columns
    }
    return rows.withColumns(fills) if fills else rows
