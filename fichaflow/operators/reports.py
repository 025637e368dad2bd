"""Weekly and daily employee reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from fichaflow import schemas as S
from fichaflow.functions.roles import not_listed_as_supervisor
from fichaflow.functions.times import between_days
from fichaflow.functions.values import computed_once, is_ymd, money_non_negative, strip, whole_non_negative
from fichaflow.operators.sales import supervised_machines

VALUES = (*S.REPORT_COUNTS, *S.REPORT_MONEY)


def validate_reports(payloads: DataFrame) -> DataFrame:
    """Typed values and ``reject`` (null when valid); every count and amount is required."""
    typed = {c: whole_non_negative(F.col(c)) for c in S.REPORT_COUNTS}
    typed |= {c: money_non_negative(F.col(c)) for c in S.REPORT_MONEY}
    typed |= {
        "week_end_date": F.when(is_ymd(F.col("week_end_date")), F.col("week_end_date").try_cast("date")),
        "daily": is_daily(),
    }
    rows = computed_once(payloads, typed)
    incomplete = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in VALUES])
    reject = F.when(F.col("week_end_date").isNull(), "invalid_date").when(incomplete, "invalid_payload")
    return rows.withColumn("reject", reject)


def is_daily():
    """Kind 'diario', any case and padding; everything else is weekly."""
    return F.lower(strip(F.coalesce("report_kind", F.lit("")))) == "diario"


def upsert_weekly_reports(changes: DataFrame) -> DataFrame:
    """Current weekly report per employee and week: last values, first creation time."""
    values = F.struct(*VALUES, F.col("changed_at").alias("updated_at"))
    merged = changes.where(~F.col("daily")).groupBy("employee_id", "week_end_date").agg(
        F.min("seq").alias("id"), F.min_by("changed_at", "seq").alias("created_at"), F.max_by(values, "seq").alias("_last")
    )
    return merged.select("id", "employee_id", "week_end_date", "_last.*", "created_at")


def append_daily_reports(changes: DataFrame) -> DataFrame:
    """All daily reports, duplicates kept."""
    return changes.where(F.col("daily")).select(
        F.col("seq").alias("id"), "employee_id", F.col("week_end_date").alias("report_date"), *VALUES,
        F.col("changed_at").alias("created_at"),
    )


def _list(reports, date, users, user_machines, scope, user_id, start, end, employee_id) -> DataFrame:
    cond = between_days(F.col(date), start, end)
    rows = reports if cond is None else reports.where(cond)
    wanted = user_id if scope == "employee" else employee_id
    if wanted is not None:
        rows = rows.where(F.col("employee_id") == wanted)
    people = users.select(
        F.col("id").alias("employee_id"), F.col("username").alias("employee_username"),
        F.col("name").alias("employee_name"), "job_role",
    )
    if scope == "admin":
        people = people.where(not_listed_as_supervisor(F.col("job_role")))
    elif scope == "supervisor":
        # who shares a machine, once each, so no report repeats
        mine = supervised_machines(user_machines, user_id)
        sharing = user_machines.join(mine, "machine_id", "left_semi").select(F.col("user_id").alias("employee_id"))
        people = people.join(sharing, "employee_id", "left_semi")
    elif scope != "employee":
        raise ValueError(f"unknown scope {scope!r}")
    return rows.join(people.drop("job_role"), "employee_id")


def list_weekly(
    reports: DataFrame, users: DataFrame, user_machines: DataFrame, scope: str = "admin", user_id: int | None = None,
    start: str | None = None, end: str | None = None, employee_id: int | None = None, ordered: bool = True,
) -> DataFrame:
    """Weekly reports with names, latest week first; a supervisor's list goes by id."""
    out = _list(reports, "week_end_date", users, user_machines, scope, user_id, start, end, employee_id)
    if not ordered:
        return out
    return out.orderBy("id") if scope == "supervisor" else out.orderBy(F.col("week_end_date").desc(), "employee_name", "id")


def list_daily(
    reports: DataFrame, users: DataFrame, user_machines: DataFrame, scope: str = "admin", user_id: int | None = None,
    start: str | None = None, end: str | None = None, employee_id: int | None = None, ordered: bool = True,
) -> DataFrame:
    """Daily reports in the shape of weekly ones, without an update time."""
    out = _list(reports, "report_date", users, user_machines, scope, user_id, start, end, employee_id)
    out = out.withColumnRenamed("report_date", "week_end_date").withColumn(
        "updated_at", F.lit(None).cast("timestamp_ntz")
    )
    if not ordered:
        return out
    if scope == "supervisor":
        return out.orderBy("id")
    return out.orderBy(F.col("week_end_date").desc(), F.col("created_at").desc(), "employee_name", "id")
