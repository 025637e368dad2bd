"""Role predicates. The acting-supervisor test and the excluded-row test differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fichaflow.functions.values import strip


def _job(job_role: Column) -> Column:
    return F.lower(strip(F.coalesce(job_role, F.lit(""))))


def acts_as_supervisor(job_role: Column) -> Column:
    """Whole word 'supervisor' (so 'supervisores' does not count)."""
    return _job(job_role).rlike(r"\bsupervisor\b")


def is_operator(job_role: Column) -> Column:
    return F.contains(_job(job_role), F.lit("operador"))


def not_listed_as_supervisor(job_role: Column) -> Column:
    """Row filter of admin listings: 'supervisor' anywhere, any case, excludes."""
    return ~F.coalesce(job_role, F.lit("")).ilike("%supervisor%")
