"""Registered queries: every operator over the sample tables of a folder."""

from __future__ import annotations

from fichaflow.operators import coins as coin_ops
from fichaflow.plans import oracles as O
from fichaflow.plans import queries_devices, queries_people, queries_stored  # noqa: F401
from fichaflow.plans.registration import ORACLES, QUERIES, query, replayed

__all__ = ["ORACLES", "QUERIES"]


@query("daily_income", O.over(
    "SELECT machine_id, local_day AS date, count(*) AS income FROM coins GROUP BY ALL", replay=True))
def _(v):
    return coin_ops.daily_income(replayed(v).coins())
