"""Bulk operators on the machine registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fichaflow.functions.machine_types import (
    AGILIDAD_PREFIX, BOXEO_PREFIX, classify, numbered_id, type_from_id, type_from_label,
)
from fichaflow.functions.values import nonempty
from fichaflow.operators import blocks
from fichaflow.operators.blocks import BLK

BOXEO, AGILIDAD = "Boxeo", "Agilidad"


def _prefix(group: Column) -> Column:
    return F.when(group == BOXEO, BOXEO_PREFIX).otherwise(AGILIDAD_PREFIX)


def _matching_prefix(machine_id: Column) -> Column:
    """Prefix an id counts towards; underscores match any character, as in SQL LIKE."""
    return F.when(machine_id.like(BOXEO_PREFIX + "%"), BOXEO_PREFIX).when(
        machine_id.like(AGILIDAD_PREFIX + "%"), AGILIDAD_PREFIX
    )


def _suffix(machine_id: Column) -> Column:
    return nonempty(F.regexp_extract(machine_id, r"_(\d+)$", 1)).try_cast("long")


def _number(batch: DataFrame, machines: DataFrame, block_rows: int) -> DataFrame:
    """Add ``_id``: the explicit one or prefix plus the next free number.

    In arrival order each number is one above the largest so far, explicit ones
    included: ``g + max(existing, max(e - g))`` with ``g`` the numbers given so far.
    There are two prefixes only, so a large batch is cut into blocks; a small one is one block per prefix.
    """
    rows = blocks.with_blocks(batch, "_prefix", blocks.find_hot_keys(batch, "_prefix", block_rows))
    w = Window.partitionBy("_prefix", BLK).orderBy("seq")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_g", F.count_if(F.col("_explicit").isNull()).over(so_far))
    rows = rows.withColumn("_lead", F.when(F.col("_explicit").isNotNull(), _suffix(F.col("_explicit")) - F.col("_g")))
    ahead = blocks.block_window("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    summary = rows.groupBy("_prefix", BLK).agg(F.max("_g").alias("_count"), F.max("_lead").alias("_top"))
    summary = summary.withColumn("_before", F.coalesce(F.sum("_count").over(ahead), F.lit(0)))
    summary = summary.withColumn("_top_before", F.max(F.col("_top") - F.col("_before")).over(ahead))
    existing = machines.select(_matching_prefix(F.col("id")).alias("_prefix"), _suffix(F.col("id")).alias("_n"))
    existing = existing.where(F.col("_prefix").isNotNull()).groupBy("_prefix").agg(F.max("_n").alias("_max"))
    summary = summary.join(existing, "_prefix", "left").drop("_count", "_top")
    rows = rows.join(summary, ["_prefix", BLK])
    top = F.greatest(
        F.coalesce("_max", F.lit(0)), F.col("_top_before"), F.max("_lead").over(so_far) - F.col("_before"), F.lit(0)
    )
    made = numbered_id(F.col("_prefix"), F.col("_before") + F.col("_g") + top)
    return rows.withColumn("_id", F.coalesce("_explicit", made)).drop(
        BLK, "_g", "_lead", "_before", "_top_before", "_max"
    )


def assign_sequential_ids(batch: DataFrame, machines: DataFrame, block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """Ids of new machines. ``batch``: seq, id, name, type (text columns may be null)."""
    explicit, label = nonempty(F.col("id")), nonempty(F.col("type"))
    group = F.when(F.when(label.isNotNull(), label == BOXEO).otherwise(F.col("name").startswith(BOXEO)), BOXEO).otherwise(
        AGILIDAD
    )
    keyed = batch.withColumn("_explicit", explicit).withColumn(
        "_prefix", F.when(explicit.isNotNull(), F.coalesce(_matching_prefix(explicit), F.lit(""))).otherwise(_prefix(group))
    )
    numbered = _number(keyed, machines, block_rows)
    return numbered.withColumn("id", F.col("_id")).drop("_id", "_explicit", "_prefix")


def new_machines(
    batch: DataFrame, machines: DataFrame, as_of: Column, faithful: bool = True, block_rows: int = blocks.BLOCK_ROWS
) -> DataFrame:
    """Registry rows of new machines; those without a name are left out."""
    named = batch.where(nonempty(F.col("name")).isNotNull())
    given = assign_sequential_ids(named, machines, block_rows)
    return given.select(
        "id", "name", F.lit("inactive").alias("status"),
        F.coalesce(nonempty(F.col("location")), F.lit("Unknown")).alias("location"),
        as_of.alias("last_ping"), F.lit(False).alias("test_mode"),
        classify(F.col("type"), F.col("id"), F.col("name"), faithful).alias("type"),
    )


def classify_machine_types(machines: DataFrame, faithful: bool = True) -> DataFrame:
    """Add ``type_key`` from label, id and (``faithful=False``) name."""
    return machines.withColumn("type_key", classify(F.col("type"), F.col("id"), F.col("name"), faithful))


def backfill_machine_type(machines: DataFrame) -> DataFrame:
    """Fill blank types from the id, then the name, ignoring case."""
    mid, name = F.col("id"), F.col("name")
    guess = (
        F.when(mid.ilike(BOXEO_PREFIX + "%"), "boxeo").when(mid.ilike(AGILIDAD_PREFIX + "%"), "agilidad")
        .when(name.ilike("%boxeo%"), "boxeo").when(name.ilike("%agilidad%"), "agilidad").otherwise("default")
    )
    blank = F.col("type").isNull() | (F.trim("type") == "")
    return machines.withColumn("type", F.when(blank, guess).otherwise(F.col("type")))


def _group_of_id(machine_id: Column) -> Column:
    return F.when(F.contains(machine_id, F.lit(BOXEO_PREFIX)), BOXEO).otherwise(AGILIDAD)


def _change_plan(machines: DataFrame, changes: DataFrame) -> DataFrame:
    """Registry beside its changes: ``_new_*`` values, groups and type key.

    Several changes of one id count as one after the other: the last value given stands. The
    type is inferred by each of them, so the last change decides it alone.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_new_{c}")
    new = changes.groupBy("id").agg(
        *[last(c) for c in ("name", "location", "status", "test_mode")], F.max_by("type", "seq").alias("_new_type"),
        F.max("seq").alias("seq"),
    )
    joined = machines.join(new, "id", "left").withColumn("_changed", F.col("seq").isNotNull())
    label = nonempty(F.col("_new_type"))
    old_group = _group_of_id(F.col("id"))
    name = nonempty(F.col("_new_name"))
    new_group = (
        F.when(label.isNotNull(), F.when(type_from_label(label) == "boxeo", BOXEO).otherwise(AGILIDAD))
        .when(name.isNotNull(), F.when(F.contains(F.lower(name), F.lit("boxeo")), BOXEO).otherwise(AGILIDAD))
        .otherwise(old_group)
    )
    type_key = F.when(label.isNotNull(), type_from_label(label)).otherwise(type_from_id(F.col("id")))
    return joined.withColumns({"_group": new_group, "_moves": F.col("_changed") & (new_group != old_group), "_key": type_key})


def _apply(plan: DataFrame, machine_id: Column) -> DataFrame:
    pick = lambda c: F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c)
    return plan.select(
        machine_id.alias("id"), pick("name"), pick("status"), pick("location"), "last_ping", pick("test_mode"),
        F.when(F.col("_changed"), F.col("_key")).otherwise(F.col("type")).alias("type"),
    )


def apply_machine_updates(machines: DataFrame, changes: DataFrame) -> DataFrame:
    """Partial updates: a null keeps the old value, the type is always inferred anew.

    Changes that move a machine to the other group are left to :func:`rekey_machines`.
    """
    return _apply(_change_plan(machines, changes).where(~F.col("_moves")), F.col("id")).unionByName(
        machines.join(moved_ids(machines, changes), "id", "left_semi").select(
            "id", "name", "status", "location", "last_ping", "test_mode", "type"
        )
    )


def moved_ids(machines: DataFrame, changes: DataFrame) -> DataFrame:
    return _change_plan(machines, changes).where(F.col("_moves")).select("id")


def rekey_map(machines: DataFrame, changes: DataFrame, block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """Old and new id of every machine whose group changes.

    Numbers freed by the batch itself are not given out again within it.
    """
    moves = _change_plan(machines, changes).where(F.col("_moves")).select(
        "seq", F.col("id").alias("old_id"), _prefix(F.col("_group")).alias("_prefix"),
        F.lit(None).cast("string").alias("_explicit"),
    )
    return _number(moves, machines, block_rows).select("old_id", F.col("_id").alias("new_id"))


def rekey_machines(
    tables: dict[str, DataFrame], changes: DataFrame, faithful: bool = True, block_rows: int = blocks.BLOCK_ROWS
) -> dict[str, DataFrame]:
    """Apply changes that give a machine a new id, to the registry and its dependants.

    Events and coins move along. Assignments and sales of the old id disappear, as
    they do in a cascade; ``faithful=False`` moves them too.
    """
    machines = tables["machines"]
    mapping = rekey_map(machines, changes, block_rows)
    plan = _change_plan(machines, changes).join(mapping.withColumnRenamed("old_id", "id"), "id", "left")
    out = {"machines": _apply(plan, F.coalesce("new_id", "id"))}
    renamed = mapping.withColumnRenamed("old_id", "machine_id")
    for name in ("machine_events", "coins", *DEPENDANTS):
        if name not in tables:
            continue
        if name in DEPENDANTS and faithful:
            out[name] = tables[name].join(renamed, "machine_id", "left_anti")
        else:
            moved = tables[name].join(renamed, "machine_id", "left")
            moved = moved.withColumn("machine_id", F.coalesce("new_id", "machine_id")).drop("new_id")
            out[name] = moved.select(*tables[name].columns)
    return out


DEPENDANTS = ("user_machines", "employee_daily_sales", "employee_daily_sale_entries")
MACHINE_CASCADE = ("machine_events", "coins", *DEPENDANTS)
USER_CASCADE = {
    "user_machines": "user_id", "employee_daily_sales": "employee_id", "employee_daily_sale_entries": "employee_id",
    "employee_weekly_reports": "employee_id", "employee_daily_reports": "employee_id",
}


def cascade_delete_machines(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Remove machines (``ids.id``) and everything that refers to them."""
    gone = ids.select(F.col("id").alias("machine_id"))
    out = dict(tables)
    out["machines"] = tables["machines"].join(ids.select("id"), "id", "left_anti")
    for name in MACHINE_CASCADE:
        if name in tables:
            out[name] = tables[name].join(gone, "machine_id", "left_anti")
    return out


def cascade_delete_users(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    out = dict(tables)
    out["users"] = tables["users"].join(ids.select("id"), "id", "left_anti")
    for name, key in USER_CASCADE.items():
        if name in tables:
            out[name] = tables[name].join(ids.select(F.col("id").alias(key)), key, "left_anti")
    return out


def delete_events(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Remove events; their coins stay, without the event."""
    gone = ids.select(F.col("id").alias("event_id"), F.lit(True).alias("_gone"))
    coins = tables["coins"].join(gone, "event_id", "left")
    coins = coins.withColumn("event_id", F.when(F.col("_gone").isNull(), F.col("event_id"))).drop("_gone")
    return {
        **tables,
        "machine_events": tables["machine_events"].join(ids.select("id"), "id", "left_anti"),
        "coins": coins.select(*tables["coins"].columns),
    }


