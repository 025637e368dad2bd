"""Event normalisation: aliases, registry lookup, vocabulary, payload, device time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fichaflow import schemas as S
from fichaflow.functions.times import device_time, micros, to_millis
from fichaflow.functions.values import first_truthy, json_map, let, map_put, truthy_id

MISSING_FIELD, UNKNOWN_MACHINE, LATE = "missing_field", "unknown_machine", "late"


def merge_aliases(messages: DataFrame) -> DataFrame:
    """machineId or maquina_id, event or evento; an empty string falls through."""
    return messages.withColumns({
        "machine_id": first_truthy(F.col("machineId"), F.col("maquina_id")),
        "raw_event": first_truthy(F.col("event"), F.col("evento")),
    })


def map_event(raw: Column) -> Column:
    """Device vocabulary to event types; anything unknown is a ping."""
    out = F.when(raw.isin(*S.EVENT_TYPES), raw)
    for alias, event_type in S.DEVICE_ALIASES.items():
        out = out.when(raw == alias, F.lit(event_type))
    return out.otherwise(F.lit("ping"))


def unique_id(messages: DataFrame) -> Column:
    """First usable id of the message, top level before payload."""
    data = F.col("data")
    return F.coalesce(
        truthy_id(F.col("id_unico")),
        truthy_id(F.col("idUnique")),
        truthy_id(F.get_json_object(data, "$.id_unico")),
        truthy_id(F.get_json_object(data, "$.idUnique")),
    )


def payload(data: Column, cantidad: Column) -> Column:
    """Payload map; its own ``cantidad`` wins, even when null, over the top-level one."""
    take_top = lambda m: cantidad.isNotNull() & ~F.map_contains_key(m, F.lit("cantidad"))
    return let(json_map(data), lambda m: F.when(take_top(m), map_put(m, "cantidad", cantidad)).otherwise(m))


def registry(machines: DataFrame) -> DataFrame:
    return machines.select(
        F.col("id").alias("machine_id"),
        F.col("status").alias("status0"),
        F.col("last_ping").alias("ping0"),
        F.coalesce("test_mode", F.lit(False)).alias("test_mode"),
    )


def normalise(messages: DataFrame, machines: DataFrame, max_delay_ms: int | None = None) -> DataFrame:
    """One row per message. Rejected ones carry ``reject``; the others are ready for replay.

    The registry carries no broadcast hint: Catalyst broadcasts it below the size
    threshold and otherwise sort-merges, where AQE splits a hot machine.
    """
    named = merge_aliases(messages)
    known = registry(machines).withColumn("_known", F.lit(True))
    joined = named.join(known, "machine_id", "left")
    missing = F.col("machine_id").isNull() | F.col("raw_event").isNull()
    received = to_millis(F.col("received_at"))
    event = map_event(F.col("raw_event"))
    ts = device_time(F.col("timestamp"), received)
    reject = F.when(missing, MISSING_FIELD).when(F.col("_known").isNull(), UNKNOWN_MACHINE)
    if max_delay_ms is not None:
        reject = reject.when(micros(received) - micros(ts) > max_delay_ms * 1000, LATE)
    return joined.select(
        "seq",
        received.alias("received_at"),
        "machine_id",
        event.alias("event"),
        ts.alias("ts"),
        F.when(event == "coin_inserted", unique_id(messages)).alias("uid"),
        F.col("data").alias("raw_data"),
        "cantidad",
        "status0",
        "ping0",
        "test_mode",
        reject.alias("reject"),
    )


def accepted(normalised: DataFrame) -> DataFrame:
    return normalised.where(F.col("reject").isNull()).drop("reject")


def rejected(normalised: DataFrame) -> DataFrame:
    return normalised.where(F.col("reject").isNotNull()).select(
        "seq", "machine_id", F.col("reject").alias("disposition")
    )


def logged_data(event: Column, suppressed: Column, uid: Column, test_mode: Column, raw: Column,
                cantidad: Column) -> Column:
    """Payload as stored: merged amount, repeat reason, test mark and coin id."""
    identified = (event == "coin_inserted") & uid.isNotNull()
    entry = lambda key, value: F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))

    def merge(m: Column) -> Column:
        reason = F.coalesce(F.nullif(F.element_at(m, "reason"), F.lit("")), F.lit("duplicate_on"))
        take_top = cantidad.isNotNull() & ~F.map_contains_key(m, F.lit("cantidad"))
        added = F.array_compact(F.array(
            F.when(take_top, entry("cantidad", cantidad)),
            F.when(suppressed, entry("reason", reason)),
            F.when(test_mode, entry("test", F.lit("true"))),
            F.when(identified, entry("id_unico", uid)),
        ))
        replaced = lambda k: (
            ((k == "reason") & suppressed) | ((k == "test") & test_mode) | ((k == "id_unico") & identified)
        )
        return F.map_concat(F.map_filter(m, lambda k, _: ~replaced(k)), F.map_from_entries(added))

    return let(json_map(raw), merge)
