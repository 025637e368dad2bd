"""Machine id prefixes and type keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fichaflow.functions.values import strip

BOXEO_PREFIX = "Maquina_Boxeo_"
AGILIDAD_PREFIX = "Maquina_Agilidad_"


def type_from_label(label: Column) -> Column:
    key = F.lower(strip(F.coalesce(label, F.lit(""))))
    return (
        F.when(key.startswith("box"), "boxeo").when(key.startswith("agi"), "agilidad").otherwise("default")
    )


def type_from_id(machine_id: Column) -> Column:
    mid = F.coalesce(machine_id, F.lit(""))
    return (
        F.when(F.contains(mid, F.lit(BOXEO_PREFIX)), "boxeo")
        .when(F.contains(mid, F.lit(AGILIDAD_PREFIX)), "agilidad")
        .otherwise("default")
    )


def type_from_name(name: Column) -> Column:
    text = F.lower(F.coalesce(name, F.lit("")))
    return (
        F.when(F.contains(text, F.lit("boxeo")), "boxeo")
        .when(F.contains(text, F.lit("agilidad")), "agilidad")
        .otherwise("default")
    )


def classify(label: Column, machine_id: Column, name: Column, faithful: bool = True) -> Column:
    """Explicit label first, else the id. ``faithful=False`` also tries the name."""
    by_id = type_from_id(machine_id)
    if not faithful:
        by_id = F.when(by_id == "default", type_from_name(name)).otherwise(by_id)
    return F.when(strip(F.coalesce(label, F.lit(""))) != "", type_from_label(label)).otherwise(by_id)


def numbered_id(prefix: Column, n: Column) -> Column:
    """Prefix plus the number padded to two digits and never cut."""
    text = n.cast("string")
    return F.concat(prefix, F.lpad(text, F.greatest(F.lit(2), F.length(text)), F.lit("0")))
