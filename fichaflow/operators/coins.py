"""Coin counts, coin values and revenue."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fichaflow import schemas as S
from fichaflow.functions.times import between_days, local_day, parse_bound, parse_upper_bound
from fichaflow.functions.values import number, strip


def coin_number(coins: DataFrame):
    """Coins in a group: ledger rows, or the sum of counts kept per machine and day (column ``n``)."""
    return F.sum("n") if "n" in coins.columns else F.count(F.lit(1))


def daily_income(
    coins: DataFrame, machine_id: str | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Ledger rows per machine and local day, oldest first; days without coins are absent.

    ``coins`` is the ledger or its kept counts, as in the functions below; with counts no ledger row is read.

    Bounds are a day or a month; anything else is no bound. They filter the stored
    ``local_day``, which partitions the ledger.
    """
    if "local_day" not in coins.columns:
        coins = coins.withColumn("local_day", local_day(F.col("timestamp")))
    if machine_id is not None:
        coins = coins.where(F.col("machine_id") == machine_id)
    cond = between_days(F.col("local_day"), parse_bound(start), parse_upper_bound(end))
    if cond is not None:
        coins = coins.where(cond)
    counted = coins.groupBy("machine_id", F.col("local_day").alias("date")).agg(coin_number(coins).alias("income"))
    return counted.orderBy("machine_id", "date")


def coins_by_machine(coins: DataFrame) -> DataFrame:
    return coins.groupBy("machine_id").agg(coin_number(coins).alias("total_coins"))


def total_coins(coins: DataFrame) -> DataFrame:
    return coins.agg(F.coalesce(coin_number(coins), F.lit(0)).alias("total_coins"))


def valid_coin_values(changes: DataFrame) -> DataFrame:
    """Changes with a usable key and a positive value; key trimmed and lower-cased."""
    keyed = changes.withColumns({
        "type": F.lower(strip(F.col("type"))), "value": number(F.col("value").cast("string")).try_cast(S.COIN_VALUE),
    })
    return keyed.where((F.col("type") != "") & (F.col("value") > 0))


def coin_value_upsert(changes: DataFrame) -> DataFrame:
    """Current value per type: the last valid change."""
    latest = valid_coin_values(changes).groupBy("type").agg(
        F.max_by(F.struct("value", F.col("changed_at").alias("updated_at")), "seq").alias("_last")
    )
    return latest.select("type", "_last.*")


def coin_value_map(values: DataFrame) -> DataFrame:
    """One row with the map of finite values, ordered by type. One entry per configured type."""
    usable = values.where(F.col("value").isNotNull()).withColumn("value", F.col("value").cast("double"))
    entries = F.array_sort(F.collect_list(F.struct("type", "value")))
    return usable.agg(F.map_from_entries(entries).alias("coin_values"))


def coin_revenue(coins: DataFrame, machines: DataFrame, values: DataFrame) -> DataFrame:
    """Coins and their value per machine; a type without a value takes the default one.

    Coins are counted before any join, so a hot machine is one row by then.
    """
    counted = coins_by_machine(coins)
    typed = counted.join(machines.select(F.col("id").alias("machine_id"), "type"), "machine_id")
    priced = values.select("type", "value")
    fallback = priced.where(F.col("type") == "default").agg(F.max("value")).scalar()
    joined = typed.join(priced, "type", "left")
    value = F.coalesce(F.col("value"), fallback, F.lit(S.DEFAULT_COIN_VALUES["default"]).cast(S.COIN_VALUE))
    return joined.select(
        "machine_id", "type", "total_coins",
        (F.col("total_coins").cast("decimal(18,0)") * value).alias("revenue"),
    )


def default_coin_values(spark) -> DataFrame:
    return spark.createDataFrame(list(S.DEFAULT_COIN_VALUES.items()), "type string, value int").select(
        "type", F.col("value").cast(S.COIN_VALUE).alias("value")
    )
