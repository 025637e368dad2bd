"""Reading and writing of messages and domain tables."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from fichaflow import schemas as S
from fichaflow.operators import events as event_ops
from fichaflow.sources import files
from fichaflow.sources.known_ids import KnownIds

BATCH = "batch"


def read_device_events(
    spark: SparkSession, path: str, fmt: str = "json", streaming: bool = False, max_files: int | None = None
) -> DataFrame:
    """Raw messages from JSON lines or parquet, batch or stream.

    ``data`` keeps the JSON text of the payload object. ``seq`` and ``received_at`` are
    written by the collector: arrival number and arrival time (UTC).
    """
    reader = (spark.readStream if streaming else spark.read).schema(S.RAW_MESSAGES)
    if streaming and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.format(fmt).load(path)


def path_of(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One domain table; the schema is given, so nothing is inferred."""
    schema = S.TABLES[name]
    files.recover(spark, path_of(folder, name))
    return spark.read.schema(schema).parquet(path_of(folder, name)).select(*schema.names)


def load_tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, folder, name) for name in (names or S.TABLES)}


def _conform(rows: DataFrame, schema: T.StructType) -> DataFrame:
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def existing(spark: SparkSession, folder: str, name: str, schema: T.StructType | str) -> DataFrame | None:
    """A table as far as it was written; None if it never was."""
    try:
        return spark.read.schema(schema).parquet(path_of(folder, name))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


# ---- tables by local day and batch --------------------------------------------
def write_days(rows: DataFrame, folder: str, name: str, batch: str, *order: str) -> None:
    """Write a batch's rows to `local_day=…/batch=…`, sorted; the same batch again replaces its own files only.

    The rebalance hint lets AQE merge small days and split a day that holds most rows,
    so neither many small files nor one giant task comes of it.
    """
    ready = rows.withColumn(BATCH, F.lit(batch)).hint("rebalance", "local_day")
    ready = ready.sortWithinPartitions("local_day", BATCH, *order)
    writer = ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("local_day", BATCH)
    if "machine_id" in order:
        # a machine's rows lie together; where row groups overlap, Bloom filters tell them apart
        writer = writer.option("parquet.bloom.filter.enabled#machine_id", "true")
    writer.parquet(path_of(folder, name))


def days_of(rows: DataFrame) -> list:
    """Local days of a staged batch: its partition values, no column is read."""
    return [r[0] for r in rows.select("local_day").distinct().collect()]


def by_batch(spark: SparkSession, folder: str, name: str, schema: T.StructType | str, days: list) -> DataFrame | None:
    """A batch-wise table with its batches, narrowed to some days by literals, so other days are not listed for a scan."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = existing(spark, folder, name, T.StructType([*schema.fields, T.StructField(BATCH, T.StringType())]))
    return None if rows is None else rows.where(F.col("local_day").isin(days))


def event_rows(events: DataFrame) -> DataFrame:
    """Event log as stored: the payload as JSON text, all its values strings."""
    return events.withColumn("data", F.to_json("data"))


def parsed_events(stored: DataFrame) -> DataFrame:
    """Stored event log with its payload as a map again."""
    return stored.withColumn("data", F.from_json("data", "map<string,string>"))


EVENT_COUNTS = "hour timestamp_ntz, type string, n long, local_day date"
COIN_COUNTS = "machine_id string, n long, local_day date"


def append_events(events: DataFrame, folder: str, batch: str | None = None) -> None:
    """Append to the log what it does not have yet, reading only the days of these events.

    A job that is run again adds nothing; with a batch id of its own it replaces what it wrote. The log's rows lie by
    machine within a day. Counts per hour and type are kept beside it, for pages.
    """
    spark, batch = events.sparkSession, batch or uuid.uuid4().hex
    schema = S.TABLES["machine_events"]
    with files.staged(_conform(event_rows(events), schema), folder, "machine_events", "local_day") as path:
        rows = spark.read.schema(schema).parquet(path)
        days = days_of(rows)
        have = by_batch(spark, folder, "machine_events", schema, days)
        if have is not None:
            rows = rows.join(have.where(F.col(BATCH) != batch).select("local_day", "id"), ["local_day", "id"], "left_anti")
        write_days(rows, folder, "machine_events", batch, "machine_id", "timestamp")
    added = by_batch(spark, folder, "machine_events", schema, days)
    if added is None:  # nothing was ever logged
        return
    added = added.where(F.col(BATCH) == batch)
    counts = added.groupBy("local_day", F.date_trunc("hour", "timestamp").cast("timestamp_ntz").alias("hour"), "type")
    write_days(counts.agg(F.count(F.lit(1)).alias("n")), folder, "event_counts", batch, "hour")


def append_coins(coins: DataFrame, folder: str, batch: str | None = None) -> None:
    """Append to the ledger the coins it does not have yet: by machine and id, or by event where there is no id.

    Reads the days of these coins, and of all earlier ids only the buckets that may hold theirs. Counts per machine and
    day are kept beside the ledger. A batch id makes a retry replace what the batch wrote, in all three tables.
    """
    spark, batch = coins.sparkSession, batch or uuid.uuid4().hex
    schema, key = S.TABLES["coins"], ["machine_id", "unique_id"]
    index, others = KnownIds(spark, path_of(folder, "coin_ids")), F.col(BATCH) != batch
    with files.staged(_conform(coins, schema), folder, "coins", "local_day") as path:
        rows = spark.read.schema(schema).parquet(path)
        days = days_of(rows)
        named, unnamed = rows.where(F.col("unique_id").isNotNull()), rows.where(F.col("unique_id").isNull())
        firsts = named.groupBy(*key).agg(F.min("id").alias("id"))
        known = index.known(firsts.select("machine_id", F.col("unique_id").alias("uid")), others)
        if known is not None:
            firsts = firsts.join(known.withColumnRenamed("uid", "unique_id"), key, "left_anti")
        have = by_batch(spark, folder, "coins", schema, days)
        if have is not None:
            have = have.where(others)
            # a batch that stopped before its ids were remembered is found by its days
            firsts = firsts.join(have.where(F.col("unique_id").isNotNull()).select(*key), key, "left_anti")
            unnamed = unnamed.join(have.where(F.col("unique_id").isNull()).select("local_day", "event_id"), ["local_day", "event_id"], "left_anti")
        fresh = named.join(firsts.select("id"), "id", "left_semi").select(*schema.names).unionByName(unnamed.select(*schema.names))
        write_days(fresh, folder, "coins", batch, "machine_id", "timestamp")
    added = by_batch(spark, folder, "coins", schema, days)
    if added is None:
        return
    added = added.where(F.col(BATCH) == batch)
    index.add(added.select("machine_id", F.col("unique_id").alias("uid")), batch)
    counts = added.groupBy("local_day", "machine_id").agg(F.count(F.lit(1)).alias("n"))
    write_days(counts, folder, "coin_counts", batch, "machine_id")


def coin_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(machine_id, local_day, n): what the ledger holds, by the counts kept with each append."""
    rows = spark.read.schema(f"{COIN_COUNTS}, {BATCH} string").parquet(path_of(folder, "coin_counts"))
    return rows.select("machine_id", "local_day", "n")


def event_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(local_day, hour, type, n) of the log, by the counts kept with each append."""
    rows = spark.read.schema(f"{EVENT_COUNTS}, {BATCH} string").parquet(path_of(folder, "event_counts"))
    return rows.select("local_day", "hour", "type", "n")


def events_page(spark: SparkSession, folder: str, page: object = 1, page_size: object = S.DEFAULT_PAGE_SIZE,
                include_pings: bool = False, **bounds) -> tuple[DataFrame, DataFrame]:
    """A page of the stored log and its page information; ``bounds`` as in :func:`event_ops.filter_events`.

    Which days the page lies on comes from the counts kept with the log.
    """
    events = event_ops.filter_events(read_table(spark, folder, "machine_events"), include_pings=include_pings, **bounds)
    hours = event_ops.hour_counts(events, event_counts(spark, folder), *event_ops.range_bounds(**bounds), include_pings)
    return event_ops.page_events(events, page, page_size, hours), event_ops.page_info(hours, page, page_size)


# ---- current tables -------------------------------------------------------------
def write_table(rows: DataFrame, folder: str, name: str) -> None:
    """Replace a table as a whole. The new one is finished beside the old one before it takes its place.

    The rows may be read from the table itself.
    """
    with files.staged(_conform(rows, S.TABLES[name]), folder, name) as path:
        files.swap(rows.sparkSession, path, path_of(folder, name))


def upsert_days(changes: DataFrame, folder: str, name: str, key: list[str], day: str, grain: str = "day") -> None:
    """Merge changes (seq, changed_at, key, values) into a stored table with one row per key, partitioned by a day of the key.

    Only partitions of days in the changes are read and rewritten. A row keeps its first id and creation time and takes the
    values of its last change by arrival number, so changes may come in any order and more than once. The merged days
    are finished in a staging folder; until they are swapped in, the table stays as it was. ``grain="month"`` makes partitions
    of months, for tables with few rows a day; it is fixed once the table is there.
    """
    spark, schema = changes.sparkSession, S.TABLES[name]
    values = [c for c in schema.names if c not in ("id", "created_at", "updated_at", *key)]
    types = {f.name: f.dataType for f in schema.fields}
    part, of_day = (day, F.col(day)) if grain == "day" else (f"{day}_{grain}", F.trunc(F.col(day), grain))
    extra = [T.StructField("last_seq", T.LongType())] + ([] if part == day else [T.StructField(part, T.DateType())])
    new = changes.select(
        *[F.col(k).cast(types[k]).alias(k) for k in key],
        F.struct(F.col("seq").alias("id"), F.col("changed_at").alias("created_at")).alias("_first"),
        F.struct("seq", *[F.col(c).cast(types[c]).alias(c) for c in values], F.col("changed_at").alias("updated_at")).alias("_last"),
    )
    merge = lambda rows: rows.groupBy(*key).agg(F.min("_first").alias("_first"), F.max_by("_last", "_last.seq").alias("_last"))
    # staged as they come: they meet in the one shuffle that merges them with the stored rows
    with files.staged(new, folder, f"{name}-changes") as path:
        new = spark.read.schema(new.schema).parquet(path).select(*new.columns)
        touched = [r[0] for r in new.select(of_day.alias(part)).distinct().collect()]
        stored_schema = T.StructType([*schema.fields, *extra])
        have = existing(spark, folder, name, stored_schema)
        if have is not None:
            have = have.where(F.col(part).isin(touched)).select(
                *key, F.struct("id", "created_at").alias("_first"),
                F.struct(F.col("last_seq").alias("seq"), *values, "updated_at").alias("_last"))
            new = new.unionByName(have)
        merged = merge(new).select(*key, "_first.*", "_last.*").withColumnRenamed("seq", "last_seq")
        ready = merged.withColumn(part, of_day).select(*schema.names, *(f.name for f in extra))
        if have is None:  # nothing that is read is replaced
            swap_days(ready.hint("rebalance", part), path_of(folder, name), part)
            return
        with files.staged(ready, folder, name) as done:
            finished = spark.read.schema(stored_schema).parquet(done).hint("rebalance", part)
            swap_days(finished, path_of(folder, name), part)


def swap_days(rows: DataFrame, target: str, part: str) -> None:
    """Replace the partitions that the rows belong to; all others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(target)


def upsert_sales(changes: DataFrame, folder: str, grain: str = "day") -> None:
    """Stored daily sales after accepted sale changes."""
    upsert_days(changes, folder, "employee_daily_sales", ["employee_id", "machine_id", "sale_date"], "sale_date", grain)


def upsert_reports(changes: DataFrame, folder: str, grain: str = "day") -> None:
    """Stored weekly reports after valid report changes; daily reports among them are left out."""
    weekly = changes.where(~F.col("daily"))
    upsert_days(weekly, folder, "employee_weekly_reports", ["employee_id", "week_end_date"], "week_end_date", grain)
