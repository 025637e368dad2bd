"""Domain tables derived from the star-schema and event tables of a folder.

They stand in for device messages, registry, users, sales and reports so that every
query runs over whole generated tables. FIXTURES.md lists the mapping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fichaflow.functions.machine_types import numbered_id, type_from_id
from fichaflow.functions.times import to_millis


# explicit schemas: no job to infer them
TABLES = {
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
}


def machine_id(key: Column) -> Column:
    return (
        F.when(key % 3 == 0, numbered_id(F.lit("Maquina_Boxeo_"), key))
        .when(key % 3 == 1, numbered_id(F.lit("Maquina_Agilidad_"), key))
        .otherwise(F.concat(F.lit("X-"), key.cast("string")))
    )


def _share(amount: Column, parts: int) -> Column:
    """Whole cents of an amount divided into parts, without rounding doubles."""
    cents = F.floor(F.round(amount * 100).cast("long") / parts)
    return (cents / 100).cast("decimal(12,2)")


class SampleViews:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{name}.parquet")

    def device_messages(self) -> DataFrame:
        e = self.table("events")
        k = F.get_json_object("props", "$.k").cast("int")
        kind = F.col("event_type")
        event = (
            F.when(kind == "signup", "ENCENDIDO").when(kind == "error", "APAGADO").when(kind == "purchase", "MONEDA")
            .when(kind == "click", "game_start").when((kind == "view") & (k % 2 == 0), "game_end").otherwise("view")
        )
        eid = F.col("event_id")
        # one message in fifty comes from a clock that is a day behind
        told = to_millis(F.col("ts")) - F.make_dt_interval(F.when(eid % 50 == 0, 1).otherwise(0))
        iso = lambda ts: F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS")
        device_time = (
            F.when(eid % 4 == 0, F.concat(iso(told), F.lit("Z")))
            .when(eid % 4 == 2, F.date_format(told - F.make_dt_interval(F.lit(0), F.lit(4)), "yyyy-MM-dd HH:mm:ss"))
            .when(eid % 4 == 3, F.concat(iso(told + F.make_dt_interval(F.lit(0), F.lit(2))), F.lit("+02:00")))
        )
        data = F.when(event == "game_end", F.concat(F.lit('{"score": '), F.col("value").cast("string"), F.lit("}"))).when(
            (event == "MONEDA") & (eid % 5 == 0), F.lit('{"cantidad": null}')
        )
        uid = F.when((kind == "purchase") & (k < 50), k.cast("string"))
        mid = machine_id(F.col("user_id"))
        return e.select(
            eid.alias("seq"),
            F.col("ts").alias("received_at"),
            F.when(eid % 2 == 0, mid).otherwise(F.lit("")).alias("machineId"),
            F.when((eid % 2 == 1) & (eid % 101 != 0), mid).alias("maquina_id"),
            F.when(eid % 3 != 0, event).alias("event"),
            F.when(eid % 3 == 0, event).alias("evento"),
            device_time.alias("timestamp"),
            data.alias("data"),
            F.col("value").cast("string").alias("cantidad"),
            F.when(eid % 2 == 0, uid).alias("id_unico"),
            F.when(eid % 2 == 1, uid).alias("idUnique"),
        )

    def machines(self) -> DataFrame:
        nation = self.table("nation").select("n_nationkey", F.col("n_name").alias("location"))
        key = F.col("s_suppkey")
        mid = machine_id(key)
        at = lambda text: F.lit(text).cast("timestamp_ntz")
        return self.table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
            mid.alias("id"),
            F.col("s_name").alias("name"),
            # before the first message: on, under repair or off; heard of some hours before, or never
            F.when(key % 4 == 1, "active").when(key % 4 == 2, "maintenance").otherwise("inactive").alias("status"),
            "location",
            F.when(key % 8 == 1, at("2023-12-31 20:00:00")).when(key % 4 == 2, at("2023-12-31 12:00:00"))
            .when(key % 8 == 3, at("2023-12-31 23:00:00")).alias("last_ping"),
            (F.col("s_suppkey") % 10 == 0).alias("test_mode"),
            type_from_id(mid).alias("type"),
        )

    def users(self) -> DataFrame:
        key = F.col("c_custkey")
        segment = F.col("c_mktsegment")
        return self.table("customer").select(
            key.alias("id"),
            F.concat(F.lit("user"), key.cast("string")).alias("username"),
            F.when(key % 50 == 0, "admin").otherwise("employee").alias("role"),
            F.col("c_name").alias("name"),
            F.when(F.col("c_nationkey") % 2 == 0, "manana").otherwise("tarde").alias("shift"),
            F.when(key % 7 != 0, F.concat(F.lit("V-"), key.cast("string"))).alias("document_id"),
            F.when(segment == "BUILDING", "Supervisor de turno").when(segment == "FURNITURE", "Supervisores")
            .when(segment == "HOUSEHOLD", F.lit(None)).otherwise("Operador").alias("job_role"),
            F.when(key % 3 == 1, (key % 150).cast("int")).alias("operator_coin_balance"),
        )

    def _order_lines(self) -> DataFrame:
        """Lines merged per (order, line number), which makes the pair unique."""
        lines = self.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(
            F.min("l_suppkey").alias("suppkey"), F.sum("l_quantity").alias("quantity"),
            F.min("l_extendedprice").alias("price"), F.min("l_discount").alias("discount"),
            F.min("l_tax").alias("tax"), F.min(F.ascii("l_returnflag")).alias("code"),
        ).withColumn("flag", F.char("code")).drop("code")
        orders = self.table("orders").select(
            "o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderpriority", "o_orderstatus"
        )
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))

    def user_machines(self) -> DataFrame:
        lines = self.table("lineitem").select("l_orderkey", "l_suppkey")
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.select(
            F.col("o_custkey").alias("user_id"), machine_id(F.col("l_suppkey")).alias("machine_id")
        ).distinct()

    def sale_changes(self) -> DataFrame:
        line = F.col("l_linenumber")
        return self._order_lines().select(
            (F.col("l_orderkey") * 8 + line).alias("seq"),
            F.col("o_custkey").alias("employee_id"),
            machine_id(F.col("suppkey")).alias("machine_id"),
            F.col("day").alias("sale_date"),
            F.col("quantity").cast("int").alias("coins"),
            F.when(F.col("flag") == "A", "record").alias("record_message"),
            F.when(F.col("discount") > 0.05, _share(F.col("price"), 100)).alias("prize_bs"),
            F.round(F.col("tax") * 100).cast("int").alias("lost"),
            F.when(F.col("flag") == "R", 1).otherwise(0).alias("returned"),
            F.when(line % 2 == 1, F.col("quantity").cast("int")).alias("entry_coins"),
            F.col("day").cast("timestamp_ntz").alias("changed_at"),
        )

    def sale_payloads(self) -> DataFrame:
        """Sale changes as unchecked text, with faults sprinkled in."""
        s = self.sale_changes()
        seq = F.col("seq")
        coins = F.col("coins").cast("string")
        return s.select(
            "seq",
            F.col("employee_id").alias("actor_id"),
            F.when(seq % 41 == 0, F.lit(None)).when(seq % 6 == 0, F.lit(7)).cast("long").alias("requested_employee_id"),
            F.when(seq % 43 == 0, "").otherwise(F.col("machine_id")).alias("machine_id"),
            F.when(seq % 47 == 0, F.date_format("sale_date", "d/M/yyyy"))
            .otherwise(F.date_format("sale_date", "yyyy-MM-dd")).alias("date"),
            F.when(seq % 53 == 0, F.lit(None)).when(seq % 59 == 0, "").when(seq % 61 == 0, F.concat(F.lit("-"), coins))
            .otherwise(coins).alias("coins"),
            "record_message",
            F.when(seq % 67 == 0, "abc").otherwise(F.col("prize_bs").cast("string")).alias("prize_bs"),
            F.when(seq % 71 == 0, "2.9").when(seq % 73 == 0, "-1").otherwise(F.col("lost").cast("string")).alias("lost"),
            F.col("returned").cast("string").alias("returned"),
            F.col("entry_coins").cast("string").alias("entry_coins"),
            (F.col("entry_coins").isNotNull() | (seq % 79 == 0)).alias("has_entry_coins"),
            "changed_at",
        )

    def balance_resets(self) -> DataFrame:
        """A reset behind each order, of its own employee or of the one with the next number."""
        other = F.when(F.col("o_orderpriority") == "1-URGENT", 0).otherwise(1)
        return self.table("orders").select(
            (F.col("o_orderkey") * 8 + 8).alias("seq"), (F.col("o_custkey") + other).alias("employee_id")
        )

    def report_payloads(self) -> DataFrame:
        """Reports as unchecked text: one per order, counts and money summed over its lines."""
        lines = self._order_lines()
        boxeo = F.col("suppkey") % 2 == 0
        text = lambda c, name: F.sum(c).cast("string").alias(name)
        count = lambda c, name: text(c.cast("long"), name)
        quantity, lost = F.col("quantity"), F.round(F.col("tax") * 100)
        returned = F.when(F.col("flag") == "R", 1).otherwise(0)
        money = lambda c: F.round(c, 2).cast("decimal(12,2)")
        price, key = F.col("price"), F.col("o_orderkey")
        per = lines.groupBy("o_orderkey", "o_custkey", "day", "o_orderstatus").agg(
            count(F.when(boxeo, quantity).otherwise(0), "boxeo_coins"),
            count(F.when(boxeo, lost).otherwise(0), "boxeo_lost"),
            count(F.when(boxeo, returned).otherwise(0), "boxeo_returned"),
            count(F.when(~boxeo, quantity).otherwise(0), "agilidad_coins"),
            count(F.when(~boxeo, lost).otherwise(0), "agilidad_lost"),
            count(F.when(~boxeo, returned).otherwise(0), "agilidad_returned"),
            count(F.col("l_linenumber"), "remaining_coins"),
            text(_share(price, 100), "pago_movil"),
            text(money(F.col("discount")), "dolares"),
            text(money(F.col("tax")), "bolivares"),
            F.when(key % 97 == 0, "").otherwise(F.sum(_share(price, 1000)).cast("string")).alias("premio"),
            text(money(price), "total"),
        )
        sunday = F.date_add("day", F.pmod(F.lit(8) - F.dayofweek("day"), F.lit(7)))
        return per.select(
            key.alias("seq"),
            F.col("o_custkey").alias("actor_id"),
            F.when(key % 5 == 0, F.lit(11)).cast("long").alias("requested_employee_id"),
            F.when(key % 89 == 0, F.date_format(sunday, "yyyyMMdd")).otherwise(F.date_format(sunday, "yyyy-MM-dd")).alias("week_end_date"),
            F.when(F.col("o_orderstatus") == "F", " Diario ").otherwise("semanal").alias("report_kind"),
            *per.columns[4:],
            F.col("day").cast("timestamp_ntz").alias("changed_at"),
        )

    def coin_value_changes(self) -> DataFrame:
        """Configuration changes: one per order, keyed by a loosely typed label."""
        key = F.col("o_orderkey")
        label = F.when(key % 4 == 0, " Boxeo").when(key % 4 == 1, "AGILIDAD ").when(
            key % 4 == 2, F.col("o_orderpriority")
        ).otherwise("")
        cents = F.round(F.col("o_totalprice") * 100).cast("long") % 1000
        return self.table("orders").select(
            key.alias("seq"), label.alias("type"),
            F.when(key % 13 == 0, F.lit("x")).otherwise(((cents - 50) / 100).cast("decimal(12,2)").cast("string")).alias("value"),
            F.col("o_orderdate").alias("changed_at"),
        )

    def subscription_changes(self) -> DataFrame:
        key = F.col("c_custkey")
        endpoint = F.concat(F.lit("https://push.example/"), (key % 1000).cast("string"))
        keys = F.when(key % 11 == 0, F.lit('{"p256dh":"p"}')).otherwise(F.lit('{"p256dh":"p","auth":"a"}'))
        owner = F.when(key % 17 == 0, F.concat(F.lit('"x'), key.cast("string"), F.lit('"'))).when(
            key % 2 == 0, key.cast("string")
        ).otherwise(F.concat(F.lit('"'), key.cast("string"), F.lit('"')))
        return self.table("customer").select(
            key.alias("seq"),
            F.when(key % 13 == 0, "remove").otherwise("add").alias("action"),
            endpoint.alias("endpoint"),
            F.concat(F.lit('{"endpoint":"'), endpoint, F.lit('","keys":'), keys, F.lit(',"__userId":'), owner, F.lit("}"))
            .alias("subscription"),
        )
