"""Alert texts, subscriptions and who receives what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fichaflow.functions.times import local_time

ADMINS, EVERYONE = "admins", "everyone"
GONE = (404, 410)


def local_text(ts: Column) -> Column:
    """Local time as day/month/year with a twelve-hour clock."""
    local = local_time(ts)
    half = F.when(F.hour(local) < 12, " a. m.").otherwise(" p. m.")
    return F.concat(F.date_format(local, "d/M/yyyy, h:mm:ss"), half)


def build_alerts(feed: DataFrame, machines: DataFrame) -> DataFrame:
    """Title, body and amount of every alert. ``feed`` is :meth:`Replay.alert_feed`."""
    named = feed.join(machines.select(F.col("id").alias("machine_id"), "name", "location"), "machine_id", "left")
    kind, origin = F.col("type"), F.col("origin")
    name = F.coalesce("name", "machine_id")
    place = F.when(F.coalesce("location", F.lit("")) != "", F.concat(F.lit("• "), F.col("location")))
    gap_place = F.concat(name, F.lit(" "), F.coalesce(place, F.lit("")))
    reason = F.nullif(F.element_at("data", "reason"), F.lit(""))
    action = F.concat(
        F.when(kind == "machine_on", "encendida").otherwise("apagada"),
        F.lit(" ("), local_text(F.col("timestamp")), F.lit(")"),
    )
    body = (
        F.when(kind == "coin_inserted", F.trim(gap_place))
        .when(origin == "auto_on", F.concat(gap_place, F.lit(" — reconectada")))
        .when(origin == "timeout", F.concat(gap_place, F.lit(" — timeout ("), local_text(F.col("timestamp")), F.lit(")")))
        .otherwise(F.concat_ws(" ", name, place, action, F.concat(F.lit("— "), reason)))
    )
    title = (
        F.when(kind == "coin_inserted", "Moneda ingresada").when(kind == "machine_on", "Máquina encendida")
        .otherwise("Máquina apagada")
    )
    amount = F.coalesce(F.element_at("data", "cantidad").try_cast("double"), F.lit(1.0))
    return named.select(
        F.col("id").alias("alert_id"), "machine_id", kind.alias("type"), "timestamp", title.alias("title"),
        body.alias("body"), F.when(kind == "coin_inserted", amount).alias("amount"),
        F.coalesce("data", F.create_map().cast("map<string,string>")).alias("data"),
    )


def allowed_users(users: DataFrame, user_machines: DataFrame, machine_id: str) -> DataFrame:
    """Users alerted for one machine: all admins and those assigned to it."""
    assigned = user_machines.where(F.col("machine_id") == machine_id).select(F.col("user_id").alias("id"))
    scoped = users.select("id", "role")
    return scoped.where(F.col("role") == "admin").select("id").unionByName(
        scoped.join(assigned, "id", "left_semi").select("id")
    ).distinct()


def audiences(users: DataFrame, user_machines: DataFrame) -> DataFrame:
    """Allowed users of all machines without writing out admins per machine.

    An audience is ``admins`` or one machine. Admins are left out of machine
    audiences, so a machine's recipients are its audience plus ``admins``, once each.
    """
    admins = users.where(F.col("role") == "admin").select(F.col("id").alias("user_id"))
    staff = users.where(F.col("role") != "admin").select(F.col("id").alias("user_id"))
    per_machine = user_machines.join(staff, "user_id", "left_semi").select(
        F.col("machine_id").alias("audience"), "user_id"
    )
    return admins.select(F.lit(ADMINS).alias("audience"), "user_id").unionByName(per_machine.distinct())


def allowed_user_counts(users: DataFrame, user_machines: DataFrame, machines: DataFrame) -> DataFrame:
    """Number of users alerted for each machine."""
    sizes = audiences(users, user_machines).groupBy("audience").agg(F.count(F.lit(1)).alias("n"))
    admins = sizes.where(F.col("audience") == ADMINS).agg(F.coalesce(F.max("n"), F.lit(0))).scalar()
    joined = machines.select(F.col("id").alias("audience")).join(sizes, "audience", "left")
    return joined.select(
        F.col("audience").alias("machine_id"), (F.coalesce("n", F.lit(0)) + admins).cast("long").alias("users")
    )


def subscriptions_current(changes: DataFrame) -> DataFrame:
    """Subscriptions after all changes: the last per endpoint, unless it removed it.

    ``action`` is ``add``, ``remove`` or the status a delivery came back with.
    """
    last = changes.groupBy("endpoint").agg(F.max_by(F.struct("action", "subscription"), "seq").alias("_last"))
    return last.where(F.col("_last.action") == "add").select("endpoint", F.col("_last.subscription").alias("subscription"))


def gone_feedback(feedback: DataFrame) -> DataFrame:
    """Delivery results that remove a subscription, as changes."""
    return feedback.where(F.col("status").isin(*GONE)).select(
        "seq", F.lit("remove").alias("action"), "endpoint", F.lit(None).cast("string").alias("subscription")
    )


def valid_subscriptions(subscriptions: DataFrame) -> DataFrame:
    """Subscriptions with an owner and a usable endpoint and keys."""
    parsed = F.try_parse_json("subscription")
    kind = lambda path: F.schema_of_variant(F.try_variant_get("_v", path, "variant"))
    text = lambda path: F.try_variant_get("_v", path, "string")
    owner = text("$.__userId")
    owner_ok = ((kind("$.__userId") == "BIGINT") & owner.rlike("^-?[0-9]+$")) | (
        (kind("$.__userId") == "STRING") & owner.rlike("^[0-9]+$")
    )
    ok = owner_ok
    for path in ("$.endpoint", "$.keys.p256dh", "$.keys.auth"):
        ok = ok & (kind(path) == "STRING")
    return subscriptions.withColumn("_v", parsed).where(ok).select(
        "endpoint", owner.try_cast("long").alias("user_id"), "subscription"
    )


def audience_members(users: DataFrame, user_machines: DataFrame, valid: DataFrame) -> DataFrame:
    """Endpoints of every audience."""
    return audiences(users, user_machines).join(valid.select("user_id", "endpoint"), "user_id")


def delivery_counts(alerts: DataFrame, users: DataFrame, user_machines: DataFrame, valid: DataFrame) -> DataFrame:
    """Alerts each endpoint receives. Counts alerts per machine before meeting the members.

    One pass over the alerts: the total that admins receive is the sum of the machines' counts.
    """
    own = alerts.groupBy("machine_id").agg(F.count(F.lit(1)).alias("n"))
    # each machine's count once for the machine and once for the admins
    both = own.select(F.explode(F.array("machine_id", F.lit(ADMINS))).alias("audience"), "n")
    per_audience = both.groupBy("audience").agg(F.sum("n").alias("n"))
    members = audience_members(users, user_machines, valid)
    joined = members.join(per_audience, "audience")
    return joined.groupBy("endpoint", "user_id").agg(F.sum("n").alias("alerts"))


def broadcast_counts(alerts: DataFrame, valid: DataFrame) -> DataFrame:
    """Alerts each endpoint receives when every alert goes to all of them."""
    total = alerts.agg(F.count(F.lit(1))).scalar()
    return valid.select("endpoint", "user_id", total.alias("alerts"))
