"""Bulk operators on users and machine assignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fichaflow import schemas as S
from fichaflow.functions.values import nonempty, strip

PROFILE = ("id", "username", "role", "name", "shift", "document_id", "job_role", "operator_coin_balance")


def users_with_machines(users: DataFrame, user_machines: DataFrame) -> DataFrame:
    """Users with their sorted machine ids; an empty array when there are none."""
    assigned = user_machines.groupBy(F.col("user_id").alias("id")).agg(
        F.array_sort(F.collect_list("machine_id")).alias("assigned_machine_ids")
    )
    joined = users.select(*PROFILE).join(assigned, "id", "left")
    return joined.withColumn(
        "assigned_machine_ids", F.coalesce("assigned_machine_ids", F.array().cast("array<string>"))
    )


def user_profile(users: DataFrame, user_machines: DataFrame, user_id: int) -> DataFrame:
    return users_with_machines(
        users.where(F.col("id") == user_id), user_machines.where(F.col("user_id") == user_id)
    )


def assigned_machines(users: DataFrame, user_machines: DataFrame) -> DataFrame:
    """Machine ids per user."""
    return users_with_machines(users, user_machines).select(
        F.col("id").alias("user_id"), F.col("assigned_machine_ids").alias("ids")
    )


def primary_machine(users: DataFrame, user_machines: DataFrame) -> DataFrame:
    """First machine of the sorted list, which is the smallest id: no list is built."""
    first = user_machines.groupBy(F.col("user_id").alias("id")).agg(F.min("machine_id").alias("assigned_machine_id"))
    return users.select("id").join(first, "id", "left")


def sign_in_profile(users: DataFrame, user_machines: DataFrame, username: str) -> DataFrame:
    """What a sign-in returns besides the credentials check."""
    mine = users.where(F.col("username") == username)
    full = users_with_machines(mine, user_machines)
    return full.withColumns({
        "operator_coin_balance": F.coalesce("operator_coin_balance", F.lit(S.INITIAL_OPERATOR_COINS)),
        "assigned_machine_id": F.try_element_at("assigned_machine_ids", F.lit(1)),
    })


def _listed(changes: DataFrame) -> Column:
    """Ids listed by a change: the array, or the single id when there is no array."""
    single = nonempty(F.col("machine_id"))
    one = F.when(single.isNotNull(), F.array(single)).otherwise(F.array().cast("array<string>"))
    return F.coalesce(F.col("machine_ids"), one)


def replace_assignments(user_machines: DataFrame, changes: DataFrame) -> DataFrame:
    """Drop the assignments of every listed user and insert the listed ones.

    ``changes``: seq, user_id, machine_ids, machine_id; the last change of a user counts.
    """
    last = changes.groupBy("user_id").agg(F.max_by(_listed(changes), "seq").alias("_ids"))
    kept = user_machines.join(last.select("user_id"), "user_id", "left_anti")
    added = last.select("user_id", F.explode("_ids").alias("machine_id"))
    added = added.where(nonempty(F.col("machine_id")).isNotNull()).dropDuplicates(["user_id", "machine_id"])
    return kept.select("user_id", "machine_id").unionByName(added)


def migrate_single_assignment(users: DataFrame) -> DataFrame:
    """One assignment column to the bridge table."""
    return users.where(F.col("assigned_machine_id").isNotNull()).select(
        F.col("id").alias("user_id"), F.col("assigned_machine_id").alias("machine_id")
    )


def restore_single_assignment(users: DataFrame, user_machines: DataFrame) -> DataFrame:
    """Inverse of the above: the smallest machine id per user."""
    rest = users.drop("assigned_machine_id") if "assigned_machine_id" in users.columns else users
    first = user_machines.groupBy(F.col("user_id").alias("id")).agg(F.min("machine_id").alias("assigned_machine_id"))
    return rest.join(first, "id", "left")


def remap_roles(users: DataFrame, old: str = "supervisor", new: str = "employee") -> DataFrame:
    return users.withColumn("role", F.when(F.col("role") == old, new).otherwise(F.col("role")))


def judge_profile_updates(users: DataFrame, changes: DataFrame) -> DataFrame:
    """Trimmed profile changes with ``reject``, null when they may apply.

    A new username must differ from all other users' and from one asked for earlier
    in the same batch.
    """
    c = changes.select(
        "seq", "id", strip(F.coalesce("name", F.lit(""))).alias("name"),
        strip(F.coalesce("username", F.lit(""))).alias("username"),
    )
    taken = users.select(F.col("username"), F.col("id").alias("_owner"))
    first_ask = c.where(F.col("username") != "").groupBy("username").agg(F.min("seq").alias("_first"))
    # changes without a username would all meet on the blank one
    named, unnamed = c.where(F.col("username") != ""), c.where(F.col("username") == "")
    c = named.join(taken, "username", "left").join(first_ask, "username", "left").unionByName(unnamed, allowMissingColumns=True)
    known = users.select("id", F.lit(True).alias("_known"))
    c = c.join(known, "id", "left")
    reject = (
        F.when((F.col("name") == "") & (F.col("username") == ""), "no_changes")
        .when((F.col("username") != "") & (F.length("username") < 3), "username_too_short")
        .when((F.col("name") != "") & (F.length("name") < 2), "name_too_short")
        .when(F.col("_owner").isNotNull() & (F.col("_owner") != F.col("id")), "username_exists")
        .when((F.col("username") != "") & (F.col("_first") < F.col("seq")), "username_exists")
        .when(F.col("_known").isNull(), "unknown_user")
    )
    return c.select("seq", "id", "name", "username", reject.alias("reject"))


def apply_profile_updates(users: DataFrame, changes: DataFrame) -> DataFrame:
    """Users with accepted changes applied; blank values keep the old ones, the last of several stands."""
    last = lambda c: F.max_by(c, F.when(F.col(c) != "", F.col("seq"))).alias(f"_{c}")
    ok = judge_profile_updates(users, changes).where(F.col("reject").isNull()).groupBy("id").agg(last("name"), last("username"))
    joined = users.join(ok, "id", "left")
    return joined.withColumns({
        "name": F.coalesce(nonempty(F.col("_name")), F.col("name")),
        "username": F.coalesce(nonempty(F.col("_username")), F.col("username")),
    }).select(*users.columns)


def judge_user_updates(users: DataFrame, changes: DataFrame) -> DataFrame:
    """User changes (seq, id, role, name, shift, document_id, job_role) with ``reject``, null when they may apply.

    The role defaults to employee. A document must differ from all other users' and from one that another
    user's usable change claims earlier in the batch; a document given up in the batch is free in the next one.
    """
    c = changes.select(
        "seq", "id", F.coalesce("role", F.lit("employee")).alias("role"), "name", "shift", nonempty(F.col("document_id")).alias("document_id"), "job_role")
    c = c.join(users.select("id", F.lit(True).alias("_known")), "id", "left")
    owners = users.where(F.col("document_id").isNotNull()).groupBy("document_id").agg(
        F.min("id").alias("_owner"), F.max("id").alias("_other"))
    c = _left(c, owners, "document_id")
    taken = (F.col("_owner") != F.col("id")) | (F.col("_other") != F.col("id"))
    bad = (
        F.when(~F.col("role").isin(*S.ROLES), "invalid_role").when(F.col("_known").isNull(), "unknown_user")
        .when(taken, "document_exists")
    )
    c = c.withColumn("_bad", bad)
    claims = c.where(F.col("_bad").isNull() & F.col("document_id").isNotNull()).groupBy("document_id").agg(
        F.min_by("id", "seq").alias("_claimed_by"))
    c = _left(c, claims, "document_id")
    reject = F.coalesce("_bad", F.when(F.col("_claimed_by") != F.col("id"), "document_exists"))
    return c.select("seq", "id", "role", "name", "shift", "document_id", "job_role", reject.alias("reject"))


def apply_user_updates(users: DataFrame, changes: DataFrame) -> DataFrame:
    """Full overwrite: what a change omits becomes null, and the last of several usable changes (by seq) stands."""
    new = judge_user_updates(users, changes).where(F.col("reject").isNull()).groupBy("id").agg(F.max_by(F.struct(
        *[F.col(c).alias(f"_{c}") for c in ("role", "name", "shift", "document_id", "job_role")],
    ), "seq").alias("_new")).select("id", F.lit(True).alias("_changed"), "_new.*")
    joined = users.join(new, "id", "left")
    changed = F.col("_changed").isNotNull()
    fields = ("name", "shift", "document_id", "job_role", "role")
    return joined.withColumns({
        c: F.when(changed, F.col(f"_{c}")).otherwise(F.col(c)) for c in fields
    }).select(*users.columns)


def _left(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Left join that spares rows without a key the shuffle, in which they would all meet."""
    with_key = rows.where(F.col(key).isNotNull()).join(other, key, "left")
    return with_key.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


def judge_new_users(users: DataFrame, batch: DataFrame) -> DataFrame:
    """Sign-ups with aliases merged and ``reject``, null when they may be added.

    Within the batch the first usable claim on a username or document wins.
    ``batch``: seq, username, has_password, role, name, shift, documentId,
    document_id, jobRole, job_role.
    """
    b = batch.select(
        "seq", "username", "role", F.coalesce(nonempty(F.col("name")), F.col("username")).alias("name"), "shift",
        nonempty(F.coalesce("documentId", "document_id")).alias("document_id"),
        nonempty(F.coalesce("jobRole", "job_role")).alias("job_role"), "has_password",
    )
    complete = nonempty(F.col("username")).isNotNull() & nonempty(F.col("role")).isNotNull() & F.col("has_password")
    b = b.withColumn("_bad", F.when(~complete, "missing_field").when(~F.col("role").isin(*S.ROLES), "invalid_role"))
    names = users.select("username", F.lit(True).alias("_name_taken"))
    documents = users.where(F.col("document_id").isNotNull()).select("document_id", F.lit(True).alias("_doc_taken"))
    b = _left(b.join(names, "username", "left"), documents, "document_id")
    b = b.withColumn("_bad", F.coalesce(
        "_bad", F.when(F.col("_name_taken"), "username_exists").when(F.col("_doc_taken"), "document_exists")
    ))
    # a row that loses on its username claims no document
    open_rows = b.where(F.col("_bad").isNull())
    name_first = open_rows.groupBy("username").agg(F.min("seq").alias("_name_seq"))
    b = b.join(name_first, "username", "left")
    b = b.withColumn("_bad", F.coalesce("_bad", F.when(F.col("_name_seq") < F.col("seq"), "username_exists")))
    doc_first = b.where(F.col("_bad").isNull() & F.col("document_id").isNotNull()).groupBy("document_id").agg(
        F.min("seq").alias("_doc_seq")
    )
    b = _left(b, doc_first, "document_id")
    reject = F.coalesce("_bad", F.when(F.col("_doc_seq") < F.col("seq"), "document_exists"))
    return b.select("seq", "username", "role", "name", "shift", "document_id", "job_role", reject.alias("reject"))


def new_users(users: DataFrame, batch: DataFrame) -> DataFrame:
    """Accepted sign-ups with the starting balance."""
    ok = judge_new_users(users, batch).where(F.col("reject").isNull()).drop("reject")
    return ok.withColumn("operator_coin_balance", F.lit(S.INITIAL_OPERATOR_COINS))
