"""Employee daily sales, sale entries, coin balances and scoped listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from fichaflow import schemas as S
from fichaflow.functions.roles import acts_as_supervisor, is_operator, not_listed_as_supervisor
from fichaflow.functions.times import between_days
from fichaflow.functions.values import computed_once, is_ymd, money_non_negative, number, present, whole_non_negative
from fichaflow.operators import blocks
from fichaflow.operators.blocks import BLK, checkpoint, find_hot_keys, with_blocks

SALE_KEY = ("employee_id", "machine_id", "sale_date")


# ---- validation and write scope ---------------------------------------------
def validate_sales(payloads: DataFrame) -> DataFrame:
    """Typed values and ``reject`` (null when valid) of sale payloads given as text.

    Blank coins count as 0 and missing ones are rejected; an amount given as null or
    empty is rejected when the field itself was sent (``has_entry_coins``). Fractional
    coins do not fit the stored integer and are rejected too.
    """
    coins = F.when(F.col("coins") == "", F.lit(0.0)).otherwise(number(F.col("coins")))
    optional = lambda c: F.when(present(F.col(c)), whole_non_negative(F.col(c))).otherwise(F.lit(0))
    typed = computed_once(payloads, {
        "_coins": coins,
        "prize": money_non_negative(F.col("prize_bs")),
        "prize_given": present(F.col("prize_bs")),
        "lost": optional("lost"),
        "returned": optional("returned"),
        "entry_coins": whole_non_negative(F.col("entry_coins")),
        "sale_date": F.when(is_ymd(F.col("date")), F.col("date").try_cast("date")),
    })
    whole = F.col("_coins").try_cast("int")
    reject = (
        F.when(
            ~present(F.col("machine_id")) | F.col("sale_date").isNull() | ~F.coalesce(F.col("_coins") >= 0, F.lit(False)),
            "invalid_payload",
        )
        .when(F.coalesce(whole != F.col("_coins"), F.lit(True)), "fractional_coins")
        .when(F.col("prize_given") & F.col("prize").isNull(), "invalid_prize")
        .when(F.col("lost").isNull() | F.col("returned").isNull(), "invalid_lost_returned")
        .when(F.col("has_entry_coins") & F.col("entry_coins").isNull(), "invalid_entry_coins")
    )
    return typed.withColumn("reject", reject).withColumns({
        "coins": F.when(F.col("reject").isNull(), whole), "prize_bs": F.when(F.col("reject").isNull(), F.col("prize")),
    }).drop("_coins", "prize", "prize_given", "date", "has_entry_coins")


def write_scope(rows: DataFrame, users: DataFrame, user_machines: DataFrame | None) -> DataFrame:
    """Add ``employee_id`` and ``scope_reject`` to rows with actor_id and requested_employee_id.

    An admin writes for whom it names, everyone else for itself and (when assignments
    are given) on assigned machines only.
    """
    actors = users.select(F.col("id").alias("actor_id"), F.col("role").alias("_role"))
    joined = rows.join(actors, "actor_id", "left")
    admin = F.col("_role") == "admin"
    joined = joined.withColumn(
        "employee_id", F.when(admin, F.coalesce("requested_employee_id", "actor_id")).otherwise(F.col("actor_id"))
    )
    reject = F.when(F.col("_role").isNull(), "unknown_user")
    if user_machines is not None:
        assigned = user_machines.select(
            F.col("user_id").alias("actor_id"), "machine_id", F.lit(True).alias("_assigned")
        )
        joined = joined.join(assigned, ["actor_id", "machine_id"], "left")
        reject = reject.when(~admin & F.col("_assigned").isNull(), "forbidden")
    joined = joined.withColumn("scope_reject", reject)
    return joined.drop("_role", "_assigned")


def accepted_sales(payloads: DataFrame, users: DataFrame, user_machines: DataFrame) -> DataFrame:
    """Sale changes that pass validation and scope, ready for the operators below."""
    judged = write_scope(validate_sales(payloads), users, user_machines)
    return judged.where(F.col("reject").isNull() & F.col("scope_reject").isNull()).drop(
        "reject", "scope_reject", "actor_id", "requested_employee_id"
    )


# ---- upsert, entries, balance -----------------------------------------------
def upsert_daily_sales(changes: DataFrame) -> DataFrame:
    """Current sale per employee, machine and day: last values, first creation time.

    A grouped maximum rather than a window, so repeats of one key collapse before
    the shuffle.
    """
    values = F.struct("coins", "record_message", "prize_bs", "lost", "returned", F.col("changed_at").alias("updated_at"))
    merged = changes.groupBy(*SALE_KEY).agg(
        F.min("seq").alias("id"), F.min_by("changed_at", "seq").alias("created_at"), F.max_by(values, "seq").alias("_last")
    )
    return merged.select("id", *SALE_KEY, "_last.*", "created_at")


def derive_sale_entries(changes: DataFrame) -> DataFrame:
    """Append-only log of changes that say something beyond the coin total."""
    worth = (
        F.col("entry_coins").isNotNull() | present(F.col("record_message")) | F.col("prize_bs").isNotNull()
        | (F.coalesce("lost", F.lit(0)) > 0) | (F.coalesce("returned", F.lit(0)) > 0)
    )
    return changes.where(worth).select(
        F.col("seq").alias("id"), *SALE_KEY, F.coalesce("entry_coins", F.lit(0)).alias("coins"),
        "record_message", "prize_bs", "lost", "returned", F.col("changed_at").alias("created_at"),
    )


def _movements(entries: DataFrame, resets: DataFrame) -> DataFrame:
    spent = entries.select(
        "employee_id", F.col("id").alias("seq"), F.greatest("coins", F.lit(0)).cast("long").alias("spent"),
        F.lit(0).alias("is_reset"),
    )
    back = resets.select("employee_id", "seq", F.lit(0).cast("long").alias("spent"), F.lit(1).alias("is_reset"))
    return spent.unionByName(back)


def _epoch_sums(rows: DataFrame) -> DataFrame:
    w = blocks.ordered_window("employee_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_epoch", F.sum("is_reset").over(w))
    e = Window.partitionBy("employee_id", BLK, "_epoch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_sum", F.sum("spent").over(e))


def _spent_carry(rows: DataFrame) -> DataFrame:
    """Coins spent since the last reset at the start of each block of a hot employee, from sums within blocks."""
    summary = rows.where(F.col(BLK) >= 0).groupBy("employee_id", BLK).agg(
        F.max("_epoch").alias("_resets"), F.max_by("_sum", "seq").alias("_tail")
    )
    w = blocks.block_window("employee_id")
    ahead = w.rowsBetween(Window.unboundedPreceding, -1)
    # all blocks from the last one with a reset on count towards the carry
    summary = summary.withColumn(
        "_run", F.count_if(F.col("_resets") > 0).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("_total", F.sum("_tail").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    starts = F.when(F.col("_resets") > 0, F.col("_total") - F.col("_tail"))
    base = F.coalesce(F.last(starts, ignorenulls=True).over(ahead), F.lit(0))
    return summary.select(
        "employee_id", BLK, (F.coalesce(F.lag("_total").over(w), F.lit(0)) - base).alias("_carry"),
        (F.coalesce(F.max("_resets").over(ahead), F.lit(0)) > 0).alias("_was_reset"),
    )


def operator_balance(
    entries: DataFrame, resets: DataFrame, users: DataFrame | None = None, block_rows: int = blocks.BLOCK_ROWS
) -> DataFrame:
    """Balance after every entry and reset, from the stored balance of ``users`` up to the first reset.

    Each entry takes its coins, never below zero. Between resets the balance only
    falls, so clamping the running sum once is exact.
    """
    movements = checkpoint(_movements(entries, resets))  # counted, cut into blocks and summed
    hot = find_hot_keys(movements, "employee_id", block_rows)
    rows = _epoch_sums(with_blocks(movements, "employee_id", hot))
    spent = F.col("_sum")
    if hot is not None:
        rows = checkpoint(rows)  # read for the carries and with them
        rows = rows.join(_spent_carry(rows), ["employee_id", BLK], "left")
        spent = spent + F.when(F.col("_epoch") == 0, F.coalesce("_carry", F.lit(0))).otherwise(F.lit(0))
    start = F.lit(S.INITIAL_OPERATOR_COINS)
    if users is not None:
        stored = users.select(F.col("id").alias("employee_id"), F.col("operator_coin_balance").alias("_stored"))
        rows = rows.join(stored, "employee_id", "left")
        was_reset = F.lit(False) if hot is None else F.coalesce("_was_reset", F.lit(False))
        start = F.when((F.col("_epoch") > 0) | was_reset, start).otherwise(F.coalesce("_stored", start))
    balance = F.greatest(F.lit(0), start - spent).cast("long")
    return rows.select("employee_id", "seq", (F.col("is_reset") == 1).alias("is_reset"), balance.alias("balance"))


def current_balance(users: DataFrame, entries: DataFrame, resets: DataFrame) -> DataFrame:
    """Balance of every user now; the stored one or the starting one without movements.

    Needs no running sum: only what was spent after each employee's last reset.
    """
    last = resets.groupBy("employee_id").agg(F.max("seq").alias("_reset"))
    movements = entries.select("employee_id", F.col("id").alias("seq"), "coins").where(F.col("coins") > 0)
    spent = movements.join(last, "employee_id", "left").where(
        F.col("_reset").isNull() | (F.col("seq") > F.col("_reset"))
    ).groupBy("employee_id").agg(F.sum("coins").alias("_spent"))
    joined = users.select(F.col("id").alias("employee_id"), "operator_coin_balance").join(
        last, "employee_id", "left"
    ).join(spent, "employee_id", "left")
    start = F.when(F.col("_reset").isNull(), F.coalesce("operator_coin_balance", F.lit(S.INITIAL_OPERATOR_COINS))).otherwise(
        F.lit(S.INITIAL_OPERATOR_COINS)
    )
    return joined.select(
        "employee_id", F.greatest(F.lit(0), start - F.coalesce("_spent", F.lit(0))).cast("long").alias("remaining_coins")
    )


def judge_resets(requests: DataFrame, users: DataFrame, user_machines: DataFrame) -> DataFrame:
    """Add ``reject`` to reset requests (seq, actor_id, employee_id), null when allowed."""
    actor = users.select(F.col("id").alias("actor_id"), F.col("role").alias("_arole"), F.col("job_role").alias("_ajob"))
    target = users.select(F.col("id").alias("employee_id"), F.col("role").alias("_trole"), F.col("job_role").alias("_tjob"))
    rows = requests.join(actor, "actor_id", "left").join(target, "employee_id", "left")
    admin, supervisor = F.col("_arole") == "admin", acts_as_supervisor(F.col("_ajob"))
    # machines matter only for the supervisors and operators that meet in a request
    pairs = rows.where(~admin & supervisor).select("actor_id", "employee_id").distinct()
    # from the operator's machines, which are few; a supervisor's may be all
    mine = user_machines.select(F.col("user_id").alias("actor_id"), "machine_id")
    theirs = user_machines.select(F.col("user_id").alias("employee_id"), "machine_id")
    sharing = pairs.join(theirs, "employee_id").join(mine, ["actor_id", "machine_id"], "left_semi")
    sharing = sharing.select("actor_id", "employee_id", F.lit(True).alias("_shared")).distinct()
    rows = rows.join(sharing, ["actor_id", "employee_id"], "left")
    reject = (
        F.when(F.col("_arole").isNull(), "unknown_user")
        .when(~admin & ~supervisor, "forbidden")
        .when(F.col("_trole").isNull(), "unknown_employee")
        .when((F.col("_trole") != "employee") | ~is_operator(F.col("_tjob")), "not_an_operator")
        .when(~admin & F.col("_shared").isNull(), "forbidden")
    )
    return rows.select("seq", "actor_id", "employee_id", reject.alias("reject"))


def reset_balance(requests: DataFrame, users: DataFrame, user_machines: DataFrame) -> DataFrame:
    """Allowed resets as movements for :func:`operator_balance`."""
    return judge_resets(requests, users, user_machines).where(F.col("reject").isNull()).select("seq", "employee_id")


# ---- listings ---------------------------------------------------------------
def supervised_machines(user_machines: DataFrame, user_id: int) -> DataFrame:
    return user_machines.where(F.col("user_id") == user_id).select("machine_id")


def _filtered(rows: DataFrame, start, end, machine_id, employee_id) -> DataFrame:
    """Only the filters that were given reach the plan."""
    cond = between_days(F.col("sale_date"), start, end)
    if cond is not None:
        rows = rows.where(cond)
    if machine_id is not None:
        rows = rows.where(F.col("machine_id") == machine_id)
    if employee_id is not None:
        rows = rows.where(F.col("employee_id") == employee_id)
    return rows


def _scoped_rows(rows, users, user_machines, scope, user_id, start, end, machine_id, employee_id):
    if scope == "admin":
        return _filtered(rows, start, end, machine_id, employee_id), users.where(not_listed_as_supervisor(F.col("job_role")))
    if scope == "employee":
        return _filtered(rows, start, end, machine_id, user_id), users.where(F.col("id") == user_id)
    if scope == "supervisor":
        rows = _filtered(rows, start, end, machine_id, employee_id)
        return rows.join(supervised_machines(user_machines, user_id), "machine_id", "left_semi"), users
    raise ValueError(f"unknown scope {scope!r}")


def _named(rows: DataFrame, users: DataFrame, machines: DataFrame, *machine_columns: str) -> DataFrame:
    people = users.select(
        F.col("id").alias("employee_id"), F.col("username").alias("employee_username"), F.col("name").alias("employee_name")
    )
    places = machines.select(
        F.col("id").alias("machine_id"), *[F.col(c).alias(f"machine_{c}") for c in machine_columns]
    )
    return rows.join(people, "employee_id").join(places, "machine_id")


def list_daily_sales(
    sales: DataFrame, users: DataFrame, machines: DataFrame, user_machines: DataFrame, scope: str = "admin",
    user_id: int | None = None, start: str | None = None, end: str | None = None,
    machine_id: str | None = None, employee_id: int | None = None, ordered: bool = True,
) -> DataFrame:
    """Sales with names, as an admin, one employee or one supervisor sees them.

    Admins do not see supervisors' rows; an employee sees its own, whatever employee
    is asked for; a supervisor sees its machines, supervisors' rows included.
    """
    rows, people = _scoped_rows(sales, users, user_machines, scope, user_id, start, end, machine_id, employee_id)
    out = _named(rows, people, machines, "name", "location", "type")
    return out.orderBy(F.col("sale_date").desc(), "machine_id", "employee_name", "id") if ordered else out


def list_sale_entries(
    entries: DataFrame, users: DataFrame, machines: DataFrame, user_machines: DataFrame, scope: str = "admin",
    user_id: int | None = None, start: str | None = None, end: str | None = None,
    machine_id: str | None = None, employee_id: int | None = None, ordered: bool = True,
) -> DataFrame:
    """As :func:`list_daily_sales` on entries, newest first."""
    rows, people = _scoped_rows(entries, users, user_machines, scope, user_id, start, end, machine_id, employee_id)
    out = _named(rows, people, machines, "name", "type")
    return out.orderBy(F.col("created_at").desc(), F.col("id").desc()) if ordered else out


def employee_summary(
    sales: DataFrame, users: DataFrame, machines: DataFrame, user_machines: DataFrame, scope: str = "admin",
    user_id: int | None = None, start: str | None = None, end: str | None = None,
    employee_id: int | None = None, ordered: bool = True,
) -> DataFrame:
    """Employees with their machine names and coins in the period.

    A supervisor sees the employees and sales of its own machines. Sales and
    assignments are grouped per employee before they meet.
    """
    people = users.where((F.col("role") == "employee") & not_listed_as_supervisor(F.col("job_role")))
    if employee_id is not None:
        people = people.where(F.col("id") == employee_id)
    sales = _filtered(sales, start, end, None, employee_id)
    if scope == "supervisor":
        mine = supervised_machines(user_machines, user_id)
        sales = sales.join(mine, "machine_id", "left_semi")
        user_machines = user_machines.join(mine, "machine_id", "left_semi")
        people = people.join(user_machines.select(F.col("user_id").alias("id")), "id", "left_semi")
    elif scope != "admin":
        raise ValueError(f"scope {scope!r} has no summary")
    named = user_machines.join(machines.select(F.col("id").alias("machine_id"), "name"), "machine_id", "left")
    names = named.groupBy(F.col("user_id").alias("id")).agg(
        F.array_sort(F.collect_set(F.coalesce("name", "machine_id"))).alias("machine_names")
    )
    totals = sales.groupBy(F.col("employee_id").alias("id")).agg(F.sum("coins").alias("total_coins"))
    out = people.select("id", "username", "name").join(names, "id", "left").join(totals, "id", "left").select(
        F.col("id").alias("employee_id"), F.col("username").alias("employee_username"),
        F.col("name").alias("employee_name"),
        F.coalesce("machine_names", F.array().cast("array<string>")).alias("machine_names"),
        F.coalesce("total_coins", F.lit(0)).cast("long").alias("total_coins"),
    )
    return out.orderBy(F.col("total_coins").desc(), "employee_name", "employee_id") if ordered else out


def viewer_scope(users: DataFrame) -> DataFrame:
    """Scope each user lists with: admin, supervisor or employee."""
    scope = F.when(F.col("role") == "admin", "admin").when(acts_as_supervisor(F.col("job_role")), "supervisor").otherwise(
        "employee"
    )
    return users.select("id", scope.alias("scope"), not_listed_as_supervisor(F.col("job_role")).alias("listed"),
                        is_operator(F.col("job_role")).alias("operator"))


