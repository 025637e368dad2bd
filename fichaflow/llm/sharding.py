"""Sharding by balanced label propagation, with counts that differ by one at most.

Documents with equal texts are linked. Each document starts in a shard by the hash of its id. In each round every linked
document moves to the shard where most of its group is, as far as that shard has room for linked documents. As
documents of a group are alike, a round works on counts per group and shard: votes are a grouped maximum, moves a join
of the counts with the votes. Moves beyond a shard's room wait, in the order of a running total; a group larger than
a shard fills one and goes on with the next. When nothing moves, or no room is left to move into, groups that are still cut are
lifted out of all shards and laid one after the other into the room this leaves, so that only an edge of a shard cuts a group;
those few are packed by size. Documents without links fill what is left of each quota, so every shard ends with its quota of rows.

Positions among rows are running totals in two levels: the rows of a group are split by a hash into pieces, whose sums
are added up before the rows of a piece. So no group, shard or total is ranked in one task.

A null text counts as an empty one. Rows that repeat an id are rows of their own. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fichaflow.llm.storage import stored

SHARDS, ROUNDS = 24, 12
#: Rows that one piece of a running total holds on average, and pieces at least.
PIECE_ROWS, LEAST_PIECES = 20_000, 64


def running_total(rows: DataFrame, group: list[str], weight: Column, order: list[str], pieces: int, name: str) -> DataFrame:
    """Add the sum of the weights ahead of each row within its group. The order is arbitrary but fixed; `order` must tell rows apart."""
    piece = F.pmod(F.xxhash64(F.lit("piece"), *order), F.lit(pieces)).cast("int")
    rows = rows.withColumns({"_piece": piece, "_weight": weight.cast("long")})
    sums = rows.groupBy(*group, "_piece").agg(F.sum("_weight").alias("_sum"))
    ahead = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, "_piece", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy(*group, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.coalesce(F.sum("_weight").over(within), F.lit(0)))
    return rows.join(sums, [*group, "_piece"]).withColumn(name, F.col("_ahead") + F.col("_own")).drop("_piece", "_weight", "_ahead", "_own")


def quotas(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def _pick(values: list, at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), at + 1)


def propagate(counts: DataFrame, quota: list[int], pieces: int, rounds: int = ROUNDS) -> DataFrame:
    """Move the rows of (key, shard, n) until no group gains; the rows of a shard never exceed its quota."""
    shards = len(quota)
    for _ in range(rounds):
        load = {r["shard"]: r["n"] for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = [max(0, q - load.get(k, 0)) for k, q in enumerate(quota)]
        open_ = [k for k in range(shards) if room[k]]
        best = counts.filter(F.col("shard").isin(open_)).groupBy("key").agg(
            F.max(F.struct("n", (-F.col("shard")).alias("back"))).alias("best"))
        wish = counts.join(best, "key").select(
            "key", "shard", "n", (-F.col("best.back")).alias("target"), F.col("best.n").alias("votes")).filter(
            "shard <> target and (votes > n or votes = n and target < shard)")
        wish = running_total(wish, ["target"], F.col("n"), ["key", "shard"], pieces, "ahead")
        go = F.greatest(F.lit(0), F.least("n", _pick(room, F.col("target")) - F.col("ahead"))).alias("go")
        moves = stored(wish.select("key", "shard", "target", go).filter("go > 0"), "moves")
        if not moves.limit(1).count():
            break
        changes = counts.union(moves.select("key", "shard", -F.col("go"))).union(moves.select("key", "target", "go"))
        counts = stored(changes.groupBy("key", "shard").agg(F.sum("n").alias("n")).filter("n > 0"), "counts")
    return counts


def settle(counts: DataFrame, quota: list[int], pieces: int) -> DataFrame:
    """Place the groups that (key, shard, n) cut anew; afterwards fewer groups than shards are cut, none where room is left for it."""
    shards, few = len(quota), False
    while not few:
        split = stored(counts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("n").alias("n")).filter("parts > 1"), "split")
        few = split.count() <= 4 * shards
        whole = counts.join(split.select("key"), "key", "left_anti").select("key", "shard", "n")
        load = {r["shard"]: r["n"] for r in whole.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = [q - load.get(k, 0) for k, q in enumerate(quota)]
        if few:
            groups = split.collect()
            packed = _packed([(r["key"], r["n"]) for r in groups], room)
            if len(packed) >= sum(r["parts"] for r in groups):
                break
            laid = counts.sparkSession.createDataFrame(packed, "key binary, shard int, n long")
        else:
            laid = _deal(running_total(split.withColumn("all", F.lit(0)), ["all"], F.col("n"), ["key"], pieces, "ahead"), room)
        counts = stored(whole.union(laid), "counts")
    return counts


def _packed(groups: list[tuple[bytes, int]], room: list[int]) -> list[tuple[bytes, int, int]]:
    """(key, shard, n): the larger groups first, each in the smallest room that holds it, or else in the largest ones."""
    room, out = list(room), []
    for key, n in sorted(groups, key=lambda g: (-g[1], bytes(g[0]))):
        while n:
            fits = [k for k, r in enumerate(room) if r >= n]
            k = min(fits, key=lambda k: room[k]) if fits else max(range(len(room)), key=lambda k: room[k])
            part = min(n, room[k])
            out.append((key, k, part))
            room[k] -= part
            n -= part
    return out


def _deal(rows: DataFrame, room: list[int]) -> DataFrame:
    """(key, shard, n): rows of (key, n, ahead) laid one after the other into the room of the shards."""
    free, stop = [], 0
    for k, r in enumerate(room):
        free.append((k, stop, stop + r))
        stop += r
    part = lambda b, e: F.greatest(F.lit(0), F.least(F.col("ahead") + F.col("n"), F.lit(e)) - F.greatest("ahead", F.lit(b)))
    parts = F.array(*(F.struct(F.lit(k).alias("shard"), part(b, e).alias("n")) for k, b, e in free))
    return rows.select("key", F.explode(F.filter(parts, lambda x: x["n"] > 0)).alias("x")).select("key", "x.shard", "x.n")


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of all documents; slots count from 0 without gaps."""
    full = F.coalesce(F.col(text), F.lit(""))
    nodes = stored(docs.select(
        F.col(key).alias("id"), (F.octet_length(full).cast("long") + 8).alias("size"), F.crc32(full).alias("text_crc32"),
        F.unhex(F.md5(full)).alias("key"), F.monotonically_increasing_id().alias("row")), "nodes")
    total = nodes.count()
    quota, pieces = quotas(total, shards), max(LEAST_PIECES, total // PIECE_ROWS)

    start = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    counts = nodes.groupBy("key", start.alias("shard")).agg(F.count("*").alias("n"))
    linked = counts.groupBy("key").agg(F.sum("n").alias("members")).filter("members > 1")
    begin = stored(_within(counts.join(linked.select("key"), "key"), quota, pieces), "counts")
    final = settle(propagate(begin, quota, pieces, rounds), quota, pieces)

    # members of a group take its places in the order of a running total
    ahead = Window.partitionBy("key").orderBy("shard")
    places = final.withColumn("stop", F.sum("n").over(ahead)).select("key", "shard", (F.col("stop") - F.col("n")).alias("begin"), "stop")
    keys = final.select("key").distinct()
    members = running_total(nodes.join(keys, "key", "left_semi"), ["key"], F.lit(1), ["row"], pieces, "at")
    placed = members.join(places, "key").filter("at >= begin and at < stop").select("id", "size", "text_crc32", "row", "shard")

    load = {r["shard"]: r["n"] for r in final.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    single = running_total(nodes.join(keys, "key", "left_anti").withColumn("all", F.lit(0)), ["all"], F.lit(1), ["row"], pieces, "at")
    shard, stop = F.lit(None), 0
    for k in range(shards):
        stop += quota[k] - load.get(k, 0)
        shard = F.coalesce(shard, F.when(F.col("at") < stop, k))
    alone = single.select("id", "size", "text_crc32", "row", shard.cast("int").alias("shard"))
    return running_total(stored(placed.union(alone), "placed"), ["shard"], F.lit(1), ["row"], pieces, "slot").drop("row")


def _within(counts: DataFrame, quota: list[int], pieces: int) -> DataFrame:
    """Starting counts with what exceeds a shard's quota moved on to shards with room, as far as hashing was uneven."""
    load = {r["shard"]: r["n"] for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    over = {k: load.get(k, 0) - q for k, q in enumerate(quota) if load.get(k, 0) > q}
    if not over:
        return counts
    limit = _pick(quota, F.col("shard"))
    counts = running_total(counts, ["shard"], F.col("n"), ["key"], pieces, "ahead")
    stay = F.greatest(F.lit(0), F.least("n", limit - F.col("ahead")))
    counts = stored(counts.select("key", "shard", "n", stay.alias("stay")), "uneven")
    spare = counts.filter("n > stay").select("key", F.col("shard").alias("old"), (F.col("n") - F.col("stay")).alias("n"), F.lit(0).alias("all"))
    spare = running_total(spare, ["all"], F.col("n"), ["key", "old"], pieces, "ahead")
    moved = _deal(spare, [max(0, q - load.get(k, 0)) for k, q in enumerate(quota)])
    return counts.select("key", "shard", F.col("stay").alias("n")).union(moved).groupBy("key", "shard").agg(F.sum("n").alias("n")).filter("n > 0")
