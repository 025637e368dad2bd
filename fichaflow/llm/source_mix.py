"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources in the order of their names, nulls last, have the weights 5, 2, 1, repeating, and share all words of the corpus
by weight. A target stops at REPEATS times its source's words; what is left over is shared again by weight, until none is above.

Schedule: slot i takes the point i * golden ratio modulo 1, in 40-bit integers. The targets, added up, cut the unit interval
into one piece per source; the piece that a point falls in is the slot's source. Slots are ranked within their source. A source's
documents, shuffled by a digest, form a stream that repeats; its r-th slot takes the r-th block of equal length. The points give a
source its share of slots but for a few; ranks beyond a target are left out, and ranks that the points did not reach follow
after the last slot, source by source. So each source's words are its target, rounded, whatever the resolution.

Scale: slots are made, placed and ranked by Spark. Pieces of sources are written into each bucket of points that they cross, so a slot
finds its source by a window over its bucket, without a cross join or a broadcast of sources; a bucket holds SLOTS_A_BUCKET slots, as the
points are even. Positions in a source are running totals in two levels (pieces by digest, rows in a piece), so a source with most
rows is not ordered in one task. Equal rows (id and text) are one row with a number until the end.

A null text has no words. A null source is a source, the last one. Null and repeated ids are documents like others. Equal rows get
different takes only where a target ends within them. Results depend on ids and texts alone, so reruns agree. Empty
tables, and corpora without a word, take nothing.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from fichaflow.llm.storage import stored
from fichaflow.llm.words import WORD_PATTERN
from fichaflow.operators.blocks import number_rows

WEIGHTS, REPEATS = (5, 2, 1), 3
#: Words of a block at most, and slots that a corpus is divided into at least, where it has so many words.
BLOCK_WORDS, LEAST_SLOTS = 1024, 1 << 16
#: Points have so many bits; GOLDEN is 2**40 over the golden ratio, made odd.
BITS, GOLDEN = 40, 679_535_556_991
SLOTS_A_BUCKET, RANK_CHUNK = 1 << 14, 1 << 16
#: Hexadecimal digits of the digest that tell the pieces of a source.
PIECE_DIGITS = 3


class Mix(NamedTuple):
    """documents: (id, size, source, source_size, target, taken) of all rows.
    segments: (slot, source, source_pass, id, begin, end), the mix itself: words begin to end of a document, by slot and begin.
    sources: (source, weight, source_size, target, quota)."""

    documents: DataFrame
    segments: DataFrame
    sources: DataFrame


def running_sum(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Add the sum of the values ahead of each row of `number_rows`, by its position `at`, in two levels."""
    rows = rows.withColumns({"_part": F.shiftright("at", 33), "_value": value})
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("_part").agg(F.sum("_value").alias("_sum"))  # one row per partition
    sums = sums.select("_part", F.coalesce(F.sum("_sum").over(ahead(Window.orderBy("_part"))), F.lit(0)).alias("_ahead"))
    rows = rows.withColumn("_own", F.coalesce(F.sum("_value").over(ahead(Window.partitionBy("_part").orderBy("at"))), F.lit(0)))
    return rows.join(sums, "_part").withColumn(name, F.col("_ahead") + F.col("_own")).drop("_part", "_value", "_ahead", "_own")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(at, source, source_size, weight, target, quota) of (source, source_size); quota is the target in whole words."""
    rows = number_rows(sizes.withColumn("_null", F.col("source").isNull()), "_null", "source", position="at").drop("_null")
    rows = running_sum(rows, F.lit(1), "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = stored(rows.withColumn("weight", weight.cast("long")), "sources")
    most = F.col("source_size") * repeats
    total, all_weights = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    rest, heavy = total, all_weights
    while total:
        share = F.col("weight") * F.lit(rest / heavy)
        held = most.cast("double") <= share
        stop, freed = rows.agg(F.sum(F.when(held, most).otherwise(0)), F.sum(F.when(held, F.col("weight")).otherwise(0))).first()
        if (total - stop, all_weights - freed) == (rest, heavy):
            break
        rest, heavy = total - stop, all_weights - freed
    target = F.least(most.cast("double"), F.col("weight") * F.lit(rest / heavy)) if total else F.lit(0.0)
    rows = rows.withColumn("target", target)
    return rows.withColumn("quota", F.floor(F.col("target") + 0.5).cast("long"))


def points(slot: Column) -> Column:
    """slot * GOLDEN modulo 2**BITS without leaving 64 bits."""
    half = 1 << BITS // 2
    high, low = F.floor(slot / half).cast("long"), slot % half
    return (high * (GOLDEN % half) % half * half + low * GOLDEN % (1 << BITS)) % (1 << BITS)


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """(at, rank, slot): one row per slot that takes words; at is the source's position."""
    spark = sources.sparkSession
    total = sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    slots = -(-total // block)
    wide = max(0, BITS - max(0, (slots // SLOTS_A_BUCKET).bit_length()))
    cut = lambda words: F.ceil(words.cast("double") / F.lit(float(max(1, total))) * float(1 << BITS)).cast("long")
    named = running_sum(sources.filter("quota > 0"), F.col("quota"), "ahead")
    named = named.withColumns({"begin": cut(F.col("ahead")), "stop": cut(F.col("ahead") + F.col("quota"))})
    named = stored(named.select("at", "quota", "begin", "stop"), "pieces")

    across = F.sequence(F.shiftright("begin", wide), F.shiftright(F.col("stop") - 1, wide))
    edges = named.filter("stop > begin").select("at", "begin", F.explode(across).alias("bucket"))
    edges = edges.select("bucket", F.greatest("begin", F.shiftleft("bucket", wide)).alias("point"), F.col("at").alias("piece"), F.lit(None).cast("long").alias("slot"))
    dots = spark.range(slots).select(points(F.col("id")).alias("point"), F.col("id").alias("slot"))
    dots = dots.select(F.shiftright("point", wide).alias("bucket"), "point", F.lit(None).cast("long").alias("piece"), "slot")
    order = Window.partitionBy("bucket").orderBy("point", F.col("slot").asc_nulls_first(), "piece").rowsBetween(Window.unboundedPreceding, 0)
    drawn = edges.unionByName(dots).withColumn("at", F.last("piece", ignorenulls=True).over(order)).filter("slot is not null")

    drawn = stored(drawn.select("at", "slot", F.floor(F.col("slot") / RANK_CHUNK).cast("long").alias("chunk")), "slots")
    counts = drawn.groupBy("at", "chunk").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("at").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("at", "chunk").orderBy("slot"))
    ranked = drawn.withColumn("own", within).join(counts, ["at", "chunk"]).select("at", "slot", (F.col("before") + F.col("own") - 1).alias("rank"))
    needed = F.ceil(F.col("quota") / block).cast("long")
    ranked = ranked.join(named.select("at", needed.alias("needed")), "at").filter("rank < needed").select("at", "rank", "slot")

    reached = drawn.groupBy("at").agg(F.count("*").alias("reached"))
    short = named.select("at", needed.alias("needed")).join(reached, "at", "left").withColumn("reached", F.coalesce("reached", F.lit(0)))
    short = running_sum(short.filter("reached < needed"), F.col("needed") - F.col("reached"), "first")
    late = short.select("at", "reached", "first", F.explode(F.sequence("reached", F.col("needed") - 1)).alias("rank"))
    return ranked.union(late.select("at", "rank", F.lit(slots) + F.col("first") + F.col("rank") - F.col("reached")))


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
                weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block_words: int = BLOCK_WORDS) -> Mix:
    full = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("id"), F.col(source).alias("source"), F.regexp_count(full, F.lit(WORD_PATTERN)).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.md5(full))).alias("digest"))
    rows = stored(rows.groupBy("source", "id", "digest", "size").agg(F.count("*").alias("copies")), "words")
    words = F.col("size") * F.col("copies")
    sources = stored(targets(rows.groupBy("source").agg(F.sum(words).alias("source_size")), weights, repeats), "targets")

    # place in the source's stream: pieces by the digest's first digits, then rows by the digest
    rows = rows.withColumn("piece", F.substring("digest", 1, PIECE_DIGITS))
    sums = rows.groupBy("source", "piece").agg(F.sum(words).alias("n"))
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("of"), F.col("piece").alias("in"), F.coalesce(F.sum("n").over(ahead(Window.partitionBy("source").orderBy("piece"))), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum(words).over(ahead(Window.partitionBy("source", "piece").orderBy("digest", "id", "size"))), F.lit(0))
    rows = rows.withColumn("within", within).join(sums, F.col("source").eqNullSafe(F.col("of")) & (F.col("piece") == F.col("in")))
    rows = rows.select("source", "id", "size", "copies", (F.col("before") + F.col("within")).alias("begin"))
    named = sources.select("at", F.col("source").alias("of"), "source_size", "target", "quota")
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("of"))).select(
        "at", "source", "id", "size", "source_size", "target", "quota",
        F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), lambda j: F.col("begin") + j * F.col("size"))).alias("begin"))
    rows = stored(rows, "placed")

    block = max(1, min(block_words, (sources.agg(F.sum("quota")).first()[0] or 0) // LEAST_SLOTS))
    again = rows.filter("size > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(repeats - 1).cast("long"))).alias("turn"))
    again = again.withColumns({"from": F.col("begin") + F.col("turn") * F.col("source_size")}).filter("from < quota")
    again = again.withColumn("to", F.least(F.col("from") + F.col("size"), "quota"))
    number = F.sequence(F.floor(F.col("from") / block).cast("long"), F.floor((F.col("to") - 1) / block).cast("long"))
    parts = again.select("*", F.explode(number).alias("rank"))
    parts = parts.withColumns({"first": F.greatest("from", F.col("rank") * block), "last": F.least("to", (F.col("rank") + 1) * block)})
    segments = parts.join(schedule(sources, block), ["at", "rank"]).select(
        "slot", "source", "at", F.col("begin").alias("place"), F.col("turn").alias("source_pass"), "id",
        (F.col("first") - F.col("from")).alias("begin"), (F.col("last") - F.col("from")).alias("end"))

    taken = segments.groupBy("at", F.col("place").alias("begin")).agg(F.sum(F.col("end") - F.col("begin")).alias("taken"))
    # documents without words stand where the next one does
    found = rows.withColumn("some", F.col("size") > 0).join(taken.withColumn("some", F.lit(True)), ["at", "begin", "some"], "left")
    documents = found.select("id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return Mix(documents, segments.drop("at", "place"), sources.drop("at", "rank"))
