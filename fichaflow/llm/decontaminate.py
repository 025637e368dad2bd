"""Benchmark decontamination with DataFrame functions only.

A document leaks an item when a window of the item's size (in words) is similar to it: the weighted Jaccard similarity of
their shingles of five words, each weighted by its number of occurrences, is 0.8 or more. Letters A-Z count as lower case.

1. Where windows can be. A similar window of m shingles shares at least 2 * t * m / (1 + t) of them, so of any
   m - that + 1 shingles of the item one is in it. A document shorter than the item has fewer shingles, of which it need
   only share t * m, so it is asked for m - that + 1. Those with the longest words serve as anchors; a word of a document that
   is an anchor's longest word, with the same words around it, places a window, and so do its neighbours, as
   far as the words lost at either end leave the similarity within reach.
2. SimHash. Each window and each item has 64 bits, each the majority over the hashes of its words.
3. Multi-index Hamming blocks. The bits are cut into RADIUS + 1 blocks; fingerprints within the radius agree in one block, so a
   join on (size, block, value) finds all of them, and a bit count keeps those within the radius.
4. The exact similarity decides.

At a similarity of 0.8 about 10 % of the words differ at most, which changes 9 of 64 bits on average, 3 being one
standard deviation; the radius is five of these above.

Null and empty texts have no windows, items without words no anchors; an item of fewer than five words is one shingle. A
document shorter than the item is its own window. Null ids of documents or items are left out. Of rows that repeat an
id, each text is searched, and the best window of them counts. Further columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SHINGLE, PERCENT, RADIUS, BITS = 5, 80, 23, 64
#: Anchors up to this number are sent to all tasks; more meet the words in a join that shuffles.
BROADCAST_ANCHORS = 50_000
#: The lowest bit of four lanes of 16 bits, and words that the lanes of a signed number can count.
LANE_ONES, LANE_WORDS = 0x0001000100010001, 32_767
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    plain = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, r"[\x20\x09-\x0D]+"))


def shingles(words: Column) -> Column:
    """All shingles in order, as texts; one of all words if they are fewer."""
    last = F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, SHINGLE), " "))


def lost(m: Column, percent: int) -> Column:
    """Of m shingles, the most that a similar window of the item's size can miss."""
    return (m - F.ceil(F.lit(2 * percent) * m / F.lit(100 + percent))).cast("int")


def lost_if_short(m: Column, percent: int) -> Column:
    """The same of a document shorter than the item, which may have none but shared shingles."""
    return (m - F.ceil(F.lit(percent) * m / F.lit(100))).cast("int")


def fingerprint(words: Column) -> Column:
    """64 bits, each the majority over the hashes of the words; a tie is 0.

    Bits are counted four at a time, in lanes of 16 bits, each step adding every sixteenth bit of all hashes; windows of more
    words than a lane can count take their bits one by one.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    bind = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    shift = lambda x, by: F.call_function("shiftleft", x, by)
    unsigned = lambda x, by: F.call_function("shiftrightunsigned", x, by)

    def lanes(h: Column, g: Column) -> Column:
        total = F.aggregate(h, zero, lambda t, x: t + unsigned(x, g).bitwiseAND(F.lit(LANE_ONES)))
        bits = lambda t: [F.when(2 * F.shiftrightunsigned(t, 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long")) > F.size(h), shift(one, g + 16 * k))
                          .otherwise(zero) for k in range(4)]
        return bind(total, lambda t: bits(t)[0].bitwiseOR(bits(t)[1]).bitwiseOR(bits(t)[2]).bitwiseOR(bits(t)[3]))

    ones = lambda h, b: F.aggregate(h, zero, lambda total, x: total + F.call_function("getbit", x, b))
    fast = lambda h: F.aggregate(F.sequence(F.lit(0), F.lit(15)), zero, lambda out, g: out.bitwiseOR(lanes(h, g)))
    slow = lambda h: F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), zero, lambda out, b: F.when(
        2 * ones(h, b) > F.size(h), out.bitwiseOR(shift(one, b))).otherwise(out))
    return bind(hashes, lambda h: F.when(F.size(h) <= LANE_WORDS, fast(h)).otherwise(slow(h)))


def blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, number of bits) of radius + 1 blocks of even sizes."""
    edges = [k * BITS // (radius + 1) for k in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def in_blocks(prints: DataFrame, radius: int) -> DataFrame:
    """A row per block of each fingerprint."""
    parts = [F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("print", at).bitwiseAND(F.lit((1 << n) - 1).cast("long")).alias("value"))
             for k, (at, n) in enumerate(blocks(radius))]
    return prints.withColumn("part", F.explode(F.array(*parts))).select("*", "part.block", "part.value").drop("part")


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of shingles."""
    times = lambda xs, s: F.size(F.filter(xs, lambda x: x == s))
    both = F.aggregate(F.array_distinct(a), F.lit(0), lambda total, s: total + F.least(times(a, s), times(b, s)))
    return both / (F.size(a) + F.size(b) - both)


def benchmark_items(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    items = benchmark.filter(F.col(key).isNotNull()).select(F.col(key).alias("item"), words_of(F.col(text)).alias("item_words"))
    items = items.filter(F.size("item_words") > 0).dropDuplicates(["item"]).withColumn("item_shingles", shingles(F.col("item_words")))
    return items.withColumns({"size": F.size("item_words"), "m": F.size("item_shingles")})


def anchors(items: DataFrame, percent: int) -> DataFrame:
    """(item, size, m, shingle, offset, word, at, short): anchors of each item, and where their longest word is in them.

    Those marked as short are needed for documents shorter than the item only.
    """
    length = lambda w: F.length(w)
    longest = lambda ws: F.array_max(F.transform(ws, lambda w: F.struct(length(w).alias("n"), w.alias("w"))))["w"]
    ranked = F.transform(F.sequence(F.lit(1), F.col("m")), lambda i: F.struct(
        (-length(longest(F.slice("item_words", i, SHINGLE)))).alias("order"), (i - 1).alias("offset"), F.slice("item_words", i, SHINGLE).alias("words")))
    chosen = F.slice(F.array_sort(ranked), F.lit(1), lost_if_short(F.col("m"), percent) + 1)
    rows = items.select("item", "size", "m", F.posexplode(chosen).alias("rank", "x"))
    word = longest(F.col("x.words"))
    return rows.select("item", "size", "m", F.col("x.words").alias("shingle"), F.col("x.offset").alias("offset"), word.alias("word"),
                       (F.array_position("x.words", word) - 1).cast("int").alias("at"), (F.col("rank") > lost(F.col("m"), percent)).alias("short"))


def windows(docs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """(doc, copy, size, start, words): windows of documents placed by anchors; copy tells texts of one id apart."""
    marks = marks.withColumnRenamed("word", "mark")
    meets = (F.col("word") == F.col("mark")) & (~F.col("short") | (F.col("length") < F.col("size")))
    docs = docs.withColumn("length", F.size("words"))
    if marks.limit(BROADCAST_ANCHORS + 1).count() <= BROADCAST_ANCHORS:
        # the words of a document stay beside each of them, as nothing is shuffled
        met = docs.select("doc", "copy", "words", "length", F.posexplode("words").alias("pos", "word")).join(F.broadcast(marks), meets)
    else:
        places = docs.select("doc", "copy", "length", F.posexplode("words").alias("pos", "word")).join(marks, meets).drop("length")
        met = places.join(docs, ["doc", "copy"])
    first = F.col("pos") - F.col("at")
    met = met.filter((first >= 0) & (F.slice("words", F.greatest(first, F.lit(0)) + 1, F.size("shingle")) == F.col("shingle")))
    slack, begin, room = lost(F.col("m"), percent), first - F.col("offset"), F.size("words") - F.col("size")
    low = F.greatest(F.lit(0), F.least(begin - slack, room))
    high = F.greatest(F.lit(0), F.least(begin + slack, room))
    near = met.select("doc", "copy", "size", low.alias("low"), (high - low).cast("int").alias("more"),
                      F.slice("words", low + 1, high - low + F.col("size")).alias("around")).dropDuplicates(["doc", "copy", "size", "low", "more"])
    each = near.select("doc", "copy", "size", "low", "around", F.explode(F.sequence(F.lit(0), F.col("more"))).alias("step"))
    return each.select("doc", "copy", "size", (F.col("low") + F.col("step")).cast("int").alias("start"),
                       F.slice("around", F.col("step") + 1, F.col("size")).alias("words")).dropDuplicates(["doc", "copy", "size", "start"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
               item_text: str = "text", percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """(doc, item, similarity, start, size): each document and item that it leaks, with the most similar, first window."""
    items = benchmark_items(benchmark, item_key, item_text)
    docs = docs.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("doc"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("copy"), words_of(F.col(text)).alias("words"))
    found = windows(docs, anchors(items, percent), percent).withColumn("print", fingerprint(F.col("words")))
    known = in_blocks(items.select("item", "size", fingerprint(F.col("item_words")).alias("item_print")).withColumn(
        "print", F.col("item_print")), radius).select("item", "size", "item_print", "block", "value")
    near = in_blocks(found, radius).join(known, ["size", "block", "value"]).filter(
        F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
    pairs = near.dropDuplicates(["doc", "copy", "size", "start", "item"]).select("doc", "start", "words", "item")
    judged = pairs.join(items.select("item", "size", "item_shingles"), "item").withColumn(
        "similarity", similarity(F.col("item_shingles"), shingles(F.col("words"))))
    leaks = judged.filter(F.col("similarity") >= percent / 100 - 1e-12)
    best = leaks.groupBy("doc", "item").agg(
        F.max(F.struct("similarity", (-F.col("start")).alias("back"), "size")).alias("b"))
    return best.select("doc", "item", "b.similarity", (-F.col("b.back")).alias("start"), "b.size")
