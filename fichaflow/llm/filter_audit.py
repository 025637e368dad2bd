"""Filter interaction audit: which filter removes what, in every order of the filters, by the Hart-Mas-Colell potential.

A document is removed as soon as a filter that it fails runs, so what a set S of filters removes does not depend on their
order: its worth v(S) is the number of documents that fail any of S. The potential of this removal game follows by recursion over
all coalitions, |S| P(S) = v(S) + sum of P(S without i). The Shapley value of filter i is P(all) - P(all without i). What step i
removes after the filters S is v(S with i) - v(S). P is kept as the integer |S|! P(S), so nothing is rounded.

Spark counts documents per part and set of failed filters; at most 32 such counts, with five filters, leave each part. A hot
text, id or part is counted before it is shuffled. Everything after these counts is small.

A null text counts as an empty one, a null part as the empty string. Equal texts are told by their SHA-256. A null id is no
smaller than any other and none is smaller than it, so its row never counts as a copy. Rows that repeat an id are rows of their own
and no copies of each other. A document has a label if any of its label rows has it. Empty tables give no rows. Further
columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from fichaflow.llm.words import GAP_PATTERN

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILTERS = "ABCDE"
#: A: words at least; B: distinct words in a hundred at least; C: capitals in a hundred characters at most; D: characters that fail.
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT, MARKS = 100, 80, 10, "[#$%&*|]"
#: Places that the rows without an id are spread over in the join with the labels.
SALTS = 1024
STEP_SCHEMA = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
               "good_lost long, toxic_lost long, shapley long")


def text_failures(text: Column) -> Column:
    """Bits 0 to 3: the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, GAP_PATTERN), "")
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")

    def bits(w: Column) -> Column:
        n, distinct = F.size(w).cast("long"), F.size(F.array_distinct(w)).cast("long")
        tests = [n < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * n,
                 100 * upper > MAX_UPPER_PERCENT * F.length(text), text.rlike(MARKS)]
        return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))

    # the words are bound to a name, so they are cut once
    return F.element_at(F.transform(F.array(words), bits), 1)


def failure_counts(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents per part and set of failed filters, all and those of either label."""
    full = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"),
        F.unhex(F.sha2(full, 256)).alias("digest"), text_failures(full).alias("mask"))
    salt = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALTS))).otherwise(0)
    rows = rows.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n")).withColumn("salt", salt)
    known = labels.groupBy(F.col(key).alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).withColumn("salt", F.lit(0).cast("long"))
    rows = rows.join(known, ["id", "salt"], "left")
    no = F.lit(False)
    groups = rows.groupBy("digest", "part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"))
    # a text has one row here per part and label
    least = F.min("first.id").over(Window.partitionBy("digest"))
    own = F.when(F.col("first.id") == least, F.col("first.n")).otherwise(0) + F.col("unnamed")
    split = groups.withColumn("own", own).select("part", "good", "toxic", F.explode(F.array(
        F.struct("mask", F.col("own").alias("n")),
        F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("own")).alias("n")))).alias("x"))
    labelled = lambda c: F.sum(F.when(F.col(c), F.col("x.n")).otherwise(0)).alias(c)
    return split.filter("x.n > 0").groupBy("part", F.col("x.mask").alias("mask")).agg(
        F.sum("x.n").alias("n"), labelled("good"), labelled("toxic"))


def worths(counts: dict[int, int], filters: int) -> list[int]:
    """v(S) for each set S of filters: documents that fail any of S."""
    return [sum(n for mask, n in counts.items() if mask & s) for s in range(1 << filters)]


def potentials(worth: list[int]) -> list[int]:
    """|S|! P(S) for each coalition, smaller ones first."""
    scaled = [0] * len(worth)
    for s in range(1, len(worth)):
        size = s.bit_count()
        scaled[s] = factorial(size - 1) * worth[s] + sum(scaled[s ^ 1 << i] for i in range(s.bit_length()) if s >> i & 1)
    return scaled


def shapley_sums(worth: list[int], filters: int) -> list[int]:
    """Per filter, what it removes summed over all orders: filters! times its Shapley value."""
    scaled, every = potentials(worth), (1 << filters) - 1
    return [scaled[every] - filters * scaled[every ^ 1 << i] for i in range(filters)]


def part_steps(part: str, counts: list[tuple[int, int, int, int]], names: str = FILTERS) -> list[tuple]:
    """All rows of one part, from its (mask, n, good, toxic)."""
    filters = len(names)
    total = sum(n for _, n, _, _ in counts)
    removed, good, toxic = (worths({c[0]: c[k] for c in counts}, filters) for k in (1, 2, 3))
    shares, every = shapley_sums(removed, filters), (1 << filters) - 1
    rows = []
    for order in permutations(range(filters)):
        before, label = 0, "".join(names[i] for i in order)
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            here = removed[after] - removed[before]
            rows.append((part, label, step, total - removed[after], here, removed[1 << i] - here,
                         removed[every] - removed[every ^ 1 << i], good[after] - good[before], toxic[after] - toxic[before], shares[i]))
            before = after
    return rows


def audit_steps(counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """One row per part, order of filters and step, from (part, mask, n, good, toxic) with distinct masks per part."""
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    columns = [c.split()[0] for c in STEP_SCHEMA.split(", ")]

    def steps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, cells in zip(frame["part"], frame["counts"]):
                own = [(c["mask"], c["n"], c["good"], c["toxic"]) for c in cells]
                yield pd.DataFrame(part_steps(part, own, names), columns=columns)

    return parts.mapInPandas(steps, STEP_SCHEMA)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit_steps(failure_counts(docs, labels))
