"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Rows of the matrix are distinct shingle sets (copies of a set are one row), columns are shingles. Columns are ordered
from rare to frequent by a table of SLOTS hashed counts over all documents. If two sets of sizes m, n reach the similarity t,
they overlap in at least t / (1 + t) * (m + n) shingles. So they share a column early on: with their first shared columns at places i and j,
neither n - i nor m - j may be less. Only the first n - ceil(t * n) + 1 columns of a row can meet that, and of the smaller row
only those that allow a partner of its own size, its head.

The product over these columns finds candidate pairs, each by a column and the two places in it. Within a column, pairs inside one
component need no count, as they change nothing. So each column first pairs its rows with one leader, the head row whose columns
are the most frequent (an unedited text among edited copies), which is linear in its rows. Then heads meet rows of other
components, under the bounds on sizes and places. Overlap counts of pairs are accumulated over blocks of columns. First, no more
columns can be shared in a small block than either row has there; pairs whose sum of these stays below the bound are discarded by 64
numbers a row. For the others, blocks are joined as arrays of hashes; after each, pairs are discarded whose count cannot reach the bound
with all columns that remain.
Texts are never shuffled. All links between different sets are found or implied.

Sets are compared by 64-bit hashes of shingles, sets as a whole by 64 bits. Null and empty texts have no set: they are
linked with nothing. Rows that repeat an id each have their own text's set and get the component of that text. A null id has a null
component. Further columns are ignored here; empty tables give empty results.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from fichaflow.llm.components import components
from fichaflow.llm.storage import discard_stored, stored
from fichaflow.llm.words import Words, chunks, mix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE, PERCENT = 5, 80
SLOTS, SEGMENTS = 1 << 20, 256
FILTER_BITS = 1 << 24
#: Sets that a task remembers, to pass on the columns of copies once.
SEEN_SETS = 200_000
#: Blocks of columns, by the first BLOCK_BITS of a column, whose sizes alone bound an overlap: a row keeps how many columns it has in each.
BLOCK_BITS = 6
#: Blocks of columns that overlaps are counted over: a quarter of all, then the rest.
BLOCK_EDGES = (-(1 << 62) * 2, -(1 << 62), (1 << 62) * 2)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, sorted. A text of fewer words is one shingle."""
    words = Words(texts, lower=True)
    hashes, at = words.windows(size)
    owner = words.text_of_word()[at]
    counts = words.counts
    short = np.flatnonzero((counts > 0) & (counts < size))
    owner = np.concatenate([owner, short])
    hashes = np.concatenate([hashes, np.array([words.sequence(k) for k in short], np.uint64)])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[new], hashes[new]


def count_columns(docs: DataFrame, size: int) -> np.ndarray:
    """Sets per slot of shingles, over all documents; a table of fixed size, summed in segments."""
    width = SLOTS // SEGMENTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                _, hashes = shingle_sets(part.column("text"), size)
                total += np.bincount((hashes % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        if total.any():
            kind = "<i4" if total.max() < 1 << 31 else "<i8"
            rows = [x.astype(kind).tobytes() for x in total.reshape(SEGMENTS, width)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SEGMENTS), pa.int32()), pa.array(rows, pa.binary())], ["segment", "counts"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, f"<i{len(x) // width}").astype(np.int64) for x in group["counts"])
        return pd.DataFrame({"segment": group["segment"].iloc[:1], "counts": [total.tobytes()]})

    parts = docs.select("text").mapInArrow(count, "segment int, counts binary")
    out = np.zeros((SEGMENTS, width), np.int64)
    for row in parts.groupBy("segment").applyInPandas(add, "segment int, counts binary").collect():
        out[row["segment"]] = np.frombuffer(row["counts"], "<i8")
    return np.minimum(out.reshape(-1), np.iinfo(np.int32).max).astype(np.int32)


def set_hashes(hashes: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """64 bits of each set; hashes from edge[k] to edge[k + 1] are set k."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    return mix((total[edge[1:]] - total[edge[:-1]]) ^ mix(np.diff(edge).astype(np.uint64))).view(np.int64)


def first_columns(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(id, row, n, weight, columns, held): hash and size of each document's set, how frequent its columns are, the first of them, and
    how many it has in each small block.

    columns and held are null for documents whose set the task has passed on already; row is null for an empty set.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(count_columns(docs, size))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in chunks(batch, "text"):
                owner, hashes = shingle_sets(part.column("text"), size)
                n = np.bincount(owner, minlength=part.num_rows)
                edge = np.concatenate([[0], np.cumsum(n)])
                row = set_hashes(hashes, edge)
                often = frequent.value[(hashes % np.uint64(SLOTS)).astype(np.int64)]
                order = np.lexsort((hashes, often, owner))
                ranked, often = hashes[order].view(np.int64), often[order]
                length = n - -(-percent * n // 100) + 1
                columns, known, held = [], part.column("id").is_valid().to_pylist(), []
                blocks = 1 << BLOCK_BITS
                sizes = np.bincount(owner * blocks + (hashes >> np.uint64(64 - BLOCK_BITS)).astype(np.int64), minlength=part.num_rows * blocks)
                sizes = sizes.astype(np.int32).reshape(part.num_rows, blocks)
                weight = np.zeros(part.num_rows, np.int32)
                for k, key in enumerate(row.tolist()):
                    new = n[k] and known[k] and key not in seen
                    columns.append(ranked[edge[k]:edge[k] + length[k]] if new else None)
                    held.append(sizes[k] if new else None)
                    if new:
                        seen.add(key)
                        weight[k] = often[edge[k]]
                if len(seen) > SEEN_SETS:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([
                    part.column("id"), pa.array(row, mask=n == 0), pa.array(n.astype(np.int32)), pa.array(weight),
                    pa.array(columns, pa.list_(pa.int64())), pa.array(held, pa.list_(pa.int32())),
                ], ["id", "row", "n", "weight", "columns", "held"])

    return docs.mapInArrow(rows, "id long, row long, n int, weight int, columns array<long>, held array<int>")


def bounds(percent: int) -> str:
    """Whether row a of n shingles may reach the similarity with the row b of m, first shared columns at places i and j; b is the smaller one."""
    return (f"(m < n or m = n and b < a) and 100L * m >= {percent}L * n and {percent}L * (n + m) <= {100 + percent}L * (n - i)"
            f" and {percent}L * (n + m) <= {100 + percent}L * (m - j)")


def link_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id): the smallest id that each document reaches by links."""
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    made = stored(first_columns(docs, size, percent), "columns")
    rows = stored(made.select("id", "n", "row"), "rows")
    classes = rows.filter("row is not null and id is not null").groupBy("row").agg(F.min("id").alias("first"))
    sets = made.filter("row is not null and id is not null")
    sizes = stored(sets.filter("held is not null").groupBy("row").agg(F.first("held").alias("held")), "sizes")

    # a row may come once from each task; that changes neither leaders nor links
    block = sets.select("row", "n", "weight", F.posexplode("columns").alias("i", "column"))
    head = f"{2 * percent}L * n <= {100 + percent}L * (n - i)"
    leader = F.max(F.struct("weight", "row", F.col("n").alias("m"), F.col("i").alias("j"))).alias("leader")
    leaders = block.filter(head).groupBy("column").agg(leader)
    shared = block.join(leaders, "column").filter("row <> leader.row").select("column", "row", "n", "i", "leader.m", "leader.j", F.col("leader.row").alias("leader"))
    shared = stored(shared.distinct(), "block")
    discard_stored(made)

    # the bounds hold for the larger one as a; the overlap is counted with the leader as b, as few rows are leaders
    larger = shared.withColumns({"a": F.col("row"), "b": F.col("leader")}).filter(bounds(percent))
    turned = {"a": "leader", "b": "row", "n": "m", "m": "n", "i": "j", "j": "i"}
    smaller = shared.select(*(F.col(old).alias(new) for new, old in turned.items())).filter(bounds(percent))
    pairs = larger.select("a", "b", "n", "m").union(smaller.select("b", "a", "m", "n"))
    pairs = stored(within_sizes(pairs.distinct(), sizes, percent), "pairs")
    found = overlaps(pairs, docs, classes, size, percent)
    root = stored(components(found), "roots")

    own = shared.select("column", "row", "n", "i").join(root.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    several = own.groupBy("column").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.bool_or(F.expr(head)).alias("some")).filter("low <> high and some")
    left = stored(own.join(several.select("column"), "column", "left_semi"), "left")
    smaller = left.filter(head).select("column", F.col("row").alias("b"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("root").alias("other"))
    pairs = left.withColumnRenamed("row", "a").join(smaller, "column").filter(f"root <> other and {bounds(percent)}")
    pairs = stored(within_sizes(pairs.select("a", "b", "n", "m").distinct(), sizes, percent), "pairs")
    if not pairs.isEmpty():
        found = overlaps(pairs, docs, classes, size, percent)
        root = components(found.union(root.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))))

    placed = classes.join(root.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    of_row = placed.join(smallest, "root").select("row", "component_id")
    return rows.select("id", "n", "row").join(of_row, "row", "left").select(
        "id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def within_sizes(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n, m) whose rows could overlap enough by the sizes (row, held) of their small blocks."""
    met = pairs.join(sizes.select(F.col("row").alias("a"), F.col("held").alias("of_a")), "a").join(
        sizes.select(F.col("row").alias("b"), F.col("held").alias("of_b")), "b")
    most = F.aggregate(F.zip_with("of_a", "of_b", lambda x, y: F.least(x, y)), F.lit(0), lambda total, x: total + x)
    return met.filter((100 + percent) * most.cast("long") >= percent * (F.col("n").cast("long") + F.col("m"))).select("a", "b", "n", "m")


def incidence(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(id, row, in_a, in_b, block, columns): columns of documents in blocks, from their texts, of those with an id in wanted
    (row, first, in_a, in_b) or one that hashes alike; in_a and in_b may be true too often for the same reason.

    Two bit tables of fixed size, set by the hashed ids, decide, so no columns are shuffled here; joins on row and id drop the others.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    bit = F.expr("shiftleft(1L, cast(place % 32 AS INT))")
    word = wanted.select(F.col("first").alias("id"), "in_a", "in_b").select(place.alias("place"), "in_a", "in_b").groupBy(
        F.floor(F.col("place") / 32).alias("word")).agg(*(F.bit_or(F.when(F.col(c), bit).otherwise(0)).alias(c) for c in ("in_a", "in_b")))
    bits = np.zeros((2, FILTER_BITS // 32), np.uint32)
    table = word.toPandas()
    for k, side in enumerate(("in_a", "in_b")):
        bits[k, table["word"].to_numpy(np.int64)] = table[side].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("place").to_numpy(zero_copy_only=False)
            hit = (shared.value[:, at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)
            batch = batch.append_column("in_a", pa.array(hit[0])).append_column("in_b", pa.array(hit[1]))
            for part in chunks(batch.filter(pa.array(hit.any(axis=0))), "text"):
                owner, hashes = shingle_sets(part.column("text"), size)
                n = np.bincount(owner, minlength=part.num_rows)
                edge = np.concatenate([[0], np.cumsum(n)])
                row = set_hashes(hashes, edge)
                held = hashes.view(np.int64)
                for k, (low, high) in enumerate(zip(BLOCK_EDGES, BLOCK_EDGES[1:])):
                    inside = (held >= low) & (held < high)
                    count = np.bincount(owner[inside], minlength=part.num_rows)
                    offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(held[inside]))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id"), pa.array(row), part.column("in_a"), part.column("in_b"), pa.array(np.full(part.num_rows, k, np.int32)), lists],
                        ["id", "row", "in_a", "in_b", "block", "columns"])

    made = "id long, row long, in_a boolean, in_b boolean, block int, columns array<long>"
    return docs.filter("id is not null").withColumn("place", place).mapInArrow(columns, made)


def overlaps(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of rows, of those (a, b, n, m), whose overlap over all blocks of columns reaches the similarity."""
    ends = pairs.select(F.col("a").alias("row"), F.lit(True).alias("in_a")).union(pairs.select("b", F.lit(False)))
    nodes = ends.groupBy("row").agg(F.bool_or("in_a").alias("in_a"), F.bool_or(~F.col("in_a")).alias("in_b"))
    wanted = stored(classes.join(nodes, "row"), "wanted")
    held = stored(incidence(docs, wanted, size), "incidence")
    own = wanted.select("row", F.col("first").alias("id"))
    if held.select("row", "id").join(own, ["row", "id"], "left_semi").count() > wanted.count() * (len(BLOCK_EDGES) - 1):
        repeated, held = held, stored(held.dropDuplicates(["row", "id", "block"]), "incidence")  # rows of the table that repeat an id and its text
        discard_stored(repeated)
    left = pairs.select("a", "b", "n", "m", F.lit(0).alias("common"), F.col("n").alias("rest_a"), F.col("m").alias("rest_b"))
    for side in "ab":
        left = left.join(wanted.select(F.col("row").alias(side), F.col("first").alias(f"id_{side}")), side)
    for k in range(len(BLOCK_EDGES) - 1):
        of_a, of_b = (
            held.filter((F.col("block") == k) & F.col(f"in_{side}")).select(
                F.col("row").alias(side), F.col("id").alias(f"id_{side}"), F.col("columns").alias(f"of_{side}"))
            for side in "ab")
        left = left.join(of_a, ["a", "id_a"]).join(of_b, ["b", "id_b"]).select(
            "a", "b", "n", "m", (F.col("common") + F.size(F.array_intersect("of_a", "of_b"))).alias("common"),
            (F.col("rest_a") - F.size("of_a")).alias("rest_a"), (F.col("rest_b") - F.size("of_b")).alias("rest_b"), "id_a", "id_b")
        left = stored(left.filter(f"{100 + percent}L * (common + least(rest_a, rest_b)) >= {percent}L * (n + m)"), "counted")
    discard_stored(held)
    return left.select("a", "b")
