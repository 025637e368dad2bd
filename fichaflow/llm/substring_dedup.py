"""Substring dedup: every window of `size` words is hashed and counted; repeated windows become removal intervals.

Rabin-Karp hashes of all windows of a text come from prefix sums. A task collects the windows of many documents, drops those
that repeat an earlier one of its own, and deals the rest to buckets. Within a bucket, all windows but the first (smallest
document, then smallest start) of each hash are repeats, wherever the window stands in the input. Neighbouring
repeats merge into maximal intervals of words, joined back to the documents.

Windows that a task knows to be repeats are dealt by document, the others by content. Their bucket is chosen by the smallest hash of a five-word part of the window. Neighbouring windows share it mostly, so they
travel as one run with one position. Parts so common that their windows would overload a bucket are found first, by
counting all windows in a table of SLOTS entries; windows of such parts are dealt by their own hash instead.
Equal windows meet in one bucket either way, and no key holds more than about OVERLOAD / SLOTS of all windows.

Windows are compared by 56 bits of their hash within a bucket: with 10**10 windows in 10**4 buckets, about one in 10**11 is
taken for a repeat by chance.

Null and empty texts have no words. Ids should be unique: rows with the same id count as one document whose windows
are merged, rows with a null id remove nothing and lose nothing. Further columns stay, those that have the names of added ones are
replaced; empty tables give empty results.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from fichaflow.llm.words import Words, chunks, mix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIZE, PART = 20, 5
SLOTS, OVERLOAD = 1 << 16, 8
#: Windows that a task compares among themselves before it passes them on.
BATCH_WINDOWS = 700_000
#: Windows of a bucket on average, at most; a session with more partitions gets more buckets.
BUCKET_WINDOWS, BUCKETS_PER_PARTITION = 1_000_000, 4
RUNS = "bucket int, docs array<bigint>, starts array<int>, lengths array<int>, hashes binary, more_docs array<bigint>, more_starts array<int>, more_lengths array<int>"
HASH_BYTES = 7


def smallest_part(words: Words, size: int) -> np.ndarray:
    """For each word with a whole window behind it, the smallest hash of the window's parts (garbage elsewhere)."""
    part = min(PART, size)
    hashes, at = words.windows(part)
    low = np.full(len(words), np.iinfo(np.uint64).max, np.uint64)
    low[at] = hashes
    span, left = 1, size - part + 1
    while span < left:
        step = min(span, left - span)
        low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
        span += step
    return low


def count_slots(docs: DataFrame, size: int) -> np.ndarray:
    """Windows of all documents by the slot of their smallest part."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                words = Words(part.column("text"))
                _, at = words.windows(size)
                if len(at):
                    total += np.bincount((smallest_part(words, size)[at] % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], ["slot", "n"])

    found = docs.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SLOTS, np.int64)
    out[found["slot"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


class Dealer:
    """Collects windows of a task's documents and deals them to buckets as runs."""

    def __init__(self, size: int, buckets: int, hot: np.ndarray):
        self.size, self.buckets, self.hot = size, buckets, hot
        self.held: list[tuple[np.ndarray, ...]] = []
        self.count = 0

    def add(self, ids: np.ndarray, texts: pa.Array) -> None:
        words = Words(texts)
        hashes, at = words.windows(self.size)
        if not len(at):
            return
        low = smallest_part(words, self.size)[at]
        doc = words.text_of_word()[at]
        key = np.where(self.hot[(low % np.uint64(SLOTS)).astype(np.int64)], hashes >> np.uint64(8), low >> np.uint64(16))
        bucket = (key % np.uint64(self.buckets)).astype(np.int32)
        self.held.append((ids[doc], (at - words.first[doc]).astype(np.int32), bucket, hashes, low))
        self.count += len(at)

    def deal(self) -> pa.RecordBatch:
        doc, start, bucket, hashes, low = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.count = [], 0
        order = np.lexsort((start, doc, hashes))
        again = np.zeros(len(order), bool)
        h, d, s = hashes[order], doc[order], start[order]
        lead = np.maximum.accumulate(np.where(np.append(True, h[1:] != h[:-1]), np.arange(len(h)), 0))
        again[order] = (d != d[lead]) | (s != s[lead])  # as in repeats(): a row that repeats the first one's id and place is no later one
        # repeats known by now need no comparison: they are dealt by document, so that a hot window burdens no bucket
        apart = mix(doc.view(np.uint64) ^ (start >> 12).astype(np.uint64) << np.uint64(40)) % np.uint64(self.buckets)
        bucket = np.where(again, self.buckets + apart.astype(np.int32), bucket).astype(np.int32)
        # runs: neighbouring windows of a document for the same bucket, all first or all repeats
        fresh = np.ones(len(doc), bool)
        fresh[1:] = ((doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1) | (bucket[1:] != bucket[:-1])
                     | (again[1:] != again[:-1]) | ~again[1:] & (low[1:] != low[:-1]))
        begin = np.flatnonzero(fresh)
        length = np.diff(np.append(begin, len(doc))).astype(np.int32)
        run_of = np.cumsum(fresh) - 1
        order = np.argsort(bucket[begin], kind="stable")
        first, more = order[~again[begin[order]]], order[again[begin[order]]]
        used = np.unique(bucket)
        edges = lambda runs: np.searchsorted(bucket[begin[runs]], np.append(used, 2 * self.buckets)).astype(np.int32)
        lists = lambda runs, values: pa.ListArray.from_arrays(pa.array(edges(runs)), pa.array(values))
        rank = np.empty(len(begin), np.int64)
        rank[first] = np.arange(len(first))
        own = np.flatnonzero(~again)
        own = own[np.argsort(rank[run_of[own]], kind="stable")]
        packed = np.ascontiguousarray(hashes[own].view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]).reshape(-1)
        ends = np.concatenate([[0], np.cumsum(length[first])])[edges(first)] * HASH_BYTES
        blob = pa.Array.from_buffers(pa.binary(), len(used), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(packed)])
        return pa.RecordBatch.from_arrays([
            pa.array(used), lists(first, doc[begin[first]]), lists(first, start[begin[first]]), lists(first, length[first]), blob,
            lists(more, doc[begin[more]]), lists(more, start[begin[more]]), lists(more, length[more]),
        ], ["bucket", "docs", "starts", "lengths", "hashes", "more_docs", "more_starts", "more_lengths"])


def expand(doc: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and starts of all windows of some runs."""
    total = int(length.sum())
    within = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
    return np.repeat(doc, length), np.repeat(start, length) + within


def repeats(group: pd.DataFrame, size: int) -> pd.DataFrame:
    """Intervals of words covered by the windows of one bucket that are repeats."""
    join = lambda name, kind: np.concatenate([np.asarray(x, kind) for x in group[name]])
    doc, start = expand(join("docs", np.int64), join("starts", np.int64), join("lengths", np.int64))
    raw = np.frombuffer(b"".join(group["hashes"]), np.uint8).reshape(-1, HASH_BYTES)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :HASH_BYTES] = raw
    hashes = wide.view(np.uint64).reshape(-1)
    order = np.lexsort((start, doc, hashes))
    later = np.zeros(len(order), bool)
    if len(order):
        h, d, s = hashes[order], doc[order], start[order]
        new = np.append(True, h[1:] != h[:-1])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        later[order] = (d != d[lead]) | (s != s[lead])  # a row that repeats the first one's id and place is no later one
    own_doc, own_start = expand(join("more_docs", np.int64), join("more_starts", np.int64), join("more_lengths", np.int64))
    doc, start = np.concatenate([doc[later], own_doc]), np.concatenate([start[later], own_start])
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    fresh = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + size))[:len(doc)]
    begin = np.flatnonzero(fresh)
    last = np.append(begin[1:], len(doc)) - 1 if len(doc) else begin
    return pd.DataFrame({"doc": doc[begin], "start": start[begin], "stop": start[last] + size})


def repeat_intervals(docs: DataFrame, key: str, text: str, size: int = SIZE) -> DataFrame:
    """(doc, start, stop): stretches of words covered by repeats. Stretches of one document may touch or overlap."""
    spark = docs.sparkSession
    plain = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    slots = count_slots(plain, size)
    buckets = max(BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(slots.sum()) // BUCKET_WINDOWS))
    hot = spark.sparkContext.broadcast(slots * SLOTS > OVERLOAD * max(int(slots.sum()), 1))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(size, buckets, hot.value)
        for batch in batches:
            for part in chunks(batch, "text"):
                dealer.add(part.column("doc").to_numpy(zero_copy_only=False), part.column("text"))
                if dealer.count >= BATCH_WINDOWS:
                    yield dealer.deal()
        if dealer.count:
            yield dealer.deal()

    dealt = plain.mapInArrow(deal, RUNS)
    return dealt.groupBy("bucket").applyInPandas(lambda g: repeats(g, size), "doc long, start int, stop int")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """Add n_words, n_removed and kept_text: the words that no repeat covers, joined by single blanks."""
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]
    docs = docs.drop(*(f.name for f in added))
    own = "_".join(["cut", *docs.columns])  # a name that no column has
    cut = repeat_intervals(docs, key, text, size).groupBy(F.col("doc").alias(f"{own}_doc")).agg(
        F.collect_list(F.struct("start", "stop")).alias(own))
    joined = docs.join(cut, docs[key] == cut[f"{own}_doc"], "left").drop(f"{own}_doc")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                texts, cuts = part.column(text).to_pylist(), part.column(own).to_pylist()
                rows = [without(t or "", c or ()) for t, c in zip(texts, cuts)]
                new = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
                keep = [i for i, name in enumerate(part.schema.names) if name != own]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in keep), *new], [*(part.schema.names[i] for i in keep), *(f.name for f in added)])

    return joined.mapInArrow(remove, T.StructType(docs.schema.fields + added))


def without(text: str, cuts) -> tuple[int, int, str]:
    """Number of words, of words within the cuts, and the other words."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    stay = np.ones(n, bool)
    for cut in cuts:
        stay[cut["start"]:cut["stop"]] = False
    kept = words if not len(cuts) else list(compress(words, stay.tolist()))
    return n, n - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")
