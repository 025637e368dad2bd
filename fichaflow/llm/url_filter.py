"""URL filter: rules first, then the ratio of two character language models.

Urls that a rule allows are examples of accepted ones, urls that a rule blocks of rejected ones. For each class a
variable-order Markov model over bytes is counted: P(c | k bytes) = (n(k bytes, c) + S * P(c | k-1 bytes)) / (n(k bytes) + S),
from 1/256 up to ORDER bytes, so a context never seen leaves the shorter one's value. Counts are exact: order, context and byte
fit in one 64-bit key, and Spark sums the counts of each key over all urls. Up to BROADCAST_KEYS of them go to all tasks as sorted
arrays; with more, the keys of the urls meet their counts in a join, with the same scores. The score of a url
is the difference of its log-likelihoods divided by its length. A tenth of the examples, left out of the counts, calibrates it:
their scores, counted in fixed bins, fit a logistic curve, and a url that no rule fits is accepted from probability 1/2 on.

A null url is scored as an empty one. Without examples of both classes the verdict follows the class there is, or allows.
Rows are independent: ties and repeated rows need no care, empty tables give empty results, further columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from fichaflow.llm.storage import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Verdict, host and path of each rule.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ORDER, SMOOTHING = 5, 1.0
#: Keys that tasks receive as a table, 24 bytes each; beyond, scores come from a join.
BROADCAST_KEYS = 1 << 20
CALIBRATION_FOLDS, BINS_PER_UNIT, WIDEST = 10, 128, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path; both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Verdict and text of the longest rule that fits, null if none does; one condition for each of a short list of rules."""
    verdict = name = F.lit(None).cast("string")
    for decided, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        verdict, name = F.when(fits, decided).otherwise(verdict), F.when(fits, h + p).otherwise(name)
    return verdict, name


@dataclass
class Models:
    """keys: contexts with their next byte, and contexts, sorted; counts[class, key]; class 0 rejected, 1 accepted.

    table: the same as a stored frame (key, n0, n1) where they are too many for tasks; keys is None then."""

    keys: np.ndarray | None
    counts: np.ndarray | None
    table: DataFrame | None = None
    slope: float = 0.0
    offset: float = 0.0

    def __getstate__(self):
        return self.__dict__ | {"table": None}

    def of(self, keys: np.ndarray) -> np.ndarray:
        """(class, key) counts, 0 where a key was never seen."""
        if not len(self.keys):
            return np.zeros((2, len(keys)))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.counts[:, at] * (self.keys[at] == keys)


def url_keys(urls: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Per order: the key of each byte with its context, and that of the context; the length of each url with its end.

    A key holds, from the low bits, the byte (0 for the context alone), up to five bytes before it, and the order (with 8 added for
    the context alone), so different ones never share a key."""
    data = [(u or "").translate(_LOWER_CASE).encode("utf-8", "surrogatepass") for u in urls]
    flat = np.frombuffer(b"".join(b"\0" * ORDER + d + b"\3" for d in data), np.uint8).astype(np.int64)
    lengths = np.array([len(d) + 1 for d in data], np.int64)
    at = np.arange(lengths.sum()) + np.repeat(ORDER * np.arange(1, len(data) + 1), lengths)
    context = np.zeros(len(at), np.int64)
    keys, heads = [], []
    for k in range(ORDER + 1):
        if k:
            context = context | flat[at - k] << 8 * k
        heads.append(context | (k + 8) << 48)
        keys.append(context | flat[at] | k << 48)
    return keys, heads, lengths


_LOWER_CASE = {i: i + 32 for i in range(65, 91)}


def score(models: Models, urls: list[str | None]) -> np.ndarray:
    """Length-normalised difference of log-likelihoods, accepted minus rejected."""
    if not urls:
        return np.zeros(0)
    keys, heads, lengths = url_keys(urls)
    p = np.full((2, len(keys[0])), 1 / 256)
    for key, head in zip(keys, heads):
        p = (models.of(key) + SMOOTHING * p) / (models.of(head) + SMOOTHING)
    ratio = np.add.reduceat(np.log(p[1]) - np.log(p[0]), np.concatenate([[0], np.cumsum(lengths)[:-1]]))
    return ratio / lengths


def count_models(examples: DataFrame) -> Models:
    """Sum the counts of all keys over all examples (url, accepted)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, accepted = batch.column("url").to_pylist(), batch.column("accepted").to_pylist()
            for c in (0, 1):
                own = [u for u, a in zip(urls, accepted) if a == bool(c)]
                if own:
                    keys, heads, _ = url_keys(own)
                    key, n = np.unique(np.concatenate(keys + heads), return_counts=True)
                    none = np.zeros(len(n), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(none if c else n), pa.array(n if c else none)], ["key", "n0", "n1"])

    summed = examples.mapInArrow(count, "key long, n0 long, n1 long").groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    table = stored(summed, "url-keys")
    if table.count() > BROADCAST_KEYS:
        return Models(None, None, table)
    found = table.toArrow().sort_by("key")
    return Models(found["key"].to_numpy(), np.stack([found["n0"].to_numpy(), found["n1"].to_numpy()]).astype(float))


def scored(urls: DataFrame, models: Models) -> DataFrame:
    """Add `score` to all rows."""
    if models.table is not None:
        return scored_by_join(urls, models.table)
    shared = urls.sparkSession.sparkContext.broadcast(models)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array(score(shared.value, batch.column("url").to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, "score"])

    return urls.mapInArrow(add, urls.select("*", F.lit(0.0).alias("score")).schema)


def scored_by_join(urls: DataFrame, table: DataFrame) -> DataFrame:
    """The same scores with the keys of distinct urls joined to the counts, which stay distributed."""
    distinct = stored(urls.select("url").distinct().withColumn("n", F.monotonically_increasing_id()), "urls")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, heads, lengths = url_keys(batch.column("url").to_pylist())
            n = np.repeat(batch.column("n").to_numpy(), lengths)
            place = np.arange(len(n)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            for part in (*keys, *heads):
                yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(place.astype(np.int32)), pa.array(part)], ["n", "place", "key"])

    each = distinct.mapInArrow(explode, "n long, place int, key long").join(table, "key", "left")
    order = F.shiftright("key", 48).cast("int")
    count = lambda k, c: F.coalesce(F.max(F.when(order == k, F.col(c))), F.lit(0)).alias(f"{c}_{k}")
    kinds = [k + more for k in range(ORDER + 1) for more in (0, 8)]
    each = each.groupBy("n", "place").agg(*(count(k, c) for k in kinds for c in ("n0", "n1")))
    logs = []
    for c in ("n0", "n1"):
        p = F.lit(1 / 256)
        for k in range(ORDER + 1):
            p = (F.col(f"{c}_{k}") + SMOOTHING * p) / (F.col(f"{c}_{k + 8}") + SMOOTHING)
        logs.append(F.log(p))
    total = each.groupBy("n").agg((F.sum(logs[1] - logs[0]) / F.count("*")).alias("score"))
    named = distinct.join(total, "n").select(F.col("url").alias("of"), "score")
    return urls.join(named, F.col("url").eqNullSafe(F.col("of")), "left").drop("of")


def calibrate(models: Models, examples: DataFrame) -> Models:
    """Fit slope and offset on the scores of examples left out, counted in fixed bins."""
    limit = WIDEST * BINS_PER_UNIT
    place = F.greatest(F.least(F.floor(F.col("score") * BINS_PER_UNIT), F.lit(limit)), F.lit(-limit))
    bins = scored(examples, models).groupBy(place.alias("bin"), "accepted").count().toPandas()
    x = (bins["bin"].to_numpy(float) + 0.5) / BINS_PER_UNIT
    n, y = bins["count"].to_numpy(float), bins["accepted"].to_numpy(bool)
    yes, no = n[y].sum(), n[~y].sum()
    goal = np.where(y, (yes + 1) / (yes + 2), 1 / (no + 2))
    w = np.zeros(2)
    design = np.column_stack([x, np.ones(len(x))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -40, 40)))
        step = np.linalg.solve(
            design.T @ (design * (n * p * (1 - p))[:, None]) + 1e-3 * np.eye(2), design.T @ (n * (p - goal)) + 1e-3 * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    models.slope, models.offset = float(w[0]), float(w[1])
    return models


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """Judge all urls: (key, host, path, rule, verdict, score, accept_probability)."""
    host, path = split_url(F.col(url))
    base = pages.select(F.col(key), F.col(url).alias("url"), F.coalesce(host, F.lit("")).alias("host"),
                        F.coalesce(path, F.lit("")).alias("path"))
    decided, rule = rule_of(F.col("host"), F.col("path"), rules)
    judged = base.withColumns({"decided": decided, "rule": rule})
    examples = judged.filter(F.col("decided").isNotNull()).select("url", (F.col("decided") == "allow").alias("accepted"))
    left_out = F.pmod(F.crc32(F.coalesce("url", F.lit(""))), F.lit(CALIBRATION_FOLDS)) == 0
    models = calibrate(count_models(examples.filter(~left_out)), examples.filter(left_out))
    chance = 1 / (1 + F.exp(-(F.col("score") * models.slope + models.offset)))
    return scored(judged, models).select(
        key, "host", "path", "rule",
        F.coalesce("decided", F.when(chance >= 0.5, "allow").otherwise("block")).alias("verdict"),
        "score", chance.alias("accept_probability"))
