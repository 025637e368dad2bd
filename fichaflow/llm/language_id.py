"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the n-grams of one to three characters of the lower-cased text, everything but letters being one blank,
hashed into SLOTS entries. Spark counts in how many training documents each occurs, over all of them; a document
is the unit vector of (1 + log count) * idf. Weights are learned by follow-the-regularised-leader with L1 and L2 penalties
on a sample of about SAMPLE training documents: learners see about LEARNER of them each, and Spark averages their
weights; a weight that most learners leave at zero is zero. A fifth of the sample is left to set the temperature that divides the logits. The sample is chosen by a hash
of the id with a threshold from the number of documents, so its size does not grow; all documents are predicted.

A null text and one without letters are `und` with score 0, as is every text when no training document has a language.
Ties go to the language that sorts first. Repeated rows, further columns and empty tables need no care.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from fichaflow.llm.words import mix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLOTS, LONGEST = 1 << 15, 3
SAMPLE, LEARNER, EPOCHS = 10_240, 1024, 5
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.1, 0.1
UNDETERMINED = "und"


def _spans(points: list[int]) -> str:
    """A character class of code points, as ranges."""
    out: list[list[int]] = []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


#: What a pattern calls a word character without being a letter: digits, fractions, superscripts and other numbers.
_NUMBERS = _spans([p for p in range(sys.maxunicode + 1) if (c := chr(p)).isalnum() and not c.isalpha()])
_NO_LETTERS = re.compile(rf"[\W_{_NUMBERS}]+")


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots of a text's n-grams and 1 + log of their counts; none if it has no letters."""
    plain = _NO_LETTERS.sub(" ", text.lower()).strip(" ")
    if not plain:
        return np.zeros(0, np.int64), np.zeros(0)
    codes = np.frombuffer(f" {plain} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    found, gram = [], np.zeros(len(codes), np.uint64)
    for n in range(1, LONGEST + 1):
        gram = gram[:len(codes) - n + 1] * np.uint64(0x110001) + codes[n - 1:]
        found.append(mix(gram * np.uint64(4) + np.uint64(n)) % np.uint64(SLOTS))
    counts = np.bincount(np.concatenate(found).astype(np.int64), minlength=SLOTS)
    slots = np.flatnonzero(counts)
    return slots, 1 + np.log(counts[slots])


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        slots, tf = features(text)
        x = tf * self.idf[slots]
        return slots, x / max(np.linalg.norm(x), 1e-12)

    def logits(self, text: str) -> np.ndarray | None:
        slots, x = self.vector(text)
        return x @ self.weights[slots] + self.bias if len(slots) else None

    def predict(self, text: str | None) -> tuple[str, float]:
        z = self.logits(text) if text and self.languages else None
        if z is None:
            return UNDETERMINED, 0.0
        p = softmax(z / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Over all rows: documents per slot, and documents; the table has a fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total[features(text or "")[0]] += 1
                n += 1
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(slots, -1)), pa.array(np.append(total[slots], n))], ["slot", "n"])

    found = texts.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    n = found.set_index("slot")["n"]
    out = np.zeros(SLOTS)
    own = n[n.index >= 0]
    out[own.index.to_numpy(np.int64)] = own.to_numpy(float)
    return out, int(n.get(-1, 0))


def learn_part(model: LanguageModel, texts: list[str], languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of one learner that sees some documents a few times."""
    number = {x: i for i, x in enumerate(model.languages)}
    width = len(model.languages)
    z, n = np.zeros((SLOTS + 1, width)), np.zeros((SLOTS + 1, width))
    examples = [(*model.vector(t), number[x]) for t, x in zip(texts, languages)]

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for slots, x, y in examples:
            if not len(slots):
                continue
            at, x = np.append(slots, SLOTS), np.append(x, 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    out = weights(np.arange(SLOTS + 1))
    return out[:SLOTS], out[SLOTS]


def fit(train: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learn from documents that have a language."""
    train = train.filter(F.col(lang).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    seen, total = document_frequencies(train.select("text"))
    idf = np.log((1 + total) / (1 + seen)) + 1
    place = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "id"), 11) / F.lit(float(1 << 53))
    chosen = train.filter(place < SAMPLE / max(total, 1))
    left_out = F.pmod(F.xxhash64(F.lit("temperature"), "id"), F.lit(5)) == 0
    sample, held = chosen.filter(~left_out), chosen.filter(left_out)
    learners = max(1, min(SAMPLE, total) * 4 // 5 // LEARNER)
    languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    width = len(languages)
    model = LanguageModel(languages, idf, np.zeros((SLOTS, width)), np.zeros(width))
    if not languages:
        return model

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["id", "text"], kind="stable")
        order = np.random.default_rng(7).permutation(len(part))
        part = part.iloc[order]
        weights, bias = learn_part(model, [t or "" for t in part["text"]], list(part["lang"]))
        flat = np.concatenate([weights.reshape(-1), bias])
        at = np.flatnonzero(flat)
        return pd.DataFrame({"at": at, "w": flat[at], "rows": len(part)})

    shard = F.pmod(F.xxhash64(F.lit("learner"), "id"), F.lit(learners))
    parts = sample.groupBy(shard.alias("shard")).applyInPandas(learn, "at long, w double, rows long")
    used = max(1, sample.select(shard).distinct().count())
    mean = parts.groupBy("at").agg((F.sum("w") / used).alias("w"), F.count("*").alias("held"))
    mean = mean.filter(2 * F.col("held") >= used).select("at", "w").toPandas()
    flat = np.zeros(SLOTS * width + width)
    flat[mean["at"].to_numpy(np.int64)] = mean["w"].to_numpy(float)
    model.weights, model.bias = flat[:SLOTS * width].reshape(SLOTS, width), flat[SLOTS * width:]
    model.temperature = temperature(model, held)
    return model


def temperature(model: LanguageModel, held: DataFrame) -> float:
    """The divisor of the logits that makes documents left out most likely, by golden section."""
    shared = held.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def logits(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shared.value.logits(t) if t else None)

    rows = held.filter(F.col("lang").isin(model.languages)).select("lang", logits("text").alias("z")).filter("z is not null").toPandas()
    if rows.empty:
        return 1.0
    z = np.stack(rows["z"].map(lambda v: np.asarray(v, float)))
    y = rows["lang"].map({x: i for i, x in enumerate(model.languages)}).to_numpy(np.int64)
    loss = lambda t: -np.log(softmax(z / np.exp(t))[np.arange(len(y)), y] + 1e-300).mean()
    low, high, ratio = np.log(0.02), np.log(20.0), (5 ** 0.5 - 1) / 2
    while high - low > 1e-4:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", into: str = "language") -> DataFrame:
    """Add struct<lang, score> of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang:string,score:double>")
    def add(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang", "score"])

    return docs.withColumn(into, add(F.col(f"`{text}`")))


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo the folds; 0 for a null key."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(folds))
