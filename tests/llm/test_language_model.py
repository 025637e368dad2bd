"""The learner by its definition, its sparsity, what counts as a letter, and the calibration."""

import math
import random
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fichaflow.llm import language_id, queries

FOLDER = "/root/testdata/sf0.001"


def test_letters_are_letters_alone():
    for text in ("½ ² ³", "١٢٣ 456", "Ⅻ ①", "_ - ́", "", " \t"):
        assert language_id.features(text)[0].size == 0, text
    for text in ("a", "é", "ß", "语", "ª", "½a²"):
        assert language_id.features(text)[0].size > 0, text
    rnd = random.Random(1)
    for _ in range(300):
        text = "".join(chr(rnd.choice([rnd.randrange(0x250), rnd.randrange(0xD800), rnd.randrange(0x10000, 0x20000)])) for _ in range(4))
        letters = any(unicodedata.category(c).startswith("L") for c in text.lower())
        assert (language_id.features(text)[0].size > 0) == letters, ascii(text)


def plain_learner(examples, width, slots):
    """Follow the regularised leader, coordinate by coordinate."""
    z, n = [[0.0] * width for _ in range(slots + 1)], [[0.0] * width for _ in range(slots + 1)]
    l1, l2, alpha, beta = language_id.L1, language_id.L2, language_id.ALPHA, language_id.BETA

    def weight(i, k):
        if abs(z[i][k]) <= l1:
            return 0.0
        return -(z[i][k] - math.copysign(l1, z[i][k])) / ((beta + math.sqrt(n[i][k])) / alpha + l2)

    for _ in range(language_id.EPOCHS):
        for x, y in examples:
            x = [*x, (slots, 1.0)]
            logits = [sum(v * weight(i, k) for i, v in x) for k in range(width)]
            top = max(logits)
            p = [math.exp(v - top) for v in logits]
            p = [v / sum(p) for v in p]
            old = [[weight(i, k) for k in range(width)] for i, _ in x]
            for (i, v), ws in zip(x, old):
                for k in range(width):
                    g = v * (p[k] - (k == y))
                    z[i][k] += g - (math.sqrt(n[i][k] + g * g) - math.sqrt(n[i][k])) / alpha * ws[k]
                    n[i][k] += g * g
    return [[weight(i, k) for k in range(width)] for i in range(slots + 1)]


def test_learner_is_its_definition(monkeypatch):
    monkeypatch.setattr(language_id, "SLOTS", 64)
    texts = ["the house", "das haus", "la casa", "the cat", "die katze", "el gato", ""]
    languages = ["en", "de", "es", "en", "de", "es", "en"]
    model = language_id.LanguageModel(["de", "en", "es"], np.linspace(1, 3, 64), np.zeros((64, 3)), np.zeros(3))
    weights, bias = language_id.learn_part(model, texts, languages)
    examples = [(list(zip(*(a.tolist() for a in model.vector(t)))), ["de", "en", "es"].index(x)) for t, x in zip(texts, languages) if t]
    plain = plain_learner(examples, 3, 64)
    assert np.allclose(weights, plain[:64]) and np.allclose(bias, plain[64]) and (weights == 0).any()


def test_model_is_sparse_accurate_and_calibrated(spark):
    queries.prepared(spark)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    train = docs.filter(language_id.fold("doc_id", 4) != 2)
    model = language_id.fit(train)
    used = np.zeros(language_id.SLOTS, bool)
    for r in train.collect():
        used[language_id.features(r.text or "")[0]] = True
    assert not model.weights[~used].any()
    assert (model.weights[used] != 0).mean() < 0.5
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.text and r.lang]
    found = [model.predict(r.text) for r in held]
    assert np.mean([p[0] == r.lang for p, r in zip(found, held)]) >= 0.95
    assert all(0 <= s <= 1 for _, s in found)


def test_temperature_makes_documents_left_out_likely(spark):
    """No other divisor on a grid does better."""
    queries.prepared(spark)
    rnd = np.random.RandomState(4)
    model = language_id.LanguageModel(["x", "y"], np.ones(language_id.SLOTS), rnd.normal(0, 3, (language_id.SLOTS, 2)), np.zeros(2))
    rows = [(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}", "xy"[i % 3 == 0]) for i in range(120)]
    t = language_id.temperature(model, spark.createDataFrame(rows, "text string, lang string"))
    z = np.stack([model.logits(a) for a, _ in rows])
    y = np.array(["xy".index(b) for _, b in rows])
    loss = lambda t: -np.log(language_id.softmax(z / t)[np.arange(len(y)), y]).mean()
    assert all(loss(t) <= loss(g) + 1e-6 for g in np.geomspace(0.03, 19, 60))


def test_no_language_is_undetermined(spark):
    queries.prepared(spark)
    docs = spark.createDataFrame([(1, "some text", None), (2, "½ ²", None)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert [r.language.lang for r in language_id.predict(docs, model).collect()] == ["und", "und"]
    assert pytest.approx(0) == language_id.predict(docs, model).agg(F.max("language.score")).first()[0]
