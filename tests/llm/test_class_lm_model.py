"""The class model by its definition: exchange as a local optimum, and scores of small corpora in plain Python."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fichaflow.llm import class_lm, queries


def test_exchange_finds_the_classes_of_a_grammar():
    """Words that follow a cycle of four classes are told apart, whatever their frequency."""
    rnd = random.Random(1)
    kind = [i % 4 for i in range(48)]
    by_kind = [[w for w in range(48) if kind[w] == k] for k in range(4)]
    pairs = np.zeros((49, 49))
    for _ in range(300):
        text = [by_kind[k % 4][min(int(rnd.expovariate(0.3)), 11)] for k in range(rnd.randrange(4), 30)]
        for a, b in zip([48, *text], [*text, 48]):
            pairs[a, b] += 1
    cls = class_lm.exchange(pairs, 48, classes=4, tolerance=0)
    seen = [w for w in range(48) if pairs[w].sum()]
    assert all(len({int(cls[w]) for w in seen if kind[w] == k}) == 1 for k in range(4)) and len(set(cls[seen])) == 4 and cls[48] == 4


def test_no_single_move_raises_the_likelihood():
    rnd = np.random.RandomState(2)
    pairs = rnd.poisson(0.8, (26, 26)).astype(float) * rnd.randint(0, 9, (26, 1))
    cls = class_lm.exchange(pairs, 25, classes=5, tolerance=0)

    def total(c):
        table = np.zeros((6, 6))
        np.add.at(table, (c[:, None], c[None, :]), pairs)
        return class_lm.likelihood(table)

    best = total(cls)
    for w in range(25):
        for k in range(5):
            other = cls.copy()
            other[w] = k
            assert total(other) <= best + 1e-6


def test_scores_are_the_definition(spark, monkeypatch):
    """Counts, classes and smoothing from plain Python over the texts; only the classes are taken from the model."""
    monkeypatch.setattr(class_lm, "CLUSTERED", 12)
    monkeypatch.setattr(class_lm, "HEAD", 20)
    monkeypatch.setattr(class_lm, "CLASSES", 5)
    queries.prepared(spark)
    rnd = random.Random(3)
    lexicon = [f"w{i}" + rnd.choice(["ing", "ed", "é", ""]) for i in range(60)]
    texts = [" ".join(lexicon[min(int(rnd.expovariate(0.08)), 59)] for _ in range(rnd.randrange(0, 40))) for _ in range(60)]
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    model, counts = class_lm.learn(train)
    assert len(model.words.count) == 20 and model.words.clustered == 12

    words = Counter(w for t in texts for w in t.split())
    unit = lambda w: model.words.symbol.get(w.encode(), 12 + zlib.crc32(w.encode()[-3:]) % class_lm.ENDINGS)
    of = lambda w: int(model.cls[unit(w)])
    end = int(model.cls[-1])
    pairs = Counter()
    for t in texts:
        seq = [end, *map(of, t.split()), end]
        pairs.update(zip(seq, seq[1:]))
    width = int(model.cls.max()) + 1
    into, out = Counter(), Counter()
    for (a, b), n in pairs.items():
        into[b] += n
        out[a] += n
    distinct = Counter(of(w) for w in words) + Counter([end])
    z = sum(words.values()) + len(texts) + 0.1 * (len(words) + 2)
    every = sum(pairs.values())

    def probability(c, before, own):
        share = (into[own] + 0.1) / (every + 0.1 * width)
        move = (pairs[before, own] + class_lm.TRANSITION_PRIOR * share) / (out[before] + class_lm.TRANSITION_PRIOR)
        emit = (c + 0.1) / (into[own] + 0.1 * (distinct[own] + 1))
        return class_lm.MIX * move * emit + (1 - class_lm.MIX) * (c + 0.1) / z

    asked = [*texts[:20], "never seen words", "w1 neverseening w3", "", None]
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    got = {r.id: r for r in class_lm.score_texts(docs, model, counts).collect()}
    for k, t in enumerate(asked):
        ws = (t or "").split()
        seq = [end, *map(of, ws), end]
        amounts = [words[w] for w in ws] + [len(texts)]
        score = sum(math.log10(probability(c, a, b)) for c, a, b in zip(amounts, seq, seq[1:]))
        assert math.isclose(got[k].score, score, rel_tol=1e-9)
    # each context is a distribution over the vocabulary, one unknown word included
    for before in {end, *(of(w) for w in words)}:
        known = sum(probability(words[w], before, of(w)) for w in words) + probability(len(texts), before, end)
        assert 0.5 < known <= 1 + 1e-9


def test_head_is_filled_when_all_words_tie(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "HEAD", 10)
    counts = spark.range(500).select(F.format_string("w%03d", "id").cast("binary").alias("word"), F.lit(1).cast("long").alias("n"))
    assert [w for w, _ in class_lm.frequent(counts)] == [f"w{i:03d}".encode() for i in range(10)]
    assert class_lm.frequent(counts.limit(0)) == []


def test_words_outside_the_table_of_units_are_exchanged_alone(spark, monkeypatch):
    """Classes, transitions and scores of the whole vocabulary from plain Python; only the classes of the units are taken."""
    monkeypatch.setattr(class_lm, "CLUSTERED", 12)
    monkeypatch.setattr(class_lm, "HEAD", 20)
    monkeypatch.setattr(class_lm, "CLASSES", 5)
    monkeypatch.setattr(class_lm, "COUNTED_TOKENS", 100)
    monkeypatch.setattr(class_lm, "SWEPT_ROWS", 7)
    monkeypatch.setattr(class_lm, "FEW", 3)
    queries.prepared(spark)
    rnd = random.Random(4)
    lexicon = [f"w{i}" + rnd.choice(["ing", "ed", "é", ""]) for i in range(60)]
    texts = [" ".join(lexicon[min(int(rnd.expovariate(0.08)), 59)] for _ in range(rnd.randrange(0, 40))) for _ in range(60)]
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    start, _ = class_lm.learn(train)
    model, counts = class_lm.place_words(train, start)

    words = Counter(w for t in texts for w in t.split())
    ending = lambda w: int(start.cls[12 + zlib.crc32(w.encode()[-3:]) % class_lm.ENDINGS])
    end = int(start.cls[-1])
    units = list(start.words.count)[:12]
    cls = {w: int(start.cls[units.index(w.encode())]) if w.encode() in units else ending(w) for w in words}
    moving = [w for w in words if w.encode() not in units]
    beside = {w: Counter() for w in words}
    for t in texts:
        own, seq = t.split(), [end, *map(cls.get, t.split()), end]
        for k, w in enumerate(own):
            beside[w].update([("before", seq[k]), ("after", seq[k + 2])])

    def likelihood(c):
        around, total = Counter(), Counter()
        for w in words:
            total[c[w]] += words[w]
            for where, n in beside[w].items():
                around[c[w], where] += n
        return sum(n * math.log(n) for n in around.values()) - 2 * sum(n * math.log(n) for n in total.values())

    now, first, share, turn = likelihood(cls), dict(cls), 1.0, 0
    while share * len(moving) >= 1:
        moved = dict(cls)
        for w in moving:
            if zlib.crc32(w.encode() + bytes([0, turn])) < share * 2**32:
                gains = [likelihood({**cls, w: k}) for k in range(end)]
                if max(gains) > gains[cls[w]] + 1e-9:
                    moved[w] = next(k for k in range(end) if gains[k] > max(gains) - 1e-9)
        after = likelihood(moved)
        turn += 1
        if after <= now:
            share /= 2
            continue
        small = after - now < class_lm.TOLERANCE * share * abs(now)
        cls, now = moved, after
        if small:
            break
        share = min(1.0, 2 * share)
    assert sum(cls[w] != first[w] for w in moving) > 10

    table = {w.decode(): int(model.cls[s]) for w, s in model.words.symbol.items()}
    alone = {bytes(r.word).decode(): (r.n, r.cls) for r in counts.collect()}
    assert alone == {w: (words[w], cls[w]) for w in moving} and table == {w: cls[w] for w in table} and len(table) == 20

    of = lambda w: cls[w] if w in cls else ending(w)
    pairs = Counter()
    for t in texts:
        seq = [end, *map(of, t.split()), end]
        pairs.update(zip(seq, seq[1:]))
    into, out = Counter(), Counter()
    for (a, b), n in pairs.items():
        into[b] += n
        out[a] += n
    distinct = Counter(cls.values()) + Counter([end])
    z, every = sum(words.values()) + len(texts) + 0.1 * (len(words) + 2), sum(pairs.values())

    def probability(c, before, own):
        share = (into[own] + 0.1) / (every + 0.1 * (end + 1))
        move = (pairs[before, own] + class_lm.TRANSITION_PRIOR * share) / (out[before] + class_lm.TRANSITION_PRIOR)
        return class_lm.MIX * move * (c + 0.1) / (into[own] + 0.1 * (distinct[own] + 1)) + (1 - class_lm.MIX) * (c + 0.1) / z

    filled = class_lm.with_classes(class_lm.encode(train.selectExpr("0L AS doc_id", "text"), model), model, counts)
    model = class_lm.learn_context(filled, model, counts)
    asked = [*texts[:20], "never seen words", "w1 neverseening w3", "", None]
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    got = {r.id: r for r in class_lm.score_texts(docs, model, counts).collect()}
    for k, t in enumerate(asked):
        seq = [end, *map(of, (t or "").split()), end]
        amounts = [words[w] for w in (t or "").split()] + [len(texts)]
        assert math.isclose(got[k].score, sum(math.log10(probability(c, a, b)) for c, a, b in zip(amounts, seq, seq[1:])), rel_tol=1e-9)
        assert math.isclose(got[k].base_score, sum(math.log10((c + 0.1) / z) for c in amounts), rel_tol=1e-9)


def test_rare_words_of_one_ending_are_told_apart(spark, monkeypatch, tmp_path):
    """Words that end alike and are as frequent, but stand before or after a frequent word, have no class in common."""
    monkeypatch.setattr(class_lm, "CLUSTERED", 4)
    monkeypatch.setattr(class_lm, "HEAD", 6)
    monkeypatch.setattr(class_lm, "CLASSES", 4)
    texts = [f"a{i % 20}ing the b{i % 20}ing of" for i in range(200)] + ["a1ing the b1ing of", "b1ing the a1ing of"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in queries.QUERIES["op7_class_lm"](spark, str(tmp_path)).collect()}
    assert math.isclose(rows[200].base_score, rows[201].base_score) and rows[200].score > rows[201].score + 1


def test_placing_without_words_outside_the_units(spark):
    train = spark.createDataFrame([("a b a",), ("b",), (None,), ("",)], "text string")
    for texts in (train, train.limit(0)):
        start, _ = class_lm.learn(texts)
        model, counts = class_lm.place_words(texts, start)
        assert counts.count() == 0 and (model.cls == start.cls).all() and model.words.symbol == start.words.symbol


def test_rows_of_a_word_are_added_up_across_batches(spark, monkeypatch):
    """However small the pieces of texts and batches are, each word has one row, and the same class."""
    monkeypatch.setattr(class_lm, "CLUSTERED", 3)
    monkeypatch.setattr(class_lm, "HEAD", 5)
    monkeypatch.setattr(class_lm, "CLASSES", 3)
    queries.prepared(spark)
    rnd = random.Random(5)
    texts = [" ".join(f"w{min(int(rnd.expovariate(0.1)), 40)}" for _ in range(rnd.randrange(0, 30))) for _ in range(60)]
    train = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    start, _ = class_lm.learn(train)
    found = []
    for together, tokens in ((1, 10), (2, 50), (16_384, 2_000_000)):
        monkeypatch.setattr(class_lm, "TOGETHER", together)
        monkeypatch.setattr(class_lm, "COUNTED_TOKENS", tokens)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(together))
        rows = class_lm.place_words(train, start)[1].collect()
        found.append({bytes(r.word).decode(): (r.n, r.cls) for r in rows})
        assert len(rows) == len(found[-1])
    queries.prepared(spark)
    words = Counter(w for t in texts for w in t.split())
    assert {w: n for w, (n, _) in found[0].items()} == {w: words[w] for w in found[0]} and len(found[0]) == len(words) - 3
    assert found[0] == found[1] == found[2]


def test_words_with_equal_neighbours_and_class_are_moved_once():
    beside = [([1, 130], [1, 1]), ([1, 130], [1, 2]), ([2], [3]), ([1, 130], [1, 1])] * 500
    columns = class_lm.packed(
        np.repeat(np.arange(2000), [len(c) for c, _ in beside]), np.concatenate([c for c, _ in beside]), np.concatenate([n for _, n in beside]), 2000)
    cls = np.arange(2000) // 1000
    first, number = class_lm.alike(pa.RecordBatch.from_arrays(columns, ["codes", "amounts"]), cls)
    assert first.tolist() == [0, 1, 2, 1000, 1001, 1002]
    assert all(beside[i] == beside[first[k]] and cls[i] == cls[first[k]] for i, k in enumerate(number))
