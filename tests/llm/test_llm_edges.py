"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for each operator."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fichaflow.llm import (
    class_lm, components, decontaminate, jaccard_join, language_id, pieces, quality_rules, queries, secret_scan, sharding,
    substring_dedup, url_filter, words,
)

BASE = " ".join(f"word{i}" for i in range(60)) + "."
LONG = " ".join(f"w{i % 977}x{i // 7}" for i in range(60_000)) + "."
ROWS = [
    (1, BASE, "en"), (2, BASE, "en"), (2, BASE, "en"), (3, None, None), (4, "", "en"), (5, " \n\t ", None), (None, BASE, "en"),
    (6, LONG, "de"), (7, BASE + " password=abcdef123456.", "en"), (8, "one two", "en"), (9, "one two", "en"), (10, "123 456", None),
    (11, "x" * 300_000, "de"), (None, None, None),
]
EXTRA = ["id", "row", "n", "size", "secrets", "ids", "kept", "clean_text", "cut", "doc", "words", "key", "shard", "word", "column", "piece", "rest"]


@pytest.fixture(scope="module")
def docs(spark):
    queries.prepared(spark)
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    df = df.withColumns({"source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit(f"extra {c}") for c in EXTRA})


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, " ".join(f"word{i}" for i in range(10, 40))), (2, None), (3, ""), (4, "one two"), (None, BASE), (5, BASE)]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_words_match_the_pattern():
    rnd = random.Random(1)
    for _ in range(200):
        texts = [None if rnd.random() < 0.1 else "".join(rnd.choice("ab é\n\t\x0b  Z") for _ in range(rnd.randrange(20))) for _ in range(rnd.randrange(8))]
        cut = rnd.randrange(len(texts) + 1)
        found = words.Words(pa.array(texts, pa.string()).slice(cut))
        expected = [re.findall(words.WORD_PATTERN, t or "") for t in texts[cut:]]
        assert [[bytes(found.data[found.start[i]:found.end[i]]).decode() for i in range(a, b)]
                for a, b in zip(found.first[:-1], found.first[1:])] == expected
        windows, _ = found.windows(3)
        plain = [tuple(w[i:i + 3]) for w in expected for i in range(len(w) - 2)]
        assert len(windows) == len(plain) and len(set(zip(plain, windows.tolist()))) == len(set(plain)) == len(set(windows.tolist()))


def test_secret_scan_is_a_backtracking_search(spark):
    scanner, rnd = secret_scan.Scanner(), random.Random(3)
    bits = ["password", "token", "=", ": ", '"', "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "é", "x", " ", "\n",
            "Api_Key", "apikey", "aaaaaa", "ghp_", "A" * 36, "eyJabc.", "eyJab", ".", "http://", "u:p", "@", "-----BEGIN ", "RSA ",
            "PRIVATE KEY-----", "xoxb-", "AIza", "sk_live_", "passwd", "ſ", "K"]
    for _ in range(3000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 14)))
        expected = [(m.start(), m.end(), r.kind) for r in secret_scan.RULES for m in re.finditer(r.pattern, text)
                    if len(m[0]) >= r.min_length and (not r.group or len(m[r.group]) >= r.min_group)]
        assert sorted(expected) == sorted((x["start"], x["end"], x["kind"]) for x in (secret_scan.in_code_points(scanner, text) if text else []))


def test_secret_scan(spark, docs):
    found = secret_scan.scan_secrets(docs)
    rows = {r.doc_id: r.secrets for r in found.collect()}
    start = len(BASE) + 1
    assert len(found.columns) == len(docs.columns) and rows[3] == rows[4] == rows[11] == []
    assert [tuple(s) for s in rows[7]] == [("assign", start, start + 22)]
    clean = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert clean[7] == BASE + " [secret]" and clean[3] is None and clean[6] == LONG
    assert secret_scan.scan_secrets(docs.limit(0)).count() == 0


def test_quality_rules(spark, docs):
    found = quality_rules.clean_lines(docs)
    rows = {r.doc_id: r for r in found.collect()}
    assert found.count() == len(ROWS) and rows[1].kept and rows[6].kept and not rows[3].kept and rows[3].n_words == 0
    assert rows[3].clean_text is None and rows[4].clean_text == "" and rows[1].clean_text == BASE and rows[1].key == "extra key"
    text = "\n".join(["Home | News | Sport | Shop", "All rights reserved.", "no end", "so so so so so so.", "a#b%c$.", BASE, BASE])
    one = quality_rules.clean_lines(spark.createDataFrame([(text,)], "text string")).first()
    assert (one.clean_text, one.n_failed_lines, one.n_dup_lines, one.n_lines) == (f"{BASE}\n{BASE}", 5, 1, 7)
    assert quality_rules.clean_lines(docs.limit(0)).count() == 0


def test_substring_dedup(spark, docs):
    found = substring_dedup.remove_repeats(docs)
    rows = {(r.doc_id, r.n_words): r for r in found.collect()}
    assert found.count() == len(ROWS)
    # rows that repeat an id stand for one document: the windows of both begin at the same places
    assert (rows[1, 60].n_removed, rows[2, 60].n_removed, rows[None, 60].n_removed) == (0, 60, 0)
    assert rows[7, 61].n_removed == 60 and rows[7, 61].kept_text == "password=abcdef123456."
    assert rows[6, 60_000].n_removed == 0 and rows[3, 0].kept_text == "" and rows[11, 1].n_removed == 0
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_substring_dedup_with_hot_parts(spark, monkeypatch):
    """Parts whose windows are dealt by their own hash give the same result."""
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice("abc") for _ in range(rnd.randrange(60)))) for i in range(80)]
    expected, seen = {}, set()
    for i, text in rows:
        w = text.split()
        gone = set()
        for k in range(len(w) - 4):
            key = tuple(w[k:k + 5])
            gone |= set(range(k, k + 5)) if key in seen else set()
            seen.add(key)
        expected[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for overload in (8, 0):
        monkeypatch.setattr(substring_dedup, "OVERLOAD", overload)
        assert {r.doc_id: r.kept_text for r in substring_dedup.remove_repeats(df, size=5).collect()} == expected


@pytest.mark.parametrize("partitions", [1, 2, 5])
def test_substring_dedup_of_a_repeated_row(spark, partitions):
    """A row that occurs twice keeps its words if no smaller document has them, however the rows are dealt to tasks."""
    texts = [" ".join(f"t{k}word{i}" for i in range(40)) for k in range(3)]
    rows = [(1, texts[0]), (2, texts[1]), (2, texts[1]), (3, texts[1]), (4, texts[2] + " " + texts[2]), (4, texts[2] + " " + texts[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    found = sorted((r.doc_id, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(df).collect())
    twice = (4, 40, texts[2])
    assert found == [(1, 0, texts[0]), (2, 0, texts[1]), (2, 0, texts[1]), (3, 40, ""), twice, twice]


def test_pieces(spark, docs):
    vocabulary = pieces.Pieces.load(queries.PIECES_FILE)
    rows = pieces.decode_ids(pieces.encode_texts(docs, queries.PIECES_FILE), queries.PIECES_FILE).collect()
    assert len(rows) == len(ROWS) and all(r.decoded == r.text for r in rows)
    assert {r.ids is None for r in rows if r.text is None} == {True} and [r.ids for r in rows if r.text == ""] == [[]]
    assert pieces.encode_texts(docs.limit(0), queries.PIECES_FILE).count() == 0
    rnd = random.Random(1)
    some = {"".join(rnd.choice(" theraoninsé漢▁qz") for _ in range(rnd.randrange(1, 9))) for _ in range(500)}
    assert vocabulary.encode_words(some) == {w: plain_viterbi(vocabulary, w) for w in some}


def plain_viterbi(vocabulary, word):
    best = [(0.0, [])]
    for end in range(1, len(word) + 1):
        top = None
        for begin in range(end):
            piece = word[begin:end]
            if piece in vocabulary.found:
                score, ids = vocabulary.found[piece][0], [vocabulary.found[piece][1]]
            elif begin == end - 1:
                score, ids = vocabulary.unknown, vocabulary.fallback(piece)
            else:
                continue
            if top is None or best[begin][0] + score > top[0]:
                top = best[begin][0] + score, best[begin][1] + ids
        best.append(top)
    return best[-1][1]


def test_url_filter(spark):
    rows = [(1, "http://a.com/x"), (2, "HTTP://WWW.Example.com/en/1"), (3, None), (4, ""), (5, "no url"), (6, "http://x.net/fr/"), (6, "http://x.net/fr/"),
            (7, "http://x.org?q=/"), (8, "http://com/en"), (9, "http://net/fr/" + "y" * 50_000), (None, "http://b.com/z")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("score", F.lit("clash"))
    found = url_filter.judge_urls(pages).collect()
    by = {r.page_id: r for r in found}
    assert len(found) == len(rows)
    assert (by[1].verdict, by[1].rule) == ("allow", "com/") and (by[2].host, by[2].rule) == ("www.example.com", "www.example.com/en/")
    assert by[6].verdict == by[9].verdict == "block" and (by[3].host, by[3].path, by[3].rule) == ("", "", None)
    assert (by[7].host, by[7].path) == ("x.org", "") and by[8].rule == "com/" and {r.verdict for r in found} == {"allow", "block"}
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages.filter("page_id in (3, 7)")).collect()} == {"allow"}


def test_language_id(spark, docs):
    model = language_id.fit(docs)
    rows = {r.doc_id: r.language for r in language_id.predict(docs.withColumn("language", F.lit(1)), model).collect()}
    assert rows[3] == rows[4] == rows[5] == rows[10] == ("und", 0.0) and rows[11].lang in ("de", "en")
    empty = language_id.fit(docs.limit(0))
    assert {r.language.lang for r in language_id.predict(docs, empty).collect()} == {"und"}


def test_sharding(spark, docs):
    rows = sharding.shard_documents(docs, shards=3).collect()
    counts = np.bincount([r.shard for r in rows])
    assert sorted(counts) == [4, 5, 5] and all(sorted(r.slot for r in rows if r.shard == k) == list(range(counts[k])) for k in range(3))
    assert {r["size"] for r in rows if r.id == 3} == {8}
    assert sharding.shard_documents(docs.limit(0)).count() == 0
    # a group larger than a shard fills shards one after the other; all rows in one group
    many = spark.createDataFrame([(i, "same" if i % 3 else f"own {i}") for i in range(300)], "doc_id long, text string")
    rows = sharding.shard_documents(many, shards=6).collect()
    same = np.bincount([r.shard for r in rows if r.id % 3], minlength=6)
    assert np.bincount([r.shard for r in rows]).tolist() == [50] * 6 and sorted(same)[2:] == [50] * 4
    one = sharding.shard_documents(many.withColumn("text", F.lit("same")), shards=7).collect()
    assert sorted(np.bincount([r.shard for r in one])) == [42] + [43] * 6


@pytest.mark.parametrize("share, size", [(1.0, 2), (0.9, 2), (1.0, 20), (0.9, 20)])
def test_sharding_where_most_rows_are_linked(spark, share, size):
    """Groups are cut by the edges of shards at most, and not at all where rows without links leave room."""
    n, shards = 4_800, 24
    df = spark.createDataFrame([(i, f"group {i // size}" if i < share * n else f"own {i}") for i in range(n)], "doc_id long, text string")
    rows = sharding.shard_documents(df, shards=shards).collect()
    assert np.bincount([r.shard for r in rows]).tolist() == [n // shards] * shards
    groups = {}
    for r in rows:
        if r.id < share * n:
            groups.setdefault(r.id // size, set()).add(r.shard)
    assert sum(len(g) > 1 for g in groups.values()) <= (shards - 1 if share == 1 else 0)


def test_class_lm(spark, docs):
    for train in (docs, docs.limit(0)):
        model, counts = class_lm.learn(train.select("text"))
        rows = {r.id: r for r in class_lm.score_texts(docs, model, counts).collect()}
        assert rows[3].n_tokens == rows[4].n_tokens == 1 and rows[6].n_tokens == 60_001 and all(np.isfinite(r.score) for r in rows.values())
    assert rows[6].n_known == 0 and rows[6].base_score == 0
    pairs = np.zeros((9, 9))
    for a, b in [(0, 1), (2, 3), (0, 3), (2, 1)] * 50 + [(1, 8), (3, 8), (8, 0), (8, 2)] * 25:
        pairs[a, b] += 1
    cls = class_lm.exchange(pairs, 4, classes=2)
    assert cls[0] == cls[2] != cls[1] == cls[3]


def test_class_lm_rare_words_are_joined(spark, docs, monkeypatch):
    train = docs.select("text")
    model, counts = class_lm.learn(train)
    whole = {r.id: (r.n_known, round(r.base_score, 6)) for r in class_lm.score_texts(docs, model, counts).collect()}
    monkeypatch.setattr(class_lm, "HEAD", 5)
    model, counts = class_lm.learn(train)
    assert {r.id: (r.n_known, round(r.base_score, 6)) for r in class_lm.score_texts(docs, model, counts).collect()} == whole


def test_jaccard_join(spark, docs):
    rows = [(r.id, r.n_shingles, r.component_id) for r in jaccard_join.link_sets(docs).collect()]
    by = {i: (n, c) for i, n, c in rows}
    assert len(rows) == len(ROWS) and by[1] == by[2] == (56, 1) and by[7] == (57, 1) and by[3] == (0, 3) and by[9] == (1, 8)
    assert by[11] == (1, 11) and [c for i, _, c in rows if i is None] == [None, None]
    assert jaccard_join.link_sets(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_join_against_all_pairs(spark, seed):
    """Chains of near copies, whose ends are not alike, and sets that share frequent shingles."""
    rnd = random.Random(seed)
    texts, common = [], [f"c{i}" for i in range(30)]
    for _ in range(6):
        w = [f"v{rnd.randrange(40)}" for _ in range(rnd.randrange(5, 70))]
        for _ in range(12):
            w = list(w)
            w[rnd.randrange(len(w))] = f"v{rnd.randrange(400)}"
            texts.append(" ".join(w + (common if rnd.random() < 0.3 else [])))
    order = list(range(len(texts)))
    rnd.shuffle(order)
    sets = {i: {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for i, t in zip(order, texts)}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(list(zip(order, texts)), "doc_id long, text string")
    assert {r.id: r.component_id for r in jaccard_join.link_sets(df).collect()} == root


def test_components(spark):
    links = [(i + 1, i) for i in range(40)] + [(100, 200), (300, 200), (7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    found = {r.node: r.root for r in components.components(df).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100}
    assert components.components(df.limit(0)).count() == 0


def test_decontamination(spark, docs, benchmark):
    found = sorted((r.doc, r.item, r.start, round(r.similarity, 3)) for r in decontaminate.find_leaks(docs, benchmark).collect())
    assert found == [(d, i, s, 1.0) for d, i, s in [(1, 1, 10), (1, 5, 0), (2, 1, 10), (2, 5, 0), (7, 1, 10), (7, 5, 0), (8, 4, 0), (9, 4, 0)]]
    assert decontaminate.find_leaks(docs.limit(0), benchmark).count() == 0 == decontaminate.find_leaks(docs, benchmark.limit(0)).count()


def test_decontamination_of_near_copies(spark):
    """Every window at the similarity is found, by comparing all windows of all documents, also with shuffled anchors."""
    rnd = random.Random(2)
    items = {i: [f"b{rnd.randrange(30)}" for _ in range(rnd.randrange(12, 60))] for i in range(12)}
    rows = []
    for d in range(60):
        w = list(items[d % 12])
        for _ in range(rnd.randrange(4)):
            k = rnd.choice([0, len(w) - 1, rnd.randrange(len(w))])
            w[k:k + 1] = rnd.choice([[], [f"b{rnd.randrange(30)}"], [w[k], "new"]])
        rows.append((d, " ".join([f"x{rnd.randrange(9)}" for _ in range(rnd.randrange(9))] + w + ["y"] * rnd.randrange(9))))

    def sims(words, item):
        from collections import Counter
        n = len(item)
        grams = lambda w: Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4)))
        for k in range(max(1, len(words) - n + 1)):
            a, b = grams(words[k:k + n]), grams(item)
            yield sum((a & b).values()) / sum((a | b).values())

    expected = {(d, i): round(max(sims(t.split(), w)), 6) for d, t in rows for i, w in items.items()}
    expected = {k: s for k, s in expected.items() if s >= 0.8}
    assert len(expected) > 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    assert {(r.doc, r.item): round(r.similarity, 6) for r in decontaminate.find_leaks(df, bench).collect()} == expected
    assert len(expected) == decontaminate.find_leaks(df, bench, radius=decontaminate.RADIUS).count()


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_decontamination_of_short_documents(spark, monkeypatch, broadcast):
    """Documents of 80-90 % of an item, cut at either end, are found wherever the item's longest words are."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ANCHORS", broadcast)
    rnd = random.Random(4)
    rows, items, expected = [], [], {}
    for i in range(20):
        n = rnd.randrange(24, 60)
        item = [f"w{rnd.randrange(10**6):06d}" for _ in range(n)]
        # the longest words stand at the end that is cut off
        item[-1], item[0] = ("x" * 30, item[0]) if i % 2 else (item[-1], "x" * 30)
        items.append((i, " ".join(item)))
        for cut in range(1, n):
            similarity = (n - 4 - cut) / (n - 4)
            if similarity < 0.8 - 1e-12:
                break
            words = item[:-cut] if i % 2 else item[cut:]
            expected[len(rows), i] = round(similarity, 6)
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc, r.item): round(r.similarity, 6) for r in decontaminate.find_leaks(df, bench).collect()} == expected


def test_stages(spark, docs, tmp_path, benchmark):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    now, names = docs, []
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        new = stage(spark, now, str(tmp_path))
        path = f"{tmp_path}/{len(names)}"
        new.write.parquet(path)
        now = spark.read.parquet(path)
        names.append(name)
        assert now.columns == docs.columns
    # documents 1, 2 and 7 leak item 5, as does the copy without an id, which has no group and no finding
    assert sorted((r.doc_id or 0, r.key) for r in now.collect()) == [(0, "extra key"), (6, "extra key")]


def test_frequent_words_are_encoded_once_however_many_others_come(monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY_WORDS", 20)
    encoder = pieces.Encoder(pieces.Pieces.load(queries.PIECES_FILE))
    done, encode = [], encoder.pieces.encode_words

    def counted(words):
        words = list(words)
        done.extend(words)
        return encode(words)

    encoder.pieces.encode_words = counted
    texts = [f"again word{k}x word{k}y word{k}z ▁" for k in range(60)]
    found = [encoder.encode([t])[0].tolist() for t in texts]
    assert done.count(" again") == 1 and len(done) == 182 and len(encoder.memory) + len(encoder.older) < 60
    assert all(encoder.pieces.decode(ids) == t for ids, t in zip(found, texts))


def test_best_paths_over_pieces_are_those_of_all_cuts():
    scores = {"a": -1.0, "ab": -2.5, "b": -1.5, "abab": -4.0, "bab": -2.0, "c": -3.0, "bc": -4.5, "abc": -6.0, "cab": -5.0}
    held = pieces.Pieces([*scores, *(f"<0x{b:02X}>" for b in range(256))], [*scores.values(), *[0.0] * 256], list(range(9, 265)))

    def cuts(word):
        return [()] if not word else [(word[:k], *rest) for k in range(1, len(word) + 1) if word[:k] in scores for rest in cuts(word[k:])]

    words = [w for n in range(1, 7) for w in map("".join, itertools.product("abc", repeat=n))]
    for word, ids in held.encode_words(words).items():
        # among equal sums the last piece is the longer one, at each position
        best = max(cuts(word), key=lambda cut: (sum(scores[p] for p in cut), [len(p) for p in reversed(cut)]))
        assert ids == [list(scores).index(p) for p in best], word
