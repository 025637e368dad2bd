"""Cases that earlier versions got wrong: hashes with constructed equals, repeated ids, long texts, clean lines of marks."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fichaflow.llm import decontaminate, jaccard_join, quality_rules, queries, secret_scan, storage, substring_dedup, words


def thue_morse(n, a="a", b="b"):
    return "".join(a if i.bit_count() % 2 == 0 else b for i in range(n))


@pytest.mark.parametrize("size", [16, 64, 65, 256, 2048])
def test_words_of_the_thue_morse_kind_differ(size):
    pair = [thue_morse(size), thue_morse(size, "b", "a")]
    held = words.Words(pa.array([" ".join(pair)])).hashes()
    assert held[0] != held[1]
    assert set(jaccard_join.shingle_sets(pa.array([pair[0]]), 5)[1]) != set(jaccard_join.shingle_sets(pa.array([pair[1]]), 5)[1])


def test_word_hashes_tell_words_apart():
    """Zero bytes, lengths around the steps of eight, and where a word lies in the batch."""
    rnd = random.Random(1)
    kinds = {"".join(rnd.choice("ab\0é") for _ in range(rnd.choice([1, 2, 7, 8, 9, 15, 16, 17, 31, 63, 64, 65, 66, 200]))) for _ in range(3000)}
    kinds |= {"a" * n for n in range(1, 200)} | {"a\0", "a\0\0", "\0", "\0\0"}
    texts = [" ".join(rnd.sample(sorted(kinds), 40)) for _ in range(100)] + sorted(kinds)
    of = {}
    for k in range(0, len(texts), 37):
        w = words.Words(pa.array(texts[k:k + 37]))
        for a, b, h in zip(w.start, w.end, w.hashes().tolist()):
            assert of.setdefault(bytes(w.data[a:b]), h) == h
    assert len(set(of.values())) == len(of) == len(kinds)


def test_removed_words_are_equal_words(spark):
    """Windows of words that once had equal hashes stay."""
    a, b = (thue_morse(2048, *x) for x in (("a", "b"), ("b", "a")))
    lines = [" ".join([w] + [f"x{i}" for i in range(19)]) for w in (a, b)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_repeats(df).collect()] == [0, 0]


@pytest.mark.parametrize("order", [1, -1])
def test_a_repeated_id_leaks_in_either_order(spark, order):
    queries.prepared(spark)
    item = " ".join(f"longword{i}" for i in range(40))
    near = " ".join(f"longword{i}" if i % 7 else "other" for i in range(40))
    rows = [(1, near), (1, item)][::order]
    marks = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), marks).collect()
    assert [(r.doc, r.item, r.similarity) for r in found] == [(1, 1, 1.0)]


def plain_print(ws, spark):
    hashes = [r.h for r in spark.createDataFrame([(w,) for w in ws], "w string").select(F.xxhash64("w").alias("h")).collect()]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(ws))
    return bits - (1 << 64) if bits >> 63 else bits


def test_fingerprints_are_majorities(spark):
    rnd = random.Random(2)
    for n in (1, 2, 3, 8, 31, 90):
        ws = [f"w{rnd.randrange(50)}" for _ in range(n)]
        got = spark.createDataFrame([(ws,)], "w array<string>").select(decontaminate.fingerprint(F.col("w"))).first()[0]
        assert got == plain_print(ws, spark)


def test_long_windows_count_bit_by_bit(spark, monkeypatch):
    ws = [f"w{i % 17}" for i in range(60)]
    frame = spark.createDataFrame([(ws,)], "w array<string>")
    fast = frame.select(decontaminate.fingerprint(F.col("w"))).first()[0]
    monkeypatch.setattr(decontaminate, "LANE_WORDS", 10)
    assert frame.select(decontaminate.fingerprint(F.col("w"))).first()[0] == fast


def test_repeated_ids_have_their_own_sets(spark):
    one, other = (" ".join(f"{k}{i}" for i in range(50)) for k in "ab")
    rows = [(5, one), (5, other), (7, one), (9, other + " tail"), (5, one)]
    found = sorted((r.id, r.n_shingles, r.component_id) for r in jaccard_join.link_sets(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == [(5, 46, 5)] * 3 + [(7, 46, 5), (9, 47, 5)]


def test_secrets_of_a_long_text_beyond_ascii():
    """Time in proportion: positions are counted once over the text."""
    scanner = secret_scan.Scanner()
    text = "é " + "token=abcdef " * 60_000
    begin = time.time()
    found = secret_scan.in_code_points(scanner, text)
    assert len(found) == 60_000 and time.time() - begin < 20
    assert all(text[x["start"]:x["end"]] == "token=abcdef" for x in found[::999] + found[-1:])
    assert secret_scan.code_points("aéb".encode(), [0, 1, 3, 4]) == {0: 0, 1: 1, 3: 2, 4: 3}


def test_clean_lines_with_marks_stay():
    rules = quality_rules.LineRules()
    long = "".join(f"word{i} " for i in range(60))
    for line in ("Elle dit « oui », puis « non », puis « jamais ».", long + "a > b > c > d.", long + "col·lecció, intel·ligència i novel·la."):
        assert rules.fails(line) is None
    for line in ("Home | News | Sport | Shop.", "Start » Buch » Teil » Ende.", "a · b · c · d."):
        assert rules.fails(line) in ("navigation", "symbols")
    assert rules.fails("« a » b » c » d ».") == "navigation"


def test_stages_delete_what_the_stage_before_stored(spark):
    with storage.tracked(spark):
        first = storage.stored(spark.range(3), "t")
    assert first.count() == 3
    kept = storage.stored(spark.range(4), "t")
    with storage.tracked(spark):
        second = storage.stored(spark.range(5), "t")
    assert second.count() == 5 and kept.count() == 4
    fs = lambda df: df.inputFiles()[0]
    path = spark._jvm.org.apache.hadoop.fs.Path(fs(first))
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_a_short_list_of_ids_goes_to_the_texts(spark):
    """No shuffle of the documents while the ids are few."""
    docs = spark.range(1000).withColumn("text", F.lit("x")).withColumnRenamed("id", "doc_id")
    left = corpus_pipeline.without(docs, spark.range(10).withColumnRenamed("id", "doc_id"))
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert left.count() == 990 and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_overlaps_discard_between_blocks(spark):
    """Pairs by all columns, over random sets, for any cut into blocks."""
    rnd = np.random.RandomState(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for k in range(40):
        ws = list(base)
        for _ in range(rnd.randint(0, 6)):
            ws[rnd.randint(60)] = f"n{rnd.randint(9)}"
        texts.append((k, " ".join(ws)))
    df = spark.createDataFrame(texts, "id long, text string")
    sets = {k: {tuple(t.split()[i:i + 5]) for i in range(56)} for k, t in texts}
    first = jaccard_join.first_columns(df, 5, 80).select("id", "row", "n")
    rows = {r.id: (r.row, r.n) for r in first.collect()}
    pairs = [(rows[a][0], rows[b][0], rows[a][1], rows[b][1]) for a in sets for b in sets if rows[b] < rows[a]]
    found = jaccard_join.overlaps(
        spark.createDataFrame(sorted(set(pairs)), "a long, b long, n int, m int"), df,
        first.groupBy("row").agg(F.min("id").alias("first")), 5, 80)
    alike = {(rows[a][0], rows[b][0]) for a in sets for b in sets if rows[b] < rows[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert {tuple(r) for r in found.collect()} == alike and 10 < len(alike) < len(set(pairs))


@pytest.mark.parametrize("bits", [32, 1 << 24])
def test_columns_of_candidates_are_not_shuffled_to_be_chosen(spark, monkeypatch, bits):
    """Texts whose ids hash like those wanted come along and are dropped by the joins; copies and repeated rows count once."""
    monkeypatch.setattr(jaccard_join, "FILTER_BITS", bits)
    plans = []

    def stored(df, name):
        if name == "incidence":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return storage.stored(df, name)

    monkeypatch.setattr(jaccard_join, "stored", stored)
    one = [f"w{i}" for i in range(80)]
    near = [*one[:40], "x", *one[41:]]
    rows = [(k, " ".join(ws)) for k, ws in enumerate([one, near, one, near, [*one, "tail"], ["other", *one[:20]]])]
    frame = spark.createDataFrame(rows + rows[:2], "doc_id long, text string")
    found = sorted((r.id, r.component_id) for r in jaccard_join.link_sets(frame).collect())
    assert found == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 0), (3, 0), (4, 0), (5, 5)]
    assert "Exchange" not in plans[0] and "Join" not in plans[0]


def test_columns_are_deleted_when_their_use_is_over(spark, monkeypatch):
    """Of the tables that the join stores, those of columns are gone before its result is read."""
    paths = {}

    def stored(df, name):
        out = storage.stored(df, name)
        paths.setdefault(name, []).extend(out.inputFiles()[:1])
        return out

    monkeypatch.setattr(jaccard_join, "stored", stored)
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join([*words[:k], "x", *words[k + 1:]]) for k in range(3)]
    frame = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (9, "a b")], "doc_id long, text string")
    result = jaccard_join.link_sets(frame)
    conf = spark._jsc.hadoopConfiguration()
    there = {name: [(p := spark._jvm.org.apache.hadoop.fs.Path(x)).getFileSystem(conf).exists(p) for x in files] for name, files in paths.items()}
    assert there["rows"] == [True] and not any(there["columns"] + there["incidence"]) and len(there["incidence"]) >= 2
    assert sorted((r.id, r.component_id) for r in result.collect()) == [(0, 0), (0, 0), (1, 0), (2, 0), (9, 9)]
