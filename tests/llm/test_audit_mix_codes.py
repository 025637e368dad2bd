"""Filter audit, source mix and vector codes: brute force on small tables, ties, repeated rows, nulls and empty tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fichaflow.llm import filter_audit, queries, source_mix, vector_codes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    """A hot text, repeated rows and ids, nulls in every column, very long texts, and columns whose names clash."""
    queries.prepared(spark)
    rnd = random.Random(5)
    rows = [(None, None, None, None), (None, "", "en", "b"), (1, "same " * 120, "en", "a"), (1, "same " * 120, "en", "a"),
            (0, "same " * 120, None, "a"), (None, "same " * 120, "", None), (2, "x" * 300_000, "de", "b"),
            (3, " ".join(f"w{i}" for i in range(60_000)), "de", "a"), (4, "SHOUT # now", "", "Ä"), (5, " \t\n", "de", "c"), (3, "again", "de", "a")]
    for i in range(6, 90):
        words = [rnd.choice(["a", "B", "c#", "dd", "é"]) + str(rnd.randrange(400)) for _ in range(rnd.choice([5, 99, 100, 101, 150]))]
        rows.append((i, "hot text" if i % 3 == 0 else " ".join(words), rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "d", None])))
    df = spark.createDataFrame(rows, DOCS)
    clash = ["id", "part", "digest", "mask", "n", "good", "toxic", "salt", "at", "rank", "begin", "size", "slot", "copies", "piece", "quality"]
    return df.withColumns({c: F.lit(f"extra {c}") for c in clash}), rows


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, (i % 5 == 0) * 1) for i in range(0, 80, 2)] + [(7, 1, 0), (7, 0, 1), (None, 1, 1), (8, None, None), (500, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("n", F.lit("extra")), rows


def failures(rows):
    """Filters that each row fails, by the words of the contract."""
    least = {}
    for d, text, *_ in rows:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    for d, text, *_ in rows:
        t = text or ""
        words = WORD.findall(t)
        yield "".join(name for name, failed in zip("ABCDE", (
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            bool(re.search("[#$%&*|]", t)), d is not None and least[t] < d)) if failed)


def test_audit_removes_document_by_document(spark, docs, labels):
    frame, rows = docs
    table, marks = labels
    failing = list(failures(rows))
    has = lambda d, k: any(m[k] == 1 for m in marks if m[0] is not None and m[0] == d)
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit_filters(frame, table).collect()}
    parts = {r[2] or "" for r in rows}
    assert len(got) == 600 * len(parts)
    shapley = Counter()
    for part in parts:
        own = [(f, has(r[0], 1), has(r[0], 2)) for r, f in zip(rows, failing) if (r[2] or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, name in enumerate(order, 1):
                gone = [x for x in left if name in x[0]]
                left = [x for x in left if name not in x[0]]
                r = got[part, order, step]
                assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) == (
                    len(left), len(gone), sum(name in f for f, _, _ in own) - len(gone), sum(f == name for f, _, _ in own),
                    sum(g for _, g, _ in gone), sum(t for _, _, t in gone))
                shapley[part, name] += len(gone)
    assert all(r.shapley == shapley[part, order[step - 1]] for (part, order, step), r in got.items())


def test_potential_is_the_shapley_value_by_its_definition():
    rnd = random.Random(2)
    for filters in range(1, 7):
        counts = {m: rnd.randrange(50) for m in range(1 << filters)}
        worth = filter_audit.worths(counts, filters)
        plain = [sum(worth[sum(1 << j for j in o[:o.index(i) + 1])] - worth[sum(1 << j for j in o[:o.index(i)])] for o in permutations(range(filters)))
                 for i in range(filters)]
        assert filter_audit.shapley_sums(worth, filters) == plain
        assert sum(plain) == math.factorial(filters) * worth[-1]


def test_audit_of_empty_tables(docs, labels):
    assert filter_audit.audit_filters(docs[0].limit(0), labels[0]).count() == 0
    counts = filter_audit.failure_counts(docs[0], labels[0].limit(0)).agg(F.sum("n"), F.sum("good"), F.sum("toxic")).first()
    assert tuple(counts) == (len(docs[1]), 0, 0)


def plain_targets(sizes, weights=(5, 2, 1), repeats=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    held, total = set(), sum(sizes.values())
    while True:
        rest, heavy = total - sum(repeats * sizes[s] for s in held), sum(weight[s] for s in names if s not in held)
        share = {s: repeats * sizes[s] if s in held else weight[s] * rest / heavy for s in names}
        over = {s for s in names if s not in held and share[s] > repeats * sizes[s]}
        if not over:
            return share
        held |= over


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_mix_takes_the_targets_slot_by_slot(spark, docs, block, monkeypatch):
    frame, rows = docs
    monkeypatch.setattr(source_mix, "LEAST_SLOTS", 1)
    monkeypatch.setattr(source_mix, "SLOTS_A_BUCKET", 50)
    monkeypatch.setattr(source_mix, "RANK_CHUNK", 64)
    if block == 1:  # a slot per word: without the very long text
        frame, rows = frame.filter("doc_id <> 3 or doc_id is null"), [r for r in rows if r[0] != 3]
    mix = source_mix.mix_sources(frame, block_words=block)
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    want = plain_targets(sizes)
    got = mix.documents.collect()
    assert Counter((r.id, r.size, r.source) for r in got) == Counter((d, len(WORD.findall(t or "")), s) for d, t, _, s in rows)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6) and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(taken[s] == math.floor(want[s] + 0.5) for s in sizes)

    by_slot = defaultdict(int)
    owner = {}
    for r in mix.segments.collect():
        assert 0 <= r.begin < r.end and owner.setdefault(r.slot, r.source) == r.source
        by_slot[r.slot] += r.end - r.begin
    last = Counter(owner.values())
    assert all(n <= block for n in by_slot.values())
    short = Counter(owner[s] for s, n in by_slot.items() if n < block)
    assert all(short[s] <= 1 and last[s] == -(-taken[s] // block) for s in last)
    # the schedule mixes: any stretch of slots has about a source's share of it
    slots = -(-sum(sizes.values()) // block)
    if slots >= 200:
        for s in sizes:
            at = [slot for slot, name in owner.items() if name == s and slot < slots]
            for k in range(4):
                here = sum(k * slots / 4 <= x < (k + 1) * slots / 4 for x in at)
                assert abs(here - taken[s] / block / 4) <= 8


def test_mix_agrees_however_the_rows_lie(spark, docs):
    one = rows_of(source_mix.mix_sources(docs[0]).documents)
    assert one == rows_of(source_mix.mix_sources(docs[0].repartition(7, F.rand(1))).documents)


def test_mix_points_are_golden(spark):
    golden = (math.sqrt(5) - 1) / 2
    assert source_mix.GOLDEN % 2 == 1 and abs(source_mix.GOLDEN / 2**40 - golden) < 2**-39
    slots = [0, 1, 2, 3, 10**6, 2**33 + 5, 2**40 - 1]
    got = spark.createDataFrame([(s,) for s in slots], "id long").select(source_mix.points(F.col("id")).alias("p")).collect()
    assert [r.p for r in got] == [s * source_mix.GOLDEN % 2**40 for s in slots]


def test_mix_without_words(spark, docs):
    assert source_mix.mix_sources(docs[0].limit(0)).documents.count() == 0
    blank = spark.createDataFrame([(1, None, "en", "a"), (1, "", "en", None), (1, "", "en", None)], DOCS)
    assert rows_of(source_mix.mix_sources(blank).documents) == [(1, 0, "a", 0, 0.0, 0)] + [(1, 0, None, 0, 0.0, 0)] * 2


def test_many_small_sources(spark):
    """More sources than slots a bucket, most of less than a block; a hot one has a third of the rows."""
    rows = [(i, " ".join(["w"] * (i % 4)), "en", "hot" if i % 3 == 0 else f"s{i}") for i in range(600)]
    found = source_mix.mix_sources(spark.createDataFrame(rows, DOCS)).documents.collect()
    sizes = Counter()
    for d, text, _, s in rows:
        sizes[s] += len(text.split())
    want, taken = plain_targets(sizes), Counter()
    for r in found:
        taken[r.source] += r.taken
    assert all(taken[s] == math.floor(want[s] + 0.5) for s in sizes)


def plain_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], k) for i, v, k in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v: [tuple(v[p * width:(p + 1) * width]) for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, x: min((far(x, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for _, v, _ in kept:
                x = cut(v)[p]
                held[near(p, x)[1]].append(x)
            new = {k: tuple(sum(c) // len(xs) for c in zip(*xs)) for k, xs in held.items()}
            books[p] = [new.get(k, e) for k, e in enumerate(books[p])]
    found, by_label = [], Counter()
    for i, v, label in kept:
        best = [near(p, x) for p, x in enumerate(cut(v))]
        found.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), label))
        by_label[label] += found[-1][2]
    text = ",".join(str(c) for book in books for e in book for c in e)
    return [(i, c, d, by_label[label]) for i, c, d, label in found], hashlib.sha256(text.encode()).hexdigest()


def coded(spark, rows, **more):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("extra") for c in ("id", "v", "code", "of", "n")})
    codes, books = vector_codes.compress(frame, **more)
    return rows_of(vector_codes.with_label_error(codes).select("id", "code", "error", "label_error")), books


def test_codes_by_all_distances(spark):
    rnd = np.random.RandomState(3)
    vectors = [[float(x) for x in v.astype(np.float32)] for v in rnd.normal(0, 0.1, (300, 16))]
    rows = [(int(i), v, int(i) % 3 if i % 7 else None) for i, v in zip(rnd.permutation(300), vectors)]
    rows += [(5, rows[0][1], 1), (5, rows[0][1], 1), (None, rows[1][1], 0), (400, None, 1), (401, [None] + [0.0] * 15, 1),
             (402, [float("nan")] * 16, 1), (403, [float("inf")] * 16, 0)] + [(500 + i, rows[2][1], 2) for i in range(200)]
    want, digest = plain_codes(rows)
    got, books = coded(spark, rows)
    assert got == sorted(want, key=repr) and vector_codes.digest(books) == digest


def test_codes_with_ties_and_few_rows(spark):
    rows = [(i, [float(i % 2), 0.0, -1.0, 2.0 * (i % 3)], 1) for i in range(9)]
    want, digest = plain_codes(rows)
    got, books = coded(spark, rows)
    assert got == sorted(want, key=repr) and vector_codes.digest(books) == digest and books.shape == (4, 9, 1)
    assert vector_codes.decode("00000000", books) == [0.5 / 1024, 0.5 / 1024, -1 + 0.5 / 1024, 0.5 / 1024]


def test_codes_of_odd_and_empty_tables(spark):
    assert coded(spark, [(1, [1.0, 2.0, 3.0], 1)])[0] == []  # no multiple of four
    assert coded(spark, [(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)])[0] == [(1, "00000000", 0, 0)]
    assert coded(spark, [(1, None, None)])[0] == []
    assert coded(spark, [(1, [], None)])[0] == [(1, "00000000", 0, 0)]
    assert coded(spark, [(1, [3e38, -3e38, 0.0, 0.0], None)])[0] == [(1, "00000000", 0, 0)]


def test_lists_hold_every_nearest_entry():
    """Lists by box against all distances, with ties, boxes of any width, a full memory and large numbers."""
    rnd = np.random.RandomState(1)
    for scale, width, memo in ((20, 3, 10), (400, 64, 5), (400, 256, 1000), (1 << 24, 1 << 20, 3), (1 << 24, 64, 1000)):
        book = rnd.randint(-scale, scale, (40, 4)).astype(np.int64)
        book[7] = book[3]
        cells = vector_codes.Cells(book, width, memo)
        for _ in range(5):
            x = rnd.randint(-scale, scale, (60, 4)).astype(np.int64)
            x[:5] = book[:5]
            all_ = ((x[:, None] - book[None]) ** 2).sum(2)
            entry, distance = cells.nearest(x)
            assert (entry == all_.argmin(1)).all() and (distance == all_.min(1)).all()


def test_lists_leave_out_most_entries_and_serve_copies():
    rnd = np.random.RandomState(4)
    book = rnd.randint(-300, 300, (256, 16)).astype(np.int64)
    x = rnd.randint(-300, 300, (500, 16)).astype(np.int64)
    cells = vector_codes.Cells(book)
    cells.nearest(x)
    assert cells.evaluated < 0.3 * len(x) * len(book)
    known = len(cells.lists)
    cells.nearest(x[::-1])
    assert len(cells.lists) == known
