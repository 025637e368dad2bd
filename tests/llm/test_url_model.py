"""The character models by their definition, in plain Python; the join beyond the table; and that the ratio tells urls apart."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fichaflow.llm import queries, url_filter

LOWER = {i: i + 32 for i in range(65, 91)}


def plain_scores(examples, urls):
    counts = [Counter(), Counter()]
    cut = lambda u: b"\0" * 5 + (u or "").translate(LOWER).encode() + b"\3"
    for url, accepted in examples:
        data = cut(url)
        for i in range(5, len(data)):
            for k in range(6):
                counts[accepted][data[i - k:i], data[i]] += 1
                counts[accepted][data[i - k:i], None] += 1
    for url in urls:
        data, logs = cut(url), [0.0, 0.0]
        for c in (0, 1):
            for i in range(5, len(data)):
                p = 1 / 256
                for k in range(6):
                    p = (counts[c][data[i - k:i], data[i]] + p) / (counts[c][data[i - k:i], None] + 1)
                logs[c] += math.log(p)
        yield (logs[1] - logs[0]) / (len(data) - 5)


def sample(n, seed):
    rnd = random.Random(seed)
    word = lambda alphabet: "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(3, 9)))
    good = [f"https://{word('aeiouln')}.com/{word('aeiouln')}" for _ in range(n)]
    bad = [f"http://{word('xqz019')}.net/es/{word('xqz019')}?id={rnd.randrange(99)}" for _ in range(n)]
    return good, bad


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_scores_are_the_definition(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "BROADCAST_KEYS", most)
    queries.prepared(spark)
    good, bad = sample(40, 1)
    examples = [(u, True) for u in good] + [(u, False) for u in bad] + [(None, True), ("", False), ("é" * 9, True)]
    models = url_filter.count_models(spark.createDataFrame(examples, "url string, accepted boolean"))
    assert (models.table is None) == (most > 0)
    urls = good[:5] + bad[:5] + ["HTTPS://New.example/", "", None, "é", good[0], "x" * 2000]
    found = url_filter.scored(spark.createDataFrame(list(enumerate(urls)), "i int, url string"), models)
    got = {r.i: r.score for r in found.collect()}
    assert len(got) == len(urls)
    for i, want in enumerate(plain_scores(examples, urls)):
        assert math.isclose(got[i], want, rel_tol=1e-9, abs_tol=1e-12)


def test_no_two_keys_meet():
    """Order, context and byte are told apart, zero bytes included."""
    keys, heads, lengths = url_filter.url_keys(["a\0b", "\0\0\0", "abcdefgh", ""])
    flat = [b"\0" * 5 + u.encode() + b"\3" for u in ("a\0b", "\0\0\0", "abcdefgh", "")]
    seen = {}
    for k in range(6):
        place = 0
        for data in flat:
            for i in range(5, len(data)):
                for kind, value in (("key", keys[k][place]), ("head", heads[k][place])):
                    own = (kind, k, data[i - k:i], data[i] if kind == "key" else None)
                    assert seen.setdefault(int(value), own) == own
                place += 1
    assert lengths.tolist() == [4, 4, 9, 1]


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_ratio_tells_urls_apart_that_no_rule_fits(spark, monkeypatch, most):
    """Examples by rules; urls of the same two kinds of letters elsewhere follow the model, calibrated to a half."""
    monkeypatch.setattr(url_filter, "BROADCAST_KEYS", most)
    queries.prepared(spark)
    good, bad = sample(250, 2)
    new_good, new_bad = ([u.replace(".com", ".org").replace(".net/es", ".org/xx") for u in part] for part in sample(40, 3))
    rows = list(enumerate(good + bad + new_good + new_bad))
    judged = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    verdict = {r.page_id: r.verdict for r in judged if r.rule is None}
    assert len(judged) == 580 and len(verdict) == 80
    right = sum(verdict[i] == ("allow" if i < 540 else "block") for i in verdict)
    assert right >= 76
    assert all((r.verdict == "allow") == (r.accept_probability >= 0.5) for r in judged if r.rule is None)


def test_empty_tables(spark):
    queries.prepared(spark)
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
    one = url_filter.judge_urls(pages).first()
    assert one.verdict == "allow" and pytest.approx(0.5) == one.accept_probability
    assert url_filter.judge_urls(pages.select("page_id", F.lit(None).cast("string").alias("url"))).first().host == ""
