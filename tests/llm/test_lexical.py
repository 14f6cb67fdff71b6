import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyspark.llm import lexical
from tallyspark.llm.lexical import Top, impacts, ranked_search, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, most=50):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total, df = len(counted), sum(sum(c.values()) for _, c in counted), Counter(t for _, c in counted for t in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in asked.items():
        scored = []
        for i, c in counted:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if s > 0 and i is not None:
                scored.append((-s, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:most], 1)]
    return sorted(out)


def corpus():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["Étage", "É", "co-op", "a.b", "x\x7fy", "日本", "The", "the"]
    pick = lambda: words[min(int(rng.expovariate(0.12)), len(words) - 1)]
    docs = [(i * 3, " ".join(pick() for _ in range(rng.randrange(1, 60)))) for i in range(250)]
    docs += [(2, None), (4, ""), (5, " \t.!"), (6, docs[9][1]), (7, docs[9][1]), (27, docs[9][1]), (None, "w1 w2 the"), (8, "w3 " * 40_000 + "rare")]
    items = [(1, "w1 w2 THE the"), (2, "rare"), (3, "nothing here"), (4, None), (5, ""), (6, "étage É 日本 y"), (7, " ".join(f"w{i}" for i in range(60))), (None, "w1"), (8, "w50"), (8, "w55 w1")]
    return docs, items


@pytest.mark.parametrize("limit", [1 << 20, 300])
def test_ranks_match_brute_force_in_one_block_or_many(spark, monkeypatch, limit):
    monkeypatch.setattr(lexical, "MERGED", 2)
    docs, items = corpus()
    docs_df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score long, item string").repartition(7)
    items_df = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    for most in (50, 3):
        got = ranked_search(docs_df, items_df, most=most, limit=limit)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect())) == brute(docs, items, most)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "b"), (2, None)], "doc_id long, text string")
    assert ranked_search(none, items).collect() == [] and ranked_search(docs, items).collect() == []
    assert ranked_search(docs, items.limit(0)).collect() == []


@pytest.mark.parametrize("short", [0.0, 0.1, 1.0])
@pytest.mark.parametrize("stretch", [1, 16, 1000])
def test_search_skips_without_loss(short, stretch):
    rng = np.random.default_rng(3)
    n, full = 600, 0
    for trial in range(30):
        lists, sums = [], np.zeros(n, np.int64)
        for _ in range(rng.integers(1, 9)):
            places = np.flatnonzero(rng.random(n) < rng.random() ** 3)
            scores = rng.integers(1, 40 if trial % 2 else 4, len(places))
            lists.append((places, scores))
            sums[places] += scores
        top, ids = Top(5), np.sort(rng.choice(10_000, n, replace=False))
        top.add(20, 77), top.add(3, -5)
        full += search([x for x in lists if len(x[0])], n, ids, top, short, stretch)
        want = sorted([(int(s), -int(i)) for s, i in zip(sums, ids) if s] + [(20, -77), (3, 5)], reverse=True)[:5]
        assert sorted(top.heap, reverse=True) == want
    assert full < 30 * n * 0.5 or stretch == 1000


def test_impacts_beyond_64_bits():
    got = impacts(np.array([1000, 5]), np.array([10**10, 3]), np.array([10**10, 10]), 10**12, 10**14)
    want = [w * ((10**9 * tf) // (1000 * tf + 20 * (50 + 50 * n * 10**12 // 10**14))) for w, tf, n in ((1000, 10**10, 10**10), (5, 3, 10))]
    assert got.tolist() == want and got.dtype == np.int64
