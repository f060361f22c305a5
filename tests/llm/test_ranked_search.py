import math
import random
import re
from collections import Counter

import numpy as np

from ledgerlark.llm.ranked_search import Lists, best_positions, ranked_search

SCHEMA = "doc_id long, text string, n int, term string, score double"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=50):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, length = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        asked, found = set(terms(text)), []
        for i, c in counts:
            m = 100 - 50 + (50 * c.total() * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in asked & c.keys())
            if score > 0:
                found.append((-score, math.inf if i is None else i))
        out += [(item, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return out


def key(r):
    return tuple(map(str, r))


def corpus(rng, n):
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(3000)] + ["the", "The", "été", "日本", "x_y", "a\x7fb", "İ", "K"]
    return [" ".join(["the", *(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 20, 60])))]) for _ in range(n)]


def test_brute_force(spark):
    rng = random.Random(1)
    docs = list(enumerate(corpus(rng, 1500))) + [(7000, None), (7001, ""), (7002, "?!"), (None, "w1 w2 w3 w1"), (None, "w1"), (7003, "w5 " * 400_000)] + [(7004, "w1 w2 the same text")] * 120
    items = [(i, t) for i, t in enumerate(corpus(rng, 25))] + [(3, "w1 w1 W2"), (None, "w3"), (90, None), (91, ""), (92, "nowhere"), (93, "the")]
    frame = spark.createDataFrame([(i, t, 1, "x", 0.5) for i, t in docs], SCHEMA).repartition(5)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    want = sorted(brute(docs, items), key=key)
    got = ranked_search(frame, asked)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=key) == want
    # many small blocks, and items in several rounds
    assert sorted(map(tuple, ranked_search(frame, asked, places=500, term_bytes=4000).collect()), key=key) == want
    assert sorted(map(tuple, ranked_search(frame, asked, k=3).collect()), key=key) == sorted(brute(docs, items, 3), key=key)


def test_empty(spark):
    docs, items = spark.createDataFrame([(1, "a", 1, "x", 0.5)], SCHEMA), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search(docs, items.limit(0)).count() == 0 and ranked_search(docs.limit(0), items).count() == 0
    assert ranked_search(docs, items).count() == 1


def test_reading_stops_early_and_ties_stay():
    """Positions seen by lookups end reading before all lists are read, and an unread document of equal score with a
    smaller id is still found."""
    rng = np.random.default_rng(2)
    n = 20_000
    doc = np.tile(np.arange(n), 2)
    impact = np.concatenate([np.arange(n), np.arange(n)])  # both lists agree: the best are met at once
    lists = Lists(np.arange(n)[::-1].copy(), doc, np.repeat([4, 9], n), impact)
    looked = []
    real = np.searchsorted
    np.searchsorted = lambda a, v, *r: (looked.append(np.size(v)), real(a, v, *r))[1]
    try:
        ids, scores = best_positions(lists, np.array([4, 9, 11]), np.array([2, 3, 5]), 5, np.empty(0, np.int64), np.empty(0, np.int64))
    finally:
        np.searchsorted = real
    assert ids.tolist() == [0, 1, 2, 3, 4] and scores.tolist() == [5 * (n - 1 - i) for i in range(5)] and sum(looked) < 400
    for _ in range(200):
        n, m = int(rng.integers(1, 60)), int(rng.integers(1, 5))
        held = rng.random((m, n)) < 0.6
        parts = rng.integers(1, 4, (m, n)) * held
        term, doc = np.nonzero(held)
        ids = rng.permutation(n)
        weights = rng.integers(0, 3, m)
        k = int(rng.integers(1, 8))
        got = best_positions(Lists(ids, doc, term, parts[term, doc]), np.arange(m), weights, k, np.empty(0, np.int64), np.empty(0, np.int64), first=1)
        total = weights @ parts
        want = sorted((-s, i) for s, i in zip(total.tolist(), ids.tolist(), strict=True) if s > 0)[:k]
        assert [(-s, i) for i, s in zip(*map(np.ndarray.tolist, got), strict=True) if s > 0] == want
