import hashlib
import math
import random
import re
import zlib

import pyarrow as pa

from ledgerlark.llm import words
from ledgerlark.llm.resampling import features, ranked, resample

SCHEMA = "doc_id long, text string, weight int, `_row` string, bucket string"


def grams(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(found), [zlib.crc32(" ".join(found[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(found) - n + 1)]


def brute(docs, target, share=5, least=20):
    s, t = [0] * 10000, [0] * 10000
    for counts, texts in ((s, docs), (t, target)):
        for _, text in texts:
            for b in grams(text)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 10000) / ((s[b] + 1) * (sum(t) + 10000)))) for b in range(10000)]
    rows = []
    for i, text in docs:
        n, found = grams(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    drawn = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(drawn[: share * len(drawn) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in rows]


def key(r):
    return tuple(map(str, r))


def texts(rng, n):
    made = ["alpha", "Beta", "γάμμα", "x1", "É", "don't", "日本語", "a\x00b", "end.", "z" * 300, "[K", "ſ"]
    return [" ".join(rng.choice(made) + rng.choice(["", "", str(rng.randrange(40))]) for _ in range(rng.choice([0, 1, 2, 3, 19, 20, 25, 90]))) for _ in range(n)]


def test_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    docs = list(enumerate(texts(rng, 500))) + [(900, None), (901, ""), (None, "word " * 30), (None, "other " * 30)] + [(902, "same row of words " * 9)] * 90 + [(903, "long " * 200_000)]
    target = [(i, t) for i, t in enumerate(texts(rng, 30))] + [(1, None)]
    frame = spark.createDataFrame([(i, t, 1, "r", "b") for i, t in docs], SCHEMA).repartition(6)
    goal = spark.createDataFrame(target, "item_id long, text string")
    got = resample(frame, goal)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = brute(docs, target)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key) and any(r[4] for r in want)
    # without target texts, without documents
    assert sorted(map(tuple, resample(frame, goal.limit(0)).collect()), key=key) == sorted(brute(docs, []), key=key)
    assert resample(frame.limit(0), goal).count() == 0


def test_stretches_carry_words(monkeypatch):
    """Features are the same however the joined texts are cut into stretches, and never cross documents."""
    rng = random.Random(9)
    batch = [*texts(rng, 60), None, "", "q" * 5000, "one", "two three"]
    for size in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(words.blocks, "__defaults__", (size,))
        got = sorted((int(d), int(b)) for _, of, bucket in features(pa.array(batch)) for d, b in zip(of, bucket, strict=True))
        assert got == sorted((i, b) for i, t in enumerate(batch) for b in grams(t)[1]), size
        assert sum(len(w) for w, _, _ in features(pa.array(batch))) == sum(grams(t)[0] for t in batch)


def test_ranks_of_one_hot_score(spark):
    """A third and more of all rows with one score and id spread over ranges, and every rank is given once."""
    rows = spark.range(9000).selectExpr("id % 2 * id AS doc_id", "IF(id % 2 = 0, 7L, id) AS score", "20L AS n_words")
    got = ranked(rows, 8000, "n_words >= 20").collect()
    given = [r for r in got if r["rank"] is not None]
    assert len(got) == 9000 and sorted(r["rank"] for r in given) == list(range(1, 8001))
    order = sorted(given, key=lambda r: r["rank"])
    assert [(-r.score, r.doc_id) for r in order] == sorted((-r.score, r.doc_id) for r in got)[:8000]
