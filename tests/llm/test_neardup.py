import random

import numpy as np
import pyarrow as pa

from ledgerlark.llm import neardup
from ledgerlark.llm.neardup import choose_banding, keep_one_of_each, near_duplicates, text_shingles


def grams(text, width=5):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, threshold=0.8):
    texts = {}
    for i, t in rows:
        texts.setdefault(t or "", []).append(i)
    keys = [t for t in texts if grams(t)]
    sets = [grams(t) for t in keys]
    links = {t: set() for t in texts}
    for a in range(len(keys)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[keys[a]].add(keys[b])
                links[keys[b]].add(keys[a])
    out = {}
    for t in texts:
        if not grams(t):
            out |= {i: (i, 0, 1) for i in texts[t]}
            continue
        seen, todo = {t}, [t]
        while todo:
            todo += [x for x in links[todo.pop()] if x not in seen and not seen.add(x)]
        out |= {i: (min(j for x in seen for j in texts[x]), len(links[t]), len(texts[t])) for i in texts[t]}
    return out


def corpus(seed, big=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []

    def edited(t, n):
        t = t[:]
        for _ in range(n):
            t[rng.randrange(len(t))] = rng.choice(words)
        return t

    for _ in range(40):
        t = [rng.choice(words) for _ in range(rng.choice([3, 5, 30, 100, 300]))]
        rows += [" ".join(edited(t, rng.choice([0, 0, 1, 2, 5]))) for _ in range(rng.choice([1, 1, 2, 4]))]
    rows += ["", "", None, " \n", "a b", "a  b", "a b", "é ü ñ ß 日本", "é ü ñ\tß 日本"]
    hot = [rng.choice(words) for _ in range(200)]
    rows += [" ".join(edited(hot, rng.choice([1, 2, 3]))) for _ in range(big)]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_shingles():
    texts = ["a b c d e f", "", "x", "  a b\nc\td e f ", "a b c d e", "ab c d e f"]
    found, first = text_shingles(pa.array(texts), 5)
    sets = [found[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    assert list(map(len, sets)) == [2, 0, 1, 2, 1, 1] and sets[0] == sets[3] and sets[4] == sets[0][:1] and sets[5] != sets[4]
    assert choose_banding(0.8, 0.9999) == (18, 4)
    assert choose_banding(1.0, 0.99) == (1, 96) and choose_banding(0.5, 0.99)[1] < 4
    bands, rows = choose_banding(0.3, 0.99)
    assert 1 - (1 - 0.3**rows) ** bands >= 0.99


def test_equals_brute_force(spark):
    rows = corpus(1, big=60)
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, class_id int").repartition(5)
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in near_duplicates(docs, block=16).collect()}
    assert got == brute(rows)
    kept = keep_one_of_each(docs, near_duplicates(docs))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for c, _, _ in brute(rows).values()}


def test_cases(spark):
    schema = "doc_id long, text string"
    assert near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "one two three four five six"), (None, None), (1, "one two three four five six"), (1, "one two three four five six"), (2, None), (2, "x " * 50000)]
    got = sorted(near_duplicates(spark.createDataFrame(rows, schema)).collect(), key=str)
    assert len(got) == 6 and sum(r.class_id is None for r in got) == 2
    assert np.array_equal(sorted(r.class_id for r in got if r.class_id), [1, 1, 2, 2])


def test_repeated_ids_count_each_text_once(spark):
    rng = random.Random(7)
    prose = lambda: [rng.choice("abcdefghijklmnop") + str(rng.randrange(99)) for _ in range(80)]
    a, b, c = prose(), prose(), prose()
    text = lambda w, *more: " ".join([*w, *more])
    rows = [(1, text(a)), (1, text(a)), (2, text(a, "x")), (3, text(b)), (3, text(c)), (4, text(b, "x")), (5, text(c, "x")), (None, text(a))]
    got = sorted((tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 1, 1, 2), (1, 1, 1, 2), (2, 1, 1, 1), (3, 3, 1, 1), (3, 3, 1, 1), (4, 3, 1, 1), (5, 3, 1, 1), (None, None, 0, 1)], key=str)


def test_hot_id_keeps_blocks_small(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = [(1 if i % 3 == 0 else i, " ".join([*base, f"x{i}"])) for i in range(120)]
    real = neardup.jaccard_links

    def counted(ids, *rest):
        (tmp_path / f"{len(ids)}-{rng.random()}").touch()
        return real(ids, *rest)

    monkeypatch.setattr(neardup, "jaccard_links", counted)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=16).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(1, 119)} and len(got) == 120
    assert max(int(f.name.split("-")[0]) for f in tmp_path.iterdir()) <= 32
