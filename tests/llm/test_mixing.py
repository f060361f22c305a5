import hashlib
import random
import re

from pyspark.sql import functions as F

from ledgerlark.llm.mixing import mix_sources, mixed_rows, source_targets


def water(sizes, weights=(1, 2, 3), cap=3):
    """Reshares the excess round by round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while left > 1e-9 and free:
        total = sum(w[s] for s in free)
        for s in free:
            target[s] += left * w[s] / total
        left = sum(max(0, target[s] - cap * sizes[s]) for s in free)
        for s in list(free):
            if target[s] >= cap * sizes[s]:
                target[s] = cap * sizes[s]
                free.discard(s)
    return target


def test_targets(spark):
    rng = random.Random(4)
    for n in (1, 2, 3, 7, 20):
        sizes = {f"s{i}": rng.choice([0, 1, 5, 1000, 10**6]) + rng.randrange(50) for i in range(n)}
        sizes[None] = 17
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in source_targets(rows).collect()}
        want = water(sizes)
        assert all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in sizes), (sizes, got, want)


def test_mix(spark):
    rng = random.Random(8)
    rows = []
    for i in range(900):
        source = rng.choice(["hot"] * 5 + ["b", "é", "z", "", None])
        text = None if i % 97 == 0 else " ".join(["w"] * rng.choice([0, 1, 10, 40])) + "\t\x0bx\n"
        rows.append((i, text, source, 9))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(5)
    got = {r.doc_id: r for r in mix_sources(docs).collect()}
    assert len(got) == 900
    texts = {i: t for i, t, _, _ in rows}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, _ in rows}
    sizes = {}
    for i, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size[i]
    target = water(sizes)
    for s in sizes:
        mine = [i for i, _, x, _ in rows if x == s]
        assert all(got[i].size == size[i] and got[i].source_size == sizes[s] and abs(got[i].target - target[s]) < 1e-6 * sizes[s] for i in mine)
        assert all(got[i].taken in (0, size[i], 2 * size[i], 3 * size[i]) for i in mine)
        # brute force: in the order of hashes, the prefix nearest to the budget
        whole = int(target[s] / sizes[s]) if sizes[s] else 0
        budget, cum = target[s] - whole * sizes[s], 0
        order = sorted(mine, key=lambda i: int(hashlib.md5(f"{i}:{texts[i] or ''}".encode()).hexdigest()[:15], 16))
        want = {}
        for i in order:
            want[i] = whole * size[i] + (size[i] if cum + size[i] <= budget or cum <= budget < cum + size[i] and cum + size[i] - budget < budget - cum else 0)
            cum += size[i]
        assert {i: got[i].taken for i in mine if size[i]} == {i: want[i] for i in mine if size[i]}
        assert abs(sum(got[i].taken for i in mine) - target[s]) <= 42
    again = {r.doc_id: r.taken for r in mix_sources(docs.repartition(2)).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def test_small_and_empty(spark):
    schema = "doc_id long, text string, source string"
    assert mix_sources(spark.createDataFrame([], schema)).count() == 0
    assert [r.taken for r in mix_sources(spark.createDataFrame([(1, None, None)], schema)).collect()] == [0]
    same = mix_sources(spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, "c", None)], schema)).collect()
    # "x" weighs 1 and the null source 2, whose most is 3 of 5 words; of the rest, one of two equal rows meets the target
    assert sorted((r.doc_id or 0, r.size, r.source_size, r.target, r.taken) for r in same) == [(0, 1, 1, 3.0, 3), (1, 2, 4, 2.0, 0), (1, 2, 4, 2.0, 2)]


def test_a_source_of_one_id_comes_near_its_target(spark):
    """Rows of one id, alike or with texts of their own, are cut among themselves; so are rows without id and text."""
    equal = [(5, "w " * 10, "one")] * 50
    own = [(5, f"w{i} " * (3 + i % 9), "own") for i in range(50)]
    more = [(i, "w " * 30, "z") for i in range(40)] + [(None, "q q q", None)] * 33 + [(None, None, "one")] * 3
    docs = spark.createDataFrame(equal + own + more, "doc_id long, text string, source string")
    runs = []
    for frame in (docs, docs.repartition(7)):
        got = mix_sources(frame).collect()
        assert len(got) == len(equal + own + more)
        for source_size in {r.source_size for r in got}:
            mine = [r for r in got if r.source_size == source_size]
            assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine) and all(r.taken <= 3 * r.size for r in mine)
        runs.append(sorted((r.doc_id or -1, r.size, r.taken) for r in got))
        wide = frame.withColumn("k", F.lit(1)).withColumn("more", F.lit(2)).withColumn("rest", F.lit(3))
        repeated = mixed_rows(wide)
        assert repeated.columns == wide.columns
        assert sorted((r.source or "", len((r.text or "").split())) for r in repeated.collect()) == sorted((s, n) for r in _with_sources(got, docs) for s, n in [(r[0], r[1])] * r[2])
    assert runs[0] == runs[1]


def _with_sources(got, docs):
    """(source, size, repeats) of each row; sources are told by their sizes, which differ here."""
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    name = {n: s for s, n in sizes.items()}
    return [(name[r.source_size] or "", r.size, r.repeats) for r in got]


def test_rows_without_an_id_don_t_move_as_one(spark):
    """A source without any id comes near its target; a long text counts whole."""
    rows = [(None, f"word{i} " + "w " * (i % 300), "b") for i in range(400)] + [(7, "w " * 60000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = []
    for frame in (docs, docs.repartition(7)):
        got = mix_sources(frame).collect()
        mine = [r for r in got if r.doc_id is None]
        assert len(mine) == 400 and len(got) == 401 and max(r.size for r in got) == 60000
        assert mine[0].target / mine[0].source_size % 1 > 0.1  # neither all nor none of the rows
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 300 and all(r.taken <= 3 * r.size for r in got)
        runs.append(sorted((r.size, r.taken) for r in got))
    assert runs[0] == runs[1]
