"""Scores of many pairs against the definition for one, and substring pairs against a loop."""

import random

import numpy as np

from ledgerlark.functions.names import fold, jaro_winkler, jaro_winkler_many, match_pairs, match_score, match_scores, score_bounds
from ledgerlark.operators import screening
from ledgerlark.operators.screening import bulk_screen, contains_join, contains_pairs, name_scores, screen_candidates


def names(rng, n):
    letters = rng.choice(["ab", "abcdefgh", "abcdefghijklmnopqrstuvwxyz0123456789_"])
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 9])))
    return [" ".join(word() for _ in range(rng.choice([0, 1, 2, 3, 5]))) for _ in range(n)] + ["x" * 64, "x" * 65, "ab " * 21, " ".join(f"t{i}" for i in range(17))]


def test_many_pairs_score_as_one():
    rng = random.Random(7)
    for _ in range(12):
        pool = names(rng, 60)
        q, c = rng.choices(pool, k=700), rng.choices(pool, k=700)
        want = [match_score(x, y) for x, y in zip(q, c, strict=True)]
        assert match_scores(q, c).tolist() == want
        bounded = match_scores(q, c, 65.0)
        kept = ~np.isnan(bounded)
        assert (bounded[kept] == np.array(want)[kept]).all() and (np.array(want)[~kept] < 65).all()
        short = [n for n in pool if len(n) <= 64]
        i, j = (np.array(rng.choices(range(len(short)), k=500)) for _ in "ij")
        assert jaro_winkler_many(short, short, i, j).tolist() == [jaro_winkler(short[x], short[y]) for x, y in zip(i, j, strict=True)]
    assert match_scores([], []).tolist() == [] and match_scores([None, ""], ["a", None]).tolist() == [0.0, 0.0]


def test_substrings(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcé ") for _ in range(rng.choice([0, 1, 2, 5, 12]))) for _ in range(400)] + [f"common {i}" for i in range(900)] + [None]
    needles = ["", "a", "ab", "abc", "common", "common 1", "é", "zzz", "abzzz", "mon", "o"] + ["".join(rng.choice("abc") for _ in range(4)) for _ in range(40)]
    left = spark.createDataFrame([(i, n) for i, n in enumerate(needles)], "k long, needle string")
    right = spark.createDataFrame([(i, t, "same") for i, t in enumerate(texts)], "r long, hay string, other string")
    want = {(n, t) for n in needles for t in texts if n and t is not None and n in t}
    for block in (7, 4096):
        got = [(r._needle, r._text) for r in contains_pairs(left, right, "needle", "hay", block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    joined = contains_join(left, right, "needle", "hay").select("k", "r").collect()
    assert sorted(map(tuple, joined)) == sorted((k, r) for k, n in enumerate(needles) for r, t in enumerate(texts) if n and t is not None and n in t)
    assert contains_join(left.limit(0), right, "needle", "hay").count() == 0 and contains_join(left, right.limit(0), "needle", "hay").count() == 0


def wanted(name, alias):
    """Whether a query's name and an alias meet, as the SQL says."""
    q, raw = fold(name), alias.lower()
    tokens = [t for t in q.split() if len(t) >= 3]
    return any(t in raw for t in tokens) if tokens else q in raw if len(q) >= 2 else bool(q) and q in fold(alias)


def screened(spark, rng):
    words = ["anna", "annabel", "bell", "nab", "of", "x", "Ébel", "mr", "ann", "el"]
    name = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3])))
    q, a = [(k // 2 if k < 9 else k, name()) for k in range(90)], [(k, name()) for k in range(160)]
    return q, a, spark.createDataFrame(q, "query_id long, name string"), spark.createDataFrame([*a, (999, None)], "alias_id long, alias_name string")


def test_candidates_once_and_made_last(spark, monkeypatch):
    q, a, queries, aliases = screened(spark, random.Random(11))
    for tile, ids in ((512, 256), (7, 2)):
        monkeypatch.setattr(screening, "TILE_QUERIES", tile)
        monkeypatch.setattr(screening, "TILE_NAMES", tile)
        monkeypatch.setattr(screening, "IDS", ids)
        found = screen_candidates(queries, aliases)
        assert sorted(map(tuple, found.collect())) == sorted((i, j) for i, n in q for j, c in a if wanted(n, c))
    # Pairs are neither sorted, counted nor shuffled once they are made.
    plan = found._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "Generate" in above and "Exchange" not in above and "Aggregate" not in above


def test_scores_of_candidates(spark, monkeypatch):
    q, a, queries, aliases = screened(spark, random.Random(12))
    monkeypatch.setattr(screening, "IDS", 3)
    found = name_scores(queries, aliases)
    assert sorted(map(tuple, found.collect())) == sorted((i, j, match_score(fold(n), fold(c))) for i, n in q for j, c in a if wanted(n, c))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")]


def test_bounds_hold():
    rng = random.Random(8)
    for _ in range(6):
        pool = np.array(sorted(set(names(rng, 50))), object)
        i, j = (x.ravel() for x in np.indices((len(pool), len(pool))))
        scores = match_pairs(pool, pool, i, j)
        assert scores[::7].tolist() == [match_score(pool[x], pool[y]) for x, y in zip(i[::7], j[::7], strict=True)]
        assert (score_bounds(pool, pool).ravel() >= scores).all()


def test_best_of_many_like_names(spark, monkeypatch):
    """All names share a token, so all pairs meet in one tile; only each query's best are kept."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abeln") for _ in range(rng.choice([2, 4, 6])))
    q = [(k, f"anna {word()}", rng.choice([None, None, "Vessel"])) for k in range(130)]
    entries = [(k, rng.choice(["Vessel", "Entity", None])) for k in range(170)]
    spelt = [f"Anna {word()} {word()}" for _ in range(60)]
    a = [(k, k, rng.choice(spelt), rng.choice([True, False])) for k in range(170)]
    stored = {}
    keep = screening.materialize
    monkeypatch.setattr(screening, "materialize", lambda df, name: stored.setdefault(name, []).append(out := keep(df, name)) or out)
    none = {"locations": "entry_id long, address string, city string, state_province string, postal_code string, country string", "identifiers": "entry_id long, id_value string"}
    got = bulk_screen(
        spark.createDataFrame([(i, n, kind, None) for i, n, kind in q], "query_id long, name string, entity_type string, id_number string"),
        spark.createDataFrame([(e, kind, f"e{e}", "SDN") for e, kind in entries], "entry_id long, entity_type string, primary_name string, list_name string"),
        spark.createDataFrame([(*x, False) for x in a], "alias_id long, entry_id long, alias_name string, low_quality boolean, is_primary boolean"),
        *(spark.createDataFrame([], s) for s in none.values()),
    )
    want = []
    for i, n, kind in q:
        hits = []
        for alias, e, c, low in a:
            raw = match_score(fold(n), fold(c))
            score = raw * 0.97 if low and raw < 100 else raw
            if score >= 65 and kind in (None, entries[e][1]):
                hits.append((-np.floor(score * 100.0 + 0.5) / 100.0, c, alias, e))
        best = sorted(hits)[:5]
        want += [(i, r, e, c, -s) for r, (s, c, _, e) in enumerate(best, 1)] or [(i, 0, None, None, None)]
    assert sorted(map(tuple, got.select("query_id", "rank", "entry_id", "matched_name", "score").collect())) == sorted(want)
    assert max(t.count() for tables in stored.values() for t in tables) < 130 * 60 / 4
