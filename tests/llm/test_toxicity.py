import random

import numpy as np

from ledgerlark.llm.toxicity import fit_ordinal, fit_toxicity, grade_documents, held_out_grades, score_toxicity
from pyspark.sql import functions as F


def test_gradient_fit_finds_the_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 2))
    score = 2 * x[:, 0] - x[:, 1]
    noise = rng.logistic(size=1500)
    grades = np.digitize(score + noise, [-1.0, 1.0, 2.5])
    w, cuts = fit_ordinal([[(0, a), (1, b)] for a, b in x.tolist()], grades, 2, 4, decay=1e-5, steps=1500)
    assert np.allclose(w, [2, -1], atol=0.3) and np.allclose(cuts, [-1, 1, 2.5], atol=0.35)


def corpus(spark):
    rng = random.Random(9)
    plain = [f"word{i}" for i in range(300)]
    bad = ["grrr", "blah", "ugh"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 8 == 0
        words = rng.sample(plain, 40) + ([rng.choice(bad) for _ in range(rng.choice([1, 4, 8]))] if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words).capitalize(), 1))
        if i < 600:
            labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out(spark):
    docs, labels = corpus(spark)
    got = {r.doc_id: r for r in grade_documents(docs, labels).collect()}
    assert len(got) == 900
    assert all(got[i].toxic == (i % 8 == 0) for i in range(600, 900))
    assert all(got[i].severity < 0.5 for i in range(900) if i % 8)
    assert len({got[i].grade for i in range(0, 900, 8)}) > 1


def test_cases(spark):
    docs, labels = corpus(spark)
    model = fit_toxicity(docs, labels.union(spark.createDataFrame([(None, 1, 1), (7, None, None)], labels.schema)))
    odd = spark.createDataFrame([(1, None, 0), (None, "grrr ugh", 0), (2, "", 0), (2, "", 0), (3, "x " * 200000 + "grrr grrr ugh", 0)], docs.schema)
    got = score_toxicity(odd, model).collect()
    assert sorted([(r.doc_id or -1, r.toxic) for r in got]) == [(-1, True), (1, False), (2, False), (2, False), (3, True)]
    assert grade_documents(docs.limit(0), labels).count() == 0
    assert grade_documents(docs, labels.limit(0)).filter("toxic").count() == 0
    assert grade_documents(docs, labels.withColumn("toxic", F.lit(0))).filter("toxic").count() == 0


def loss(free, rows, grades, n_features, decay):
    """Mean negative log likelihood and penalty, row by row."""
    w, cuts = free[:n_features], free[n_features:]
    total = 0.0
    for row, g in zip(rows, grades, strict=True):
        score = sum(w[j] * v for j, v in row)
        above = [1.0, *(1 / (1 + np.exp(c - score)) for c in cuts), 0.0]
        total -= np.log(above[g] - above[g + 1])
    return total / len(rows) + decay * float((w**2).sum())


def test_fit_is_a_minimum_by_brute_force():
    rng = np.random.default_rng(3)
    rows = [[(int(j), float(rng.integers(1, 3))) for j in rng.choice(3, 2, replace=False)] for _ in range(60)]
    grades = rng.integers(0, 4, 60)
    w, cuts = fit_ordinal(rows, grades, 3, 4, decay=1e-2, steps=4000, rate=0.02)
    best = np.r_[w, cuts]
    least = loss(best, rows, grades, 3, 1e-2)
    for k in range(len(best)):
        for step in (-0.05, -0.01, 0.01, 0.05):
            moved = best.copy()
            moved[k] += step
            assert loss(moved, rows, grades, 3, 1e-2) > least
    assert all(loss(best + rng.normal(0, 0.05, len(best)), rows, grades, 3, 1e-2) > least for _ in range(50))


def test_held_out_grades():
    toxic = np.array([i % 4 == 0 for i in range(120)])
    rows = [[(0, 1.0 + i % 5)] if bad else [(1, 1.0)] for i, bad in enumerate(toxic)]
    grades = held_out_grades(rows, toxic, 2)
    assert set(grades[~toxic]) == {0} and sorted(np.bincount(grades[toxic])[1:]) == [10, 10, 10]
    assert held_out_grades(rows, np.zeros(120, bool), 2).max() == 0


def test_fit_is_the_same_in_any_order(spark):
    docs, labels = corpus(spark)
    twice = docs.union(docs.limit(50)).union(docs.limit(5).withColumn("text", F.lit("other words")))
    more = labels.union(labels.limit(40)).union(labels.limit(3).withColumn("toxic", 1 - F.col("toxic"))).withColumn("doc_id", F.col("doc_id"))
    fits = [fit_toxicity(twice.repartition(n, "text"), more.repartition(n)) for n in (2, 5)]
    assert fits[0].words == fits[1].words and (fits[0].weights == fits[1].weights).all() and (fits[0].thresholds == fits[1].thresholds).all()
    clash = labels.withColumn("text", F.lit(1)).withColumn("words", F.lit(2)).withColumn("sketch", F.lit(3))
    assert fit_toxicity(docs, clash).words == fit_toxicity(docs, labels).words
