import random

import corpus_pipeline as C
from ledgerlark.llm.quality import measure
from tests.llm.test_neardup import brute as near_brute
from tests.llm.test_substrings import brute as cut_brute
from pyspark.sql import functions as F


def make(spark):
    rng = random.Random(21)
    words = [f"{a}{b}" for a in ("wor", "lin", "tas", "mer", "ole", "qui") for b in ("ta", "lem", "ro", "sis", "nd", "pe", "ul", "gra")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(30)
    rows = []
    for i in range(120):
        t = prose(rng.choice([10, 40, 90])) + rng.choice(["", " " + passage + " " + prose(25)])
        if i % 9 == 0 and rows:
            t = rng.choice(rows)[1]
        if i % 11 == 0:
            t = t.upper() + "!!"
        if i % 13 == 0 and rows:
            t = rng.choice(rows)[1] + " extra"
        rows.append((i, t, "en", rng.choice(["a", "b", None]), len(t)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_against_brute_force(spark, tmp_path):
    docs = make(spark)
    names = [n for n, _ in C.STAGES]
    assert names == ["quality_rules", "near_duplicates", "substring_dedup", "mixing", "sentence_pieces"]
    out, inputs = docs, []
    for name, stage in C.STAGES:
        inputs.append([tuple(r) for r in out.collect()])
        result = stage(spark, out, "")
        result.write.parquet(str(tmp_path / name))
        columns, out = out.columns, spark.read.parquet(str(tmp_path / name))
        if name != "sentence_pieces":
            assert out.columns == columns
    kept = {r[0] for r in inputs[1]}
    bad = {r[0] for r in inputs[0]} - kept
    assert bad and all(measure(r[1])[0] < 20 or measure(r[1])[7] * 10 > 4 * measure(r[1])[1] or r[0] in kept for r in inputs[0])
    assert {r[0] for r in inputs[2]} == {c for c, _, _ in near_brute([r[:2] for r in inputs[1]]).values()}
    lengths = {r[0]: len(r[1].encode()) for r in inputs[3]}
    assert {i: n - gone for i, n, gone, _, _ in cut_brute([r[:2] for r in inputs[2]])} == lengths
    assert all(r[4] == len(r[1]) for r in inputs[3]) and {r[0] for r in inputs[4]} <= lengths.keys()
    assert max(out.groupBy("doc_id").count().agg(F.max("count")).first()) <= 3
    assert out.filter("NOT parity OR NOT round_trip").isEmpty() and out.count() == len(inputs[4])


def test_empty(spark):
    docs = make(spark).limit(0)
    for name, stage in C.STAGES:
        assert stage(spark, docs, "").count() == 0, name


def test_null_and_repeated_ids(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [prose(60) for _ in range(30)]
    rows = [(rng.choice([None, 1, 1, 2, 3 + i]), rng.choice(texts), "en", rng.choice(["a", "b", None]), 0) for i in range(150)]
    rows += [(None, texts[0], "en", "a", 0)] * 3 + [(7, texts[1] + " more", "en", "b", 0)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    kept = [tuple(r) for r in dict(C.STAGES)["near_duplicates"](spark, docs, "").collect()]
    # Brute force over row numbers; each group keeps its smallest id, null last.
    groups = {}
    for k, (c, _, _) in near_brute([(k, r[1]) for k, r in enumerate(rows)]).items():
        groups.setdefault(c, []).append(rows[k])
    assert len(kept) == len(groups) and set(kept) <= set(rows)
    order = lambda i: (i is None, i or 0)
    assert sorted((r[0] for r in kept), key=order) == sorted((min((r[0] for r in g), key=order) for g in groups.values()), key=order)
    # Mixing alone, on rows with null and repeated ids, against the repeats of single rows.
    many = [tuple(r) for r in dict(C.STAGES)["mixing"](spark, docs, "").collect()]
    from collections import Counter

    from ledgerlark.llm.mixing import mix_sources

    want = sum(r.repeats for r in mix_sources(docs).collect())
    before, after = Counter(rows), Counter(many)
    assert len(many) == want and all(after[r] <= 3 * before[r] for r in after)
    # Only at its boundary does a source take some of several equal rows once more than the others.
    split = [(r[3], r[1]) for r in after if after[r] % before[r]]
    assert len(split) == len({source for source, _ in split})


def test_clashing_columns_and_nulls(spark):
    """Columns named like the operators' own, nulls in every column, empty and long texts, repeated rows."""
    docs = make(spark)
    long = " ".join(f"long{i % 4000}" for i in range(20_000))
    odd = [(None, None, None, None, None), (500, None, "en", "a", None), (501, "", "en", None, 0), (502, long, "en", "a", 7), (502, long, "en", "a", 7)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    clash = ["_id", "id", "k", "_k", "repeats", "_repeats", "_n", "n", "gone", "_gone", "row", "_row", "spans", "_spans", "q_n_words", "_q_n_words", "class_id", "whole", "below"]
    wide = docs.select("*", *(F.lit(f"{c}!").alias(c) for c in clash))
    for name, stage in C.STAGES[:-1]:
        plain, wider = stage(spark, docs, ""), stage(spark, wide, "")
        assert wider.columns == wide.columns, name
        assert sorted(map(str, wider.select(*docs.columns).collect())) == sorted(map(str, plain.collect())), name
        assert wider.filter(" OR ".join(f"`{c}` IS DISTINCT FROM '{c}!'" for c in clash)).isEmpty(), name
    assert C.STAGES[-1][1](spark, wide, "").count() == docs.count()
