import random
import re

import duckdb

from ledgerlark.llm.quality import ABLATION_SQL, POLICIES, QUALITY_SQL, RULES, ablations, apply_policy, failed_rules, ledger, measure, quality_verdicts, repeat_words
from pyspark.sql import functions as F

GOOD = " ".join(f"Word{i} lower" + ("." if i % 7 == 0 else "") for i in range(60)).lower()


def brute_repeat(words):
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit.update(range(i, i + 8))
    return len(hit)


def test_repeat_words_brute_force():
    rng = random.Random(1)
    for n in (0, 7, 8, 9, 30, 120):
        for k in (1, 2, 5):
            words = [rng.choice("abcde"[:k]) for _ in range(n)]
            assert repeat_words(words) == brute_repeat(words)


def test_measure():
    text = "Aa b#|\n\nAa b#|\r\x0bx\x00y z\nAa b#|\n 12"
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    m = measure(text)
    assert m[:4] == (len(words), sum(map(len, words)), 6, 1)
    assert m[7] == 3 and m[5] == 4
    assert measure("") == (0,) * 9


def test_verdicts(spark):
    texts = [GOOD, None, "short text", "the same eight words come here again now " * 20, GOOD.upper(), " | ".join(GOOD.split()), "\n".join([GOOD] * 3)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, GOOD, "x"), (0, GOOD, "x")], "doc_id long, text string, kept string")
    got = quality_verdicts(docs).collect()
    kept = {r.doc_id: r.kept for r in got}
    assert len(got) == 9 and kept == {0: True, 1: False, 2: False, 3: False, 4: False, 5: False, 6: False, None: True}
    assert {r.doc_id: r.base_failed for r in got}[5] is False
    assert quality_verdicts(docs.limit(0)).count() == 0


def test_policies_and_ablations(spark):
    docs = spark.createDataFrame([(1, GOOD), (2, GOOD.upper()), (3, "a | b"), (4, None)], "doc_id long, text string")
    entries = ledger(docs).cache()
    assert apply_policy(entries, POLICIES["base"]).filter("kept").count() == 2
    found = {r.rule: r for r in ablations(entries, POLICIES["v2"]).collect()}
    assert len(found) == len(RULES) and found["upper_case"].n_only == 1 and found["too_short"].n_failed == 2 and found["symbols"].n_kept == 1
    assert entries.filter("doc_id = 2").select(failed_rules(F.col("failed"))).first()[0] == ["upper_case"]


def test_sql_outside_ascii(spark, tmp_path):
    """Letters, marks and numbers of many scripts, whole texts, nulls and repeated rows: the same rows in both engines."""
    rng = random.Random(8)
    odd = ["½", "²", "Ⅷ", "Ⓐ", "word", "ǅ", "ß", "É", "é", "Ω", "日本", "ªº", "١٢", "_", "12", "x\u0301", "🙂", "ЖЗ", "#", "ſ", "\x85", "\u3000y"]
    texts = [" ".join(rng.choice(odd) for _ in range(rng.randrange(80))) + rng.choice(["", "\n", "\nÉ É\nÉ É"]) for _ in range(300)]
    texts += ["½ ½ ² word Ⅷ Ⓐ", None, "", " ", GOOD, GOOD, "É" * 200_000, ("Ä ö " * 9 + "\n") * 300]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, GOOD), (3, texts[3])], "doc_id long, text string").repartition(3)
    docs.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    entries = quality_verdicts(docs)
    for ours, sql in ((entries, QUALITY_SQL), (ablations(entries, POLICIES["v2"]), ABLATION_SQL)):
        theirs = con.sql(sql)
        assert sorted(ours.columns) == sorted(theirs.columns)
        rows = sorted(repr(tuple(r)) for r in ours.select(*theirs.columns).collect())
        assert rows == sorted(repr(r) for r in theirs.fetchall())
