import datetime as dt
import random

import duckdb
import pytest

from ledgerlark.functions.columns import padded
from ledgerlark.operators import models as M
from ledgerlark.operators.features import RISK_FEATURES
from ledgerlark.plans import sql
from pyspark.sql import functions as F


def test_numbers_are_padded_and_never_cut(spark):
    numbers = [1, 42, 99_998, 99_999, 100_000, 100_001, 1_234_567]
    want = [str(n).zfill(5) for n in numbers]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select(padded(F.col("n"), 5).alias("t")).collect()
    assert [r.t for r in rows] == want
    assert [duckdb.connect().execute(f"SELECT {sql.padded(str(n), 5)}").fetchone()[0] for n in numbers] == want


def risk_rows(spark, n):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        x = [rng.random() for _ in RISK_FEATURES]
        rows.append((i, *x, int(x[4] + 0.2 * x[6] > 0.6)))
    return spark.createDataFrame(rows, "customer_id long, " + ", ".join(f"{f} double" for f in RISK_FEATURES) + ", label int")


def test_risk_model(spark):
    rows = risk_rows(spark, 400)
    train, held = rows.filter("customer_id < 300"), rows.filter("customer_id >= 300")
    model = M.train_risk_model(train, trees=15)
    got = {r.customer_id: r for r in M.predict_risk(model, held).collect()}
    labels = {r.customer_id: r.label for r in held.collect()}
    assert len(got) == 100 and sum((got[i].probability >= 0.5) == (y == 1) for i, y in labels.items()) >= 90
    assert all(0 <= r.probability <= 1 for r in got.values()) and len({r.band for r in got.values()}) > 1
    best = M.top_importances(model)
    assert len(best) == 5 and best[0][0] == RISK_FEATURES[4] and best == sorted(best, key=lambda x: -x[1])
    with pytest.raises(ValueError):
        M.train_risk_model(rows.limit(19))


def transactions(spark):
    rng, start = random.Random(5), dt.datetime(2024, 1, 1, 9)
    rows = []
    for c, n in ((1, 60), (2, 9), (3, 25), (None, 40)):
        for i in range(n):
            odd = i == 7
            when = start + dt.timedelta(days=i % 20, hours=17 if odd else rng.randrange(8))
            rows.append((len(rows), c, 1e7 if odd else 100.0 + rng.randrange(90) + 0.5, odd, "wire" if odd else "payment", "atm" if odd else "online", when))
    rows += [(900, 3, None, None, None, None, None)]
    return spark.createDataFrame(rows, "id long, from_customer_id long, amount double, is_international boolean, transaction_type string, channel string, created_at timestamp")


@pytest.mark.parametrize("most", [25_600, 20])
def test_anomaly_scores(spark, most):
    txns = transactions(spark)
    got = {r.txn_id: r for r in M.anomaly_scores(txns, most=most).collect()}
    owner = {r.id: r.from_customer_id for r in txns.collect()}
    assert {owner[i] for i in got} == {1, 3} and len(got) == 60 + 26
    if most > 60:  # all rows fit the trees
        assert got[7].is_anomaly and got[7].score == max(r.score for r in got.values() if r.customer_id == 1)
    assert all(0 <= r.score <= 100 for r in got.values()) and {r.confidence for r in got.values()} == {30, 100}
    assert got[7].reason in M.FOREST_FEATURES and sum(r.is_anomaly for r in got.values() if r.customer_id == 1) <= 3
    assert M.anomaly_scores(txns.limit(0)).count() == 0


def test_stratified_folds_and_held_out_rows(spark):
    rows = spark.range(1003).selectExpr("id", "IF(id % 10 = 0, 1, IF(id % 97 = 0, NULL, 0)) AS label", "'x' AS _kind")
    dealt = M.stratified_folds(rows, "id", 4)
    assert dealt.columns == [*rows.columns, "_fold"] and dealt.count() == 1003
    counts = {}
    for r in dealt.groupBy("label", "_fold").count().collect():
        counts.setdefault(r.label, []).append(r["count"])
    assert len(counts) == 3 and all(len(c) == 4 and max(c) - min(c) <= 1 for c in counts.values())
    fit, test = M.held_out(rows, "id")
    assert fit.join(test, "id").isEmpty() and fit.count() + test.count() == 1003 and abs(test.filter("label = 1").count() - 101 / 5) < 1
    assert M.stratified_folds(rows.limit(0), "id").count() == 0
