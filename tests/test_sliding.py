"""Sliding windows against sums over all pairs of rows."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import sliding as module
from ledgerlark.functions.sliding import Span, sliding
from ledgerlark.operators.rules import MICROS, evaluate_rules
from ledgerlark.sources.fixtures import VIEWS


@pytest.mark.parametrize("partitions", ["1", "9"])
def test_all_pairs(spark, partitions):
    rng = random.Random(int(partitions))
    rows = [(rng.choice(["hot", "hot", "b", "", None]), rng.choice([None, *range(300)]), rng.choice([None, 1, 2, 5]), rng.random() < 0.4) for _ in range(900)]
    df = spark.createDataFrame(rows, "who string, at long, v long, mine boolean")
    mine = F.col("mine")
    measures = {"v": F.col("v"), "ones": F.when(mine, F.lit(1).cast("long")), "exact": F.col("v").cast("decimal(18,2)") / 4}
    spans = {"back": Span("v", -20), "gap": Span("ones", -50, -1), "ahead": Span("exact", 0, 10), "far": Span("v", 5, 7, mine), "counted": Span("ones", -30, 0, mine)}
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    got = {(r.who, r.at): r for r in sliding(df, "who", "at", measures, spans, {"first": "counted"}).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got.keys() == {(w, t) for w, t, *_ in rows if t is not None}
    for (who, at), r in got.items():
        inside = lambda low, high: [x for x in rows if x[0] == who and x[1] is not None and at + low <= x[1] <= at + high]  # noqa: B023, E731
        some = any(x[3] for x in inside(0, 0))
        assert r.v == sum(x[2] or 0 for x in inside(0, 0)) and r.back == sum(x[2] or 0 for x in inside(-20, 0)) and r.gap == sum(x[3] for x in inside(-50, -1))
        assert float(r.ahead) == sum(x[2] or 0 for x in inside(0, 10)) / 4
        if some:
            assert r.far == sum(x[2] or 0 for x in inside(5, 7)) and r.counted == sum(x[3] for x in inside(-30, 0))
            assert r.first == min(x[1] for x in inside(-30, 0) if x[3])


def test_a_busy_sender_and_missing_senders(spark):
    """A day of one sender's legs and of legs without a sender, each in the windows of all later ones."""
    n = 40_000
    txns = spark.range(n).select(
        "id", F.when(F.col("id") % 2 == 0, F.lit(7).cast("long")).alias("from_customer_id"), F.lit(None).cast("long").alias("to_customer_id"), F.lit(60.0).alias("amount"), F.lit("USD").alias("currency"),
        F.lit("transfer").alias("transaction_type"), F.lit("US").alias("originating_country"), F.lit("US").alias("destination_country"), F.timestamp_micros(F.col("id") * (24 * MICROS // n)).alias("created_at"),
    )
    customers = spark.createDataFrame([], "customer_id long, full_name string, pep_status boolean, country string")
    got = evaluate_rules(txns, customers, spark.sql(VIEWS["aml_rule"])).select("txn_id", "category", F.get_json_object("details", "$.transaction_count").alias("n"), F.get_json_object("details", "$.micro_transaction_count").alias("m")).collect()
    counts = {r.txn_id: int(r.n) for r in got if r.category == "frequency"}
    assert counts == {i: i // 2 + 1 for i in range(n) if i // 2 + 1 >= 5}
    small = {r.txn_id: int(r.m) for r in got if r.category == "micro_transaction"}
    hour = 3600 * n // 86400  # legs in one hour before a leg
    assert small == {i: min(i, hour) // 2 + 1 for i in range(n) if min(i, hour) // 2 + 1 >= 4}


def test_keys_within_a_range_meet_there(spark, monkeypatch):
    """Only keys at the ends of ranges are brought together once more, and the sorted table goes when it is summed."""
    stored, gone, keep = {}, [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, name: stored.setdefault(name, keep(df, name)))
    monkeypatch.setattr(module, "discard", gone.append)
    df = spark.range(6000).select((F.col("id") % 600).alias("who"), F.col("id").alias("at"), F.lit(1).cast("long").alias("v"))
    got = sliding(df, "who", "at", {"v": F.col("v")}, {"back": Span("v", -1200)}).collect()
    assert len(got) == 6000 and all(r.back == min(3, r.at // 600 + 1) for r in got)
    assert len(gone) == 1 and stored["spans"].filter("_edge").select("who").distinct().count() <= 2 * 4
