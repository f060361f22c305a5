"""Hand-made rows at the boundaries, streams against batch, XML lists, models."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.functions.names import fold, jaro_winkler, match_score
from ledgerlark.operators import listing, models, network
from ledgerlark.operators.rules import evaluate_rules, generate_alerts
from ledgerlark.sources.fixtures import VIEWS
from ledgerlark.sources.sanctions_xml import load_sdn_xml, load_un_xml
from ledgerlark.streaming.jobs import current_alerts, customer_sessions, stream_alerts, stream_velocity_windows

NOW = dt.datetime(2024, 1, 10, 12)
TXN = "id long, from_customer_id long, to_customer_id long, amount double, currency string, transaction_type string, originating_country string, destination_country string, created_at timestamp"


def txn(i, amount=100.0, sender=1, to=2, kind="transfer", a="US", b="US", at=NOW):
    return (i, sender, to, float(amount), "USD", kind, a, b, at)


@pytest.fixture(scope="module")
def rules(spark):
    return spark.sql(VIEWS["aml_rule"])


@pytest.fixture(scope="module")
def customers(spark):
    return spark.createDataFrame([(1, "Ann", False, "US"), (2, "Bob", True, "DE"), (3, "Cy", False, "IR")], "customer_id long, full_name string, pep_status boolean, country string")


def fired(spark, rows, customers, rules, **more):
    return {(r.txn_id, r.category): r for r in evaluate_rules(spark.createDataFrame(rows, TXN), customers, rules, **more).collect()}


def test_rule_boundaries(spark, customers, rules):
    rows = [txn(1, 15000, 11), txn(2, 10000, 12), txn(3, 5000, 13), txn(4, 9500, 14), txn(5, 8000, 15), txn(6, 9990, 16), txn(7, 10500, 17), txn(8, 9876.54, 18), txn(9, 500, 19), txn(10, 50000, 2), txn(11, 50000, 21), txn(12, 10, 22, a="IR"), txn(13, 10, 23, b="KP"), txn(14, 10, 24, b="DE"), txn(15, 10, 3)]
    got = fired(spark, rows, customers, rules)
    on = lambda c: {i for i, k in got if k == c}
    assert on("large_transaction") == {1, 2, 7, 10, 11} and got[1, "large_transaction"].risk_score == 65.0
    assert on("structuring") == {4, 5, 6, 8} and got[4, "structuring"].risk_score == 55.0
    assert on("pep_transaction") == {10} and on("high_risk_country") == {12, 13, 15}
    assert on("round_amount") == {1, 2, 7, 10, 11}
    assert got[1, "large_transaction"].reason.startswith("Transaction amount $15,000.00 exceeds")


def test_zero_thresholds_null_senders_and_equal_times(spark, customers, rules):
    zeros = rules.withColumn("threshold_amount", F.lit(0.0)).withColumn("threshold_count", F.lit(0)).withColumn("time_window_hours", F.lit(0))
    rows = [txn(i, 50, None) for i in range(6)] + [txn(10 + i, 60, 5, at=NOW + dt.timedelta(minutes=i)) for i in range(5)]
    got = fired(spark, rows, customers, zeros)
    assert {i for i, c in got if c == "frequency"} == {0, 1, 2, 3, 4, 5, 14}
    alerts, rejected = generate_alerts(evaluate_rules(spark.createDataFrame(rows, TXN), customers, rules))
    assert alerts.filter("customer_id IS NULL").isEmpty() and rejected.filter("customer_id IS NOT NULL").isEmpty() and not rejected.isEmpty()
    assert evaluate_rules(spark.createDataFrame([], TXN), customers, rules).count() == 0
    assert evaluate_rules(spark.createDataFrame(rows, TXN), customers, rules.withColumn("is_active", F.lit(False))).count() == 0


def test_ranges_don_t_change_windows(spark, customers, rules):
    rng = np.random.default_rng(3)
    rows = [txn(i, rng.choice([20, 9000, 3000]), int(rng.integers(1, 4)), int(rng.integers(1, 4)), at=NOW + dt.timedelta(hours=float(rng.uniform(0, 800)))) for i in range(400)]
    found = []
    for n in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(fired(spark, rows, customers, rules))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {k: v.risk_score for k, v in found[0].items()} == {k: v.risk_score for k, v in found[1].items()} and len(found[0]) > 100


def test_names():
    assert [fold(n) for n in ("Müller", "Mr John Smith", "Al-Shabaab", None)] == ["muller", "john smith", "al shabaab", ""]
    assert match_score("osama", "osama bin laden") == 100 and 70 <= match_score("laden", "ladin") < 100 and match_score("john smith", "vladimir putin") < 50
    assert 80 < match_score("osama", "osamaa") <= 100 and match_score("bin laden", "osama bin laden al qaeda") == 100
    assert round(jaro_winkler("martha", "marhta"), 4) == 0.9611 and round(jaro_winkler("dixon", "dicksonx"), 4) == 0.8133


def test_cycles_and_isolation(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 1), (3, 4), (4, 5), (5, 5)], "src long, dst long")
    assert {(r.length, r.nodes) for r in network.graph_cycles(edges).collect()} == {(2, "1,2"), (3, "1,2,3")}
    rows = [(i, *([0.1] * 6)) for i in range(15)] + [(99, *([9.0] * 6))]
    scores = {r.node: r.depth for r in network.isolation_depth_scores(spark.createDataFrame(rows, "node long, " + ", ".join(f"f_{n} double" for n in network.FEATURES))).collect()}
    assert scores[99] == 1 and scores[0] == 1
    x = np.r_[np.random.default_rng(1).normal(size=(200, 3)), [[9.0, 9.0, 9.0]]]
    assert models.isolation_scores(x).argmax() == 200


def test_stream_equals_batch(spark, customers, rules, tmp_path):
    rng = np.random.default_rng(5)
    rows = sorted((txn(i, rng.choice([20, 9000, 3000, 15000]), int(rng.integers(1, 4)), int(rng.integers(1, 4)), at=NOW + dt.timedelta(minutes=10 * i)) for i in range(120)), key=lambda r: r[8])
    for k in range(3):
        spark.createDataFrame(rows[40 * k : 40 * k + 40], TXN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(TXN).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream_alerts(arriving, customers, rules, str(tmp_path / "seen"), str(tmp_path / "alerts"), str(tmp_path / "cp"))
    query.awaitTermination()
    key = lambda df: {(r.txn_id, r.rule_id, r.risk_score) for r in df.collect()}
    assert key(spark.read.parquet(str(tmp_path / "alerts"))) == key(evaluate_rules(spark.createDataFrame(rows, TXN), customers, rules))


def test_stream_with_late_rows_equals_batch(spark, customers, rules, tmp_path):
    """Rows of several days in no order: every match of the batch job is written once, whichever row completes it."""
    rng = np.random.default_rng(6)
    rows = [txn(i, rng.choice([20, 9000, 3000, 15000]), int(rng.integers(1, 6)), int(rng.integers(1, 6)), at=NOW + dt.timedelta(hours=3 * i)) for i in range(90)]
    order = rng.permutation(90)
    for k in range(3):
        spark.createDataFrame([rows[i] for i in order[30 * k : 30 * k + 30]], TXN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(TXN).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream_alerts(arriving, customers, rules, str(tmp_path / "seen"), str(tmp_path / "alerts"), str(tmp_path / "cp")).awaitTermination()
    got = [(r.txn_id, r.rule_id) for r in spark.read.parquet(str(tmp_path / "alerts")).collect()]
    want = {(r.txn_id, r.rule_id) for r in evaluate_rules(spark.createDataFrame(rows, TXN), customers, rules).collect()}
    assert len(got) == len(set(got)) and set(got) == want


def test_stream_with_long_windows_and_withdrawn_matches_equals_batch(spark, customers, rules, tmp_path):
    """Windows of a week, rows in any order, a late row that breaks up a burst of small amounts: what holds at the end is
    what the batch job finds, scores and reasons too, and some match was taken back."""
    rng = np.random.default_rng(11)
    weekly = rules.withColumn("time_window_hours", F.when(F.col("category") == "micro_transaction", 4).otherwise(168)).withColumn("threshold_count", F.when(F.col("category") == "micro_transaction", 2).otherwise(F.col("threshold_count")))
    rows = [txn(i, rng.choice([9000, 3000, 15000]), int(rng.integers(1, 5)), int(rng.integers(1, 5)), at=NOW + dt.timedelta(hours=7 * i)) for i in range(60)]
    rows = [rows[i] for i in rng.permutation(60)]
    # Two small amounts 5 minutes apart match; an earlier one makes their mean gap too long.
    start = NOW + dt.timedelta(days=3)
    small = [txn(200, 20, 4, 3, at=start + dt.timedelta(minutes=60)), txn(201, 20, 4, 3, at=start + dt.timedelta(minutes=55)), txn(202, 20, 9, 8, at=start + dt.timedelta(minutes=240)), txn(203, 20, 9, 8, at=start + dt.timedelta(minutes=235)), txn(204, 20, 9, 8, at=start)]
    batches = [[*rows[:20], small[2], small[3]], [*rows[20:40], small[0]], [*rows[40:], small[1], small[4]]]
    weekly = weekly.withColumn("threshold_count", F.when(F.col("category") == "frequency", 3).otherwise(F.col("threshold_count")))
    for b in batches:
        spark.createDataFrame(b, TXN).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(TXN).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream_alerts(arriving, customers, weekly, str(tmp_path / "seen"), str(tmp_path / "alerts"), str(tmp_path / "cp"), str(tmp_path / "changes")).awaitTermination()
    adds, changes = spark.read.parquet(str(tmp_path / "alerts")), spark.read.parquet(str(tmp_path / "changes"))
    key = lambda df: sorted((r.txn_id, r.rule_id, r.risk_score, r.reason, r.details) for r in df.collect())
    assert key(current_alerts(adds, changes)) == key(evaluate_rules(spark.createDataFrame(sum(batches, []), TXN), customers, weekly))
    assert {r.change for r in changes.collect()} == {"update", "withdraw"}


def test_windows_and_sessions(spark, tmp_path):
    rows = [txn(i, 50, 1, at=NOW + dt.timedelta(minutes=m)) for i, m in enumerate((0, 10, 20, 200, 205, 5000))]
    df = spark.createDataFrame(rows, TXN)
    assert sorted(r.n for r in customer_sessions(df, late=None).collect()) == [1, 2, 3]
    df.write.parquet(str(tmp_path / "in"))
    for name, job, want in (("w", stream_velocity_windows, 5), ("s", customer_sessions, 3)):
        q = job(spark.readStream.schema(TXN).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(name).agg(F.max("n")).first()[0] == want


SDN = """<?xml version="1.0"?><Sanctions xmlns="urn:x"><ReferenceValueSets><AliasTypeValues><AliasType ID="1400">A.K.A.</AliasType><AliasType ID="1403">Name</AliasType></AliasTypeValues>
<PartySubTypeValues><PartySubType ID="4">Individual</PartySubType></PartySubTypeValues><CountryValues><Country ID="11">Iran</Country></CountryValues></ReferenceValueSets>
<Locations><Location ID="7"><LocationCountry CountryID="11"/><LocationPart LocPartTypeID="1454"><LocationPartValue><Value>Tehran</Value></LocationPartValue></LocationPart></Location></Locations>
<DistinctParties><DistinctParty FixedRef="36"><Profile ID="36" PartySubTypeID="4"><Identity><Alias AliasTypeID="1400" Primary="false" LowQuality="true"><DocumentedName><DocumentedNamePart><NamePartValue X="1">AX</NamePartValue></DocumentedNamePart></DocumentedName></Alias>
<Alias AliasTypeID="1403" Primary="true" LowQuality="false"><DocumentedName><DocumentedNamePart><NamePartValue X="1">DOE</NamePartValue></DocumentedNamePart><DocumentedNamePart><NamePartValue X="2">John</NamePartValue></DocumentedNamePart></DocumentedName></Alias></Identity></Profile></DistinctParty></DistinctParties>
<SanctionsEntries><SanctionsEntry ProfileID="36"><SanctionsMeasure><Comment>SDGT</Comment></SanctionsMeasure><SanctionsMeasure><Comment>IRAN</Comment></SanctionsMeasure><SanctionsMeasure><Comment>SDGT</Comment></SanctionsMeasure></SanctionsEntry></SanctionsEntries></Sanctions>"""
UN = """<?xml version="1.0"?><CONSOLIDATED_LIST><INDIVIDUALS><INDIVIDUAL><DATAID>5</DATAID><FIRST_NAME>ALI</FIRST_NAME><SECOND_NAME>KHAN</SECOND_NAME><UN_LIST_TYPE>Taliban</UN_LIST_TYPE><INDIVIDUAL_ALIAS><QUALITY>Low</QUALITY><ALIAS_NAME>AK</ALIAS_NAME></INDIVIDUAL_ALIAS>
<INDIVIDUAL_ALIAS><QUALITY>Good</QUALITY><ALIAS_NAME>ALI KHAN</ALIAS_NAME></INDIVIDUAL_ALIAS><INDIVIDUAL_ADDRESS><NOTE>x</NOTE></INDIVIDUAL_ADDRESS><INDIVIDUAL_ADDRESS><CITY>Kabul</CITY></INDIVIDUAL_ADDRESS><INDIVIDUAL_DOCUMENT><TYPE_OF_DOCUMENT>Passport</TYPE_OF_DOCUMENT><NUMBER>007</NUMBER></INDIVIDUAL_DOCUMENT></INDIVIDUAL></INDIVIDUALS>
<ENTITIES><ENTITY><DATAID>9</DATAID><FIRST_NAME>ACME</FIRST_NAME><UN_LIST_TYPE>DPRK</UN_LIST_TYPE></ENTITY></ENTITIES></CONSOLIDATED_LIST>"""


def test_xml_lists(spark, tmp_path):
    (tmp_path / "sdn.xml").write_text(SDN)
    entries, aliases, locations = load_sdn_xml(spark, str(tmp_path / "sdn.xml"))
    assert [tuple(r) for r in entries.collect()] == [("36", "DOE John", "Individual", ["SDGT", "IRAN"], "SDN")]
    assert {(r.alias_name, r.alias_type, r.is_primary, r.low_quality) for r in aliases.collect()} == {("AX", "A.K.A.", False, True), ("DOE John", "Name", True, False)}
    assert [(r.location_id, r.city, r.country) for r in locations.collect()] == [("7", "Tehran", "Iran")]
    (tmp_path / "un.xml").write_text(UN)
    entries, aliases, locations, ids = load_un_xml(spark, str(tmp_path / "un.xml"))
    assert {(r.fixed_ref, r.primary_name) for r in entries.collect()} == {("UN-5", "ALI KHAN"), ("UN-9", "ACME")}
    assert {(r.alias_name, r.low_quality) for r in aliases.collect()} == {("ALI KHAN", False), ("AK", True), ("ACME", False)}
    assert [(r.fixed_ref, r.city) for r in locations.collect()] == [("UN-5", "Kabul")] and [r.id_value for r in ids.collect()] == ["007"]


def test_descent_equals_numpy_and_folds(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(size=(120, 3))
    y = (x[:, 0] + 0.2 * rng.normal(size=120) > 0.5).astype(int)
    rows = spark.createDataFrame([(i, *map(float, v), int(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))], "alert_id long, a double, b double, c double, label int")
    model = models.train_sar_classifier(rows, ["a", "b", "c"], rate=0.5, epochs=15)
    z = (x - x.min(axis=0)) / (x.max(axis=0) - x.min(axis=0))
    w, bias = np.zeros(3), 0.0
    for _ in range(15):
        e = 1 / (1 + np.exp(-(z @ w + bias))) - y
        w, bias = w - 0.5 * z.T @ e / 120, bias - 0.5 * e.mean()
    assert np.allclose(model.weights, w) and np.isclose(model.bias, bias)
    fit = lambda train: lambda test: models.predict_sar(models.train_sar_classifier(train, ["a", "b", "c"], rate=0.5, epochs=5), test).select("alert_id", F.col("probability").alias("score"))
    assert {r.metric for r in models.cross_validate(rows, fit, "alert_id", k=3).collect()} == {"accuracy", "precision", "recall", "f1"}


def test_bundle(spark, tmp_path):
    frames = {"a": spark.range(3), "b": spark.range(0)}
    assert {(r.name, r.n) for r in listing.export_report_bundle(frames, str(tmp_path), "2024-01-31").collect()} == {("a", 3), ("b", 0)}


def test_long_chains(spark):
    at = lambda i: NOW + dt.timedelta(hours=i)
    rows = [txn(i, 1000 + i, sender=i, to=i + 1, at=at(i)) for i in range(1, 13)]
    df = spark.createDataFrame(rows, TXN)
    got = {(r.start_id, r.length, r.end_id) for r in network.graph_layering_chains(df, "2024-01-12 00:00:00").collect()}
    assert got == {(i, n, i + n - 1) for n in range(2, 10) for i in range(1, 14 - n)}
    assert {r.txn_ids for r in network.pattern_layering(df).collect()} == {",".join(map(str, range(i, i + n))) for n in range(3, 13) for i in range(1, 14 - n)}
    assert {r.customer_id: r.chains for r in network.layering_confidence(df).collect()} == {i: 11 - i for i in range(1, 11)}


def test_an_account_with_many_like_amounts(spark):
    """Chains through a cell that is dealt into parts are those of a search over all pairs."""
    rng = np.random.default_rng(5)
    at = lambda i: NOW + dt.timedelta(minutes=int(rng.integers(0, 1500)))
    rows = [txn(i, 1000 + float(rng.integers(0, 150)), sender=100 + i if i % 2 else 1, to=1 if i % 2 else 900 + i, at=at(i)) for i in range(240)]
    df = spark.createDataFrame(rows, TXN)
    close = F.abs(F.col("amount_next") - F.col("amount")) / F.col("amount") < 0.15
    spread = lambda dense: sorted(tuple(r.ids) for _, found in network.chains(df, 24, close, 0.15, 2, 2, True, dense) for r in found.select("ids").collect())
    a = df.select("id", "from_customer_id", "to_customer_id", "amount", "created_at")
    b = a.select(F.col("id").alias("j"), F.col("from_customer_id").alias("f"), F.col("to_customer_id").alias("t"), F.col("amount").alias("amount_next"), F.col("created_at").alias("later"))
    gap = F.unix_timestamp("later") - F.unix_timestamp("created_at")
    want = a.join(b, F.col("to_customer_id") == F.col("f")).filter((gap > 0) & (gap < 86400) & close & (F.col("t") != F.col("from_customer_id")))
    want = sorted((r.id, r.j) for r in want.collect())
    assert len(want) > 2000 and spread(7) == want and spread(2048) == want


def test_anomalies_of_large_customers_are_comparable(spark):
    rng = np.random.default_rng(4)
    rows = [(*txn(i, float(rng.lognormal(5, 1)), sender=1 + (i % 4 == 0), at=NOW + dt.timedelta(minutes=int(rng.integers(0, 9000)))), bool(rng.integers(2))) for i in range(1200)]
    df = spark.createDataFrame(rows, TXN + ", is_international boolean")
    whole = {r.txn_id: r for r in models.anomaly_scores(df).collect()}
    cut = {r.txn_id: r for r in models.anomaly_scores(df, most=320).collect()}
    assert whole.keys() == cut.keys() and len(cut) == 1200
    big = [i for i in cut if cut[i].customer_id == 1]
    # One range, one quantile and one set of means for the customer, however many parts it has.
    assert sum(cut[i].score == 0 for i in big) == 1 and sum(cut[i].score == 100 for i in big) == 1
    assert sum(cut[i].is_anomaly for i in big) == 45
    assert max(cut[i].score for i in big if not cut[i].is_anomaly) <= min(cut[i].score for i in big if cut[i].is_anomaly)
    assert all(cut[i].reason == whole[i].reason for i in big) and all(cut[i] == whole[i] for i in cut if i not in set(big))
    # Rows that are equal in all features get equal scores, in whatever part.
    same = spark.createDataFrame([(*txn(i, 100.0 + i % 7), False) for i in range(900)], TXN + ", is_international boolean")
    by = {}
    for r in models.anomaly_scores(same, most=320).collect():
        by.setdefault(r.txn_id % 7, set()).add(r.score)
    assert all(len(s) == 1 for s in by.values())
