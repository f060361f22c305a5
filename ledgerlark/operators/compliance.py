"""Compliance metrics, periodic reports and dashboards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions.columns import ago, count_if, fixed_values, hours_between, pct, rounded, stamp, total
from ledgerlark.functions.order import median

LEVELS = ["low", "medium", "high", "critical"]
CASE_STATUSES = ["open", "investigating", "pending_review", "escalated", "closed", "filed_sar"]
KYC_FIELDS = ["id_type", "id_number", "date_of_birth", "nationality", "address", "email"]
DONE = ["closed", "false_positive"]


def beside(*rows: DataFrame) -> DataFrame:
    """One-row frames side by side."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), rows)


def union(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def sar_filing_rate(cases: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    rows = cases.filter(F.col("status").isin("closed", "filed_sar") & (F.col("created_at") >= ago(as_of, days=days)))
    counts = rows.rollup(F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("closed"), count_if(F.col("sar_filed")).alias("sars"))
    return counts.select(F.coalesce("month", F.lit("all")).alias("month"), "closed", "sars", pct(F.col("sars"), F.col("closed")).alias("rate"))


def case_resolution_stats(cases: DataFrame) -> DataFrame:
    rows = cases.filter(F.col("closed_at").isNotNull() & F.col("created_at").isNotNull()).select(hours_between(F.col("created_at"), F.col("closed_at")).alias("h"))
    row = rows.agg(
        F.count("*").alias("n"), (F.sum(F.col("h").cast("decimal(18,4)")).cast("double") / F.count("*")).alias("mean"), F.min("h").alias("least"), F.max("h").alias("most"),
        count_if(F.col("h") <= 24).alias("within_24h"), count_if(F.col("h") <= 72).alias("within_72h"),
    )
    row = row.crossJoin(F.broadcast(median(rows, "h")))
    zero = lambda c: F.coalesce(rounded(F.col(c)), F.lit(0.0))
    return row.select("n", *(zero(c).alias(f"{c}_hours") for c in ("mean", "median", "least", "most")), "within_24h", "within_72h", pct(F.col("within_24h"), F.col("n")).alias("sla_24h_pct"), pct(F.col("within_72h"), F.col("n")).alias("sla_72h_pct"))


def rule_effectiveness(alerts: DataFrame, rules: DataFrame, as_of: str | None = None, days: int | None = None) -> DataFrame:
    """Per rule: alerts, false positives, confirmed, mean score. With days, only alerts of the window, and rules without
    any are kept with zeros."""
    rows = alerts if days is None else alerts.filter(F.col("created_at") >= ago(as_of, days=days))
    found = rows.groupBy("rule_id").agg(
        F.count("*").alias("n"), count_if(F.col("status") == "false_positive").alias("false_positives"), count_if(F.col("status").isin("escalated", "closed")).alias("confirmed"), total(F.col("risk_score")).alias("s"))
    joined = rules.select("rule_id", F.col("name").alias("rule_name"), "category").join(found, "rule_id", "inner" if days is None else "left").na.fill(0, ["n", "false_positives", "confirmed"])
    mean = F.when(F.col("n") > 0, rounded(F.col("s") / F.col("n"))).otherwise(0.0)
    return joined.select("rule_id", "rule_name", "category", "n", "false_positives", "confirmed", pct(F.col("false_positives"), F.col("n")).alias("false_positive_pct"), mean.alias("avg_score"))


def alert_to_case_conversion(alerts: DataFrame, cases: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    has = cases.filter(F.col("alert_id").isNotNull()).select("alert_id").distinct().withColumn("_case", F.lit(True))
    rows = alerts.filter(F.col("created_at") >= ago(as_of, days=days)).join(has, "alert_id", "left").rollup("severity").agg(F.count("*").alias("n"), F.count("_case").alias("with_case")).withColumn("severity", F.coalesce("severity", F.lit("all")))
    filled = fixed_values(alerts, "severity", [*LEVELS, "all"]).join(rows, "severity", "left").na.fill(0)
    return filled.withColumn("conversion_pct", pct(F.col("with_case"), F.col("n")))


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")


def kyc_coverage(customers: DataFrame) -> DataFrame:
    """One row per field and one for all fields together: non-blank count and share."""
    complete = reduce(lambda a, b: a & b, (~_blank(c) for c in KYC_FIELDS))
    row = customers.agg(F.count("*").alias("n"), *(count_if(~_blank(c)).alias(c) for c in KYC_FIELDS), count_if(complete).alias("all_fields"))
    names = [*KYC_FIELDS, "all_fields"]
    return row.select("n", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in names))).alias("x")).select("x.field", "x.filled", pct(F.col("x.filled"), F.col("n")).alias("pct"))


def compliance_score(cases: DataFrame, alerts: DataFrame, customers: DataFrame, as_of: str) -> DataFrame:
    sar = sar_filing_rate(cases, as_of).filter("month = 'all'").select(F.least(F.lit(100.0), F.least(F.col("rate"), F.lit(100.0)) * 1.5).alias("sar"))
    sla = case_resolution_stats(cases).select(F.col("sla_72h_pct").alias("sla"))
    a = alerts.agg(F.count("*").alias("n"), count_if(F.col("status").isin(DONE)).alias("done"), count_if(F.col("status") == "false_positive").alias("fp"))
    share = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y) * 100.0).otherwise(0.0)
    a = a.select(F.greatest(F.lit(0.0), 100.0 - share("fp", "done")).alias("fp"), share("done", "n").alias("resolved"))
    k = customers.agg(F.count("*").alias("n"), count_if(F.col("id_type").isNotNull() & F.col("id_number").isNotNull() & F.col("date_of_birth").isNotNull()).alias("full")).select(share("full", "n").alias("kyc"))
    parts = {"sar": 0.15, "sla": 0.20, "fp": 0.20, "resolved": 0.20, "kyc": 0.25}
    rows = beside(sar, sla, a, k).withColumn("overall", F.least(F.lit(100.0), rounded(reduce(lambda x, y: x + y, (rounded(F.col(c) * w) for c, w in parts.items())))))
    o = F.col("overall")
    return rows.select(*(rounded(F.col(c)).alias(c) for c in parts), "overall", F.when(o >= 90, "A").when(o >= 80, "B").when(o >= 70, "C").when(o >= 60, "D").otherwise("F").alias("grade"))


def regulatory_breaches(alerts: DataFrame, cases: DataFrame, customers: DataFrame, as_of: str) -> DataFrame:
    open_ = F.col("status") == "open"
    a = alerts.agg(count_if(open_ & (F.col("severity") == "critical") & (F.col("created_at") <= ago(as_of, days=5))).alias("stale_critical_alerts"))
    c = cases.agg(count_if(F.col("status").isin("open", "investigating") & (F.col("updated_at") <= ago(as_of, days=7))).alias("stale_open_cases"))
    listed = customers.filter("sanctions_flag").select("customer_id")
    s = alerts.filter(open_).join(listed, "customer_id", "left_semi").agg(F.count("*").alias("open_alerts_of_sanctioned"))
    return beside(a, c, s, listed.agg(F.count("*").alias("sanctioned_customers"))).withColumn("total_breaches", F.col("stale_critical_alerts") + F.col("stale_open_cases") + F.col("open_alerts_of_sanctioned"))


def kpi_table(cases: DataFrame, alerts: DataFrame, customers: DataFrame, as_of: str) -> DataFrame:
    """Flat KPI rows: value, benchmark, and whether it is met."""
    score = compliance_score(cases, alerts, customers, as_of)
    breaches = regulatory_breaches(alerts, cases, customers, as_of)
    sar = sar_filing_rate(cases, as_of).filter("month = 'all'")
    row = beside(score, breaches.select("total_breaches"), sar.select(F.col("rate").alias("sar_rate")))
    kpis = [("compliance_score", F.col("overall"), 80.0, True), ("sar_filing_rate", F.col("sar_rate"), 20.0, True), ("sla_72h", F.col("sla"), 80.0, True), ("false_positive_score", F.col("fp"), 70.0, True), ("alert_resolution", F.col("resolved"), 70.0, True), ("kyc_coverage", F.col("kyc"), 90.0, True), ("regulatory_breaches", F.col("total_breaches").cast("double"), 0.0, False)]
    rows = row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("kpi"), v.alias("value"), F.lit(b).alias("benchmark"), ((v >= b) if up else (v <= b)).alias("met")) for n, v, b, up in kpis))).alias("k"))
    return rows.select("k.*").withColumn("status", F.when(F.col("met"), "OK").otherwise("CONCERN")).drop("met")


def monthly_transaction_summary(txns: DataFrame, start: str, end: str) -> DataFrame:
    """Totals of [start, end) and the same by type, by currency and by day, in one pass of grouping sets."""
    rows = txns.filter((F.col("created_at") >= F.lit(start).cast("timestamp")) & (F.col("created_at") < F.lit(end).cast("timestamp"))).select(
        F.explode(F.array(*(F.struct(F.lit(k).alias("grouping"), v.alias("key")) for k, v in (("total", F.lit("all")), ("type", F.col("transaction_type")), ("currency", F.col("currency")), ("day", F.to_date("created_at").cast("string")))))).alias("g"), "amount", "flagged")
    return rows.groupBy("g.grouping", "g.key").agg(F.count("*").alias("n"), total(F.col("amount")).alias("volume"), count_if(F.col("flagged")).alias("flagged"))


def alert_statistics(alerts: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    rows = alerts.filter(F.col("created_at") >= ago(as_of, days=days))
    h = F.when((F.col("status") == "closed") & F.col("closed_at").isNotNull(), hours_between(F.col("created_at"), F.col("closed_at")).cast("decimal(18,4)"))
    row = rows.agg(
        F.count("*").alias("n"), *(count_if(F.col("severity") == s).alias(s) for s in LEVELS), *(count_if(F.col("status") == s).alias(f"status_{s}") for s in ("open", "under_review", "escalated", "closed", "false_positive")),
        F.sum(h).cast("double").alias("h"), F.count(h).alias("k"),
    )
    return row.withColumns({"false_positive_pct": pct(F.col("status_false_positive"), F.col("n")), "avg_resolution_hours": F.when(F.col("k") > 0, rounded(F.col("h") / F.col("k"))).otherwise(0.0)}).drop("h", "k")


def top_rules(alerts: DataFrame, rules: DataFrame, as_of: str | None = None, days: int | None = None, n: int = 5) -> DataFrame:
    rows = alerts if days is None else alerts.filter(F.col("created_at") >= ago(as_of, days=days))
    most = rows.filter(F.col("rule_id").isNotNull()).groupBy("rule_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule_id").limit(n)
    return most.join(rules.select("rule_id", F.col("name").alias("rule_name"), "severity"), "rule_id")


def sar_summary(cases: DataFrame, alerts: DataFrame, customers: DataFrame, year: int) -> DataFrame:
    rows = cases.filter(F.col("sar_filed") & (F.year("created_at") == year)).select("case_id", "case_number", "sar_reference", "alert_id", F.col("created_at").alias("filed_at"))
    rows = rows.join(alerts.select("alert_id", "customer_id", "severity"), "alert_id", "left").join(customers.select("customer_id", "full_name", "risk_level"), "customer_id", "left")
    return rows.select("case_id", "case_number", "sar_reference", "customer_id", "full_name", "risk_level", "severity", "filed_at")


def customer_risk_report(customers: DataFrame) -> DataFrame:
    """Counts by level, of special customers, and of the ten largest nationalities (else countries)."""
    row = customers.agg(*(count_if(F.col("risk_level") == s).alias(f"level_{s}") for s in LEVELS), count_if(F.col("pep_status")).alias("pep"), count_if(F.col("sanctions_flag")).alias("sanctioned"))
    flat = row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in row.columns))).alias("x")).select(F.lit("count").alias("kind"), "x.name", "x.n")
    places = customers.groupBy(F.coalesce("nationality", "country", F.lit("Unknown")).alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(10)
    return flat.unionByName(places.select(F.lit("place").alias("kind"), "name", "n"))


def _periods(df: DataFrame, column: str, *counts: Column) -> DataFrame:
    t = F.col(column)
    rows = df.filter(t.isNotNull()).rollup(F.year(t).alias("year"), F.quarter(t).alias("quarter"), F.month(t).alias("month")).agg(*counts)
    name = F.when(F.col("month").isNotNull(), F.format_string("%d-%02d", "year", "month")).when(F.col("quarter").isNotNull(), F.format_string("%d-Q%d", "year", "quarter")).when(F.col("year").isNotNull(), F.col("year").cast("string"))
    return rows.withColumn("period", name).filter(F.col("period").isNotNull()).drop("year", "quarter", "month")


def compliance_periods(txns: DataFrame, alerts: DataFrame, cases: DataFrame) -> DataFrame:
    """Month, quarter and year totals of the three facts, each in one rollup."""
    t = _periods(txns, "created_at", F.count("*").alias("txns"), total(F.col("amount")).alias("volume"), count_if(F.col("flagged")).alias("flagged"))
    a = _periods(alerts, "created_at", F.count("*").alias("alerts"), count_if(F.col("status") == "false_positive").alias("false_positives"))
    c = _periods(cases, "created_at", F.count("*").alias("cases"), count_if(F.col("sar_filed")).alias("sars"))
    return t.join(a, "period", "full").join(c, "period", "full").na.fill(0)


def period_report(txns: DataFrame, alerts: DataFrame, customers: DataFrame, cases: DataFrame, start: str, end: str) -> DataFrame:
    inside = F.col("created_at").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    t = txns.filter(inside).agg(F.count("*").alias("txns"), total(F.col("amount")).alias("volume"), count_if(F.col("flagged")).alias("flagged"), total(F.col("amount"), F.col("flagged")).alias("flagged_volume"))
    a = alerts.filter(inside).agg(F.count("*").alias("alerts"), *(count_if(F.col("severity") == s).alias(f"alerts_{s}") for s in LEVELS), *(count_if(F.col("status") == s).alias(f"alerts_{s}") for s in ("open", "closed", "escalated", "false_positive")))
    c = customers.agg(F.count("*").alias("customers"), count_if(F.col("risk_level").isin("high", "critical")).alias("high_risk"), count_if(inside).alias("new_customers"))
    return beside(t, a, c, cases.agg(count_if(F.col("status").isin("open", "investigating", "pending_review")).alias("open_cases")))


def dashboard_kpis(txns: DataFrame, alerts: DataFrame, cases: DataFrame, customers: DataFrame, audit: DataFrame, as_of: str) -> DataFrame:
    today, month = F.date_trunc("day", stamp(as_of)), F.date_trunc("month", stamp(as_of))
    at = F.col("created_at")
    t = txns.filter(at >= month).agg(count_if(at >= today).alias("txns_today"), F.count("*").alias("txns_month"), total(F.col("amount"), at >= today).alias("volume_today"), total(F.col("amount")).alias("volume_month"), count_if(F.col("flagged") & (at >= today)).alias("flagged_today"))
    open_ = F.col("status") == "open"
    a = alerts.agg(count_if(open_).alias("open_alerts"), count_if(open_ & F.col("severity").isin("high", "critical")).alias("high_critical_alerts"))
    c = cases.agg(count_if(F.col("status").isin("open", "investigating", "pending_review")).alias("open_cases"))
    k = customers.agg(count_if(F.col("risk_level").isin("high", "critical")).alias("high_risk_customers"))
    return beside(t, a, c, k, audit.agg(count_if((F.col("action") == "SANCTIONS_SEARCH") & (at >= today)).alias("screenings_today")))


def dashboard_series(txns: DataFrame, alerts: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    spark = txns.sparkSession
    frame = spark.range(days).select(F.date_sub(F.to_date(stamp(as_of)), F.col("id").cast("int")).alias("day"))
    first = F.date_sub(F.to_date(stamp(as_of)), days - 1)
    t = txns.filter(F.to_date("created_at") >= first).groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("txns"), total(F.col("amount")).alias("amount"))
    a = alerts.filter(F.to_date("created_at") >= first).groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("alerts"))
    return frame.join(t, "day", "left").join(a, "day", "left").na.fill(0)


def newest_open_alerts(alerts: DataFrame, customers: DataFrame, n: int = 10) -> DataFrame:
    reason = F.when(F.length("reason") > 80, F.concat(F.substring("reason", 1, 80), F.lit("..."))).otherwise(F.col("reason"))
    rows = alerts.filter(F.col("status") == "open").join(customers.select("customer_id", F.col("full_name").alias("customer_name")), "customer_id")
    return rows.orderBy(F.desc("created_at"), "alert_id").limit(n).select("alert_id", "alert_number", "customer_name", "severity", reason.alias("reason"), F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("created_at"))


def cases_by_status(cases: DataFrame) -> DataFrame:
    found = cases.groupBy("status").agg(F.count("*").alias("n"))
    return fixed_values(cases, "status", CASE_STATUSES).join(found, "status", "left").na.fill(0)


# High-risk places and amounts of suspicious-activity reports.
CASH = ["cash", "deposit", "withdrawal"]


def sar_packets(cases: DataFrame, alerts: DataFrame, customers: DataFrame, txns: DataFrame, rules: DataFrame, most: int = 20, threshold: float = 10000.0) -> DataFrame:
    """For every case: its subject, the latest flagged transactions it sent, their totals, activity types, a narrative and
    what is missing. The transactions are ranked per customer once, not per case."""
    newest = Window.partitionBy("customer_id").orderBy(F.desc("created_at"), F.desc("id"))
    latest = txns.filter(F.col("flagged") & F.col("from_customer_id").isNotNull()).withColumn("customer_id", F.col("from_customer_id")).withColumn("_k", F.row_number().over(newest)).filter(F.col("_k") <= most)
    band = F.col("amount").between(threshold * 0.7, threshold)
    per = latest.groupBy("customer_id").agg(
        F.count("*").alias("n_txns"), total(F.col("amount")).alias("total_amount"), F.array_join(F.array_sort(F.collect_set("currency")), ",").alias("currencies"), F.array_join(F.array_sort(F.collect_set("transaction_type")), ",").alias("types"),
        F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), count_if(band).alias("n_band"), count_if(F.col("is_international")).alias("n_international"), count_if(F.col("transaction_type").isin(CASH)).alias("n_cash"),
        F.sort_array(F.collect_list(F.struct("_k", "reference", "amount", "created_at"))).alias("transactions"),
    )
    rows = cases.select("case_id", "case_number", "alert_id", "status").join(alerts.select("alert_id", "customer_id", "rule_id", F.col("reason").alias("alert_reason")), "alert_id", "left")
    rows = rows.join(rules.select("rule_id", F.col("name").alias("rule_name")), "rule_id", "left").join(customers.select("customer_id", "full_name", "id_type", "id_number", "address", "date_of_birth"), "customer_id", "left").join(per, "customer_id", "left")
    rows = rows.na.fill(0, ["n_txns", "total_amount", "n_band", "n_international", "n_cash"])
    kinds = F.array_compact(F.array(F.when(F.col("n_band") >= 2, F.lit("structuring")), F.when(F.col("n_international") > 0, F.lit("international_transfers")), F.when(F.col("n_cash") >= 3, F.lit("cash_activity")), F.when(F.col("total_amount") >= threshold, F.lit("large_volume"))))
    missing = F.concat_ws(",", *(F.when(_blank(c), F.lit(c)) for c in ("full_name", "id_type", "id_number", "address", "date_of_birth")), F.when(F.col("n_txns") == 0, F.lit("transactions")))
    story = F.concat(F.coalesce("full_name", F.lit("Unknown subject")), F.lit(" made "), F.col("n_txns").cast("string"), F.lit(" flagged transactions of $"), F.format_number("total_amount", 2), F.lit(" in all. Alert: "), F.coalesce("alert_reason", F.lit("none")))
    return rows.select("case_id", "case_number", "customer_id", "full_name", "rule_name", "n_txns", "total_amount", F.coalesce("currencies", F.lit("")).alias("currencies"), F.coalesce("types", F.lit("")).alias("types"), "first_at", "last_at", F.concat_ws(",", kinds).alias("activity"), missing.alias("missing"), story.alias("narrative"), "transactions")


def data_health(entries: DataFrame, alerts: DataFrame, txns: DataFrame, rules: DataFrame, customers: DataFrame, cases: DataFrame, as_of: str) -> DataFrame:
    """One row per check: OK, WARN or CRITICAL, and the numbers it looked at."""
    grade = lambda bad, warn: F.when(bad, "CRITICAL").when(warn, "WARN").otherwise("OK")
    c, never = F.col, F.lit(False)
    open_, at = c("status") == "open", c("created_at")
    checks = [
        ("sanctions_list", entries.agg(F.count("*").alias("a"), F.lit(0).alias("b")), c("a") == 0, c("a") <= 10000),
        ("alert_queue", alerts.agg(count_if(open_).alias("a"), count_if(open_ & (c("severity") == "critical")).alias("b")), c("b") > 20, c("a") > 100),
        ("transaction_volume", txns.filter(at >= ago(as_of, hours=24)).agg(F.count("*").alias("a"), count_if(at >= ago(as_of, hours=1)).alias("b")), never, (c("a") == 0) | (c("b") == 0)),
        ("rules_engine", rules.agg(count_if(c("is_active")).alias("a"), F.count("*").alias("b")), c("a") == 0, c("a") < 3),
        ("high_risk_customers", customers.agg(count_if(c("risk_level").isin("high", "critical")).alias("a"), count_if(c("sanctions_flag")).alias("b")), never, c("b") > 0),
        ("sar_backlog", cases.agg(count_if((c("status") == "escalated") & (at <= ago(as_of, days=7))).alias("a"), F.lit(0).alias("b")), c("a") > 5, c("a") > 0),
    ]
    return union(*(row.select(F.lit(name).alias("check"), grade(bad, warn).alias("status"), c("a").cast("long").alias("a"), c("b").cast("long").alias("b")) for name, row, bad, warn in checks))
