"""Transaction, alert and customer analytics: groupings, shares and short top lists over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions.columns import ago, count_if, fixed_values, hours_between, pct, rounded, stamp, total
from ledgerlark.functions.order import median

LEVELS = ["low", "medium", "high", "critical"]
BUCKETS = [(0, 1000), (1000, 5000), (5000, 10000), (10000, 50000), (50000, 100000), (100000, None)]
CLOSED = ["closed", "false_positive"]


def since(df: DataFrame, as_of: str, days: int, column: str = "created_at") -> DataFrame:
    return df.filter((F.col(column) >= ago(as_of, days=days)) & (F.col(column) <= stamp(as_of)))


def top(df: DataFrame, n: int | None, *order: Column | str) -> DataFrame:
    """The first n rows in an order that ends in a unique column; all rows without n."""
    return df if n is None else df.orderBy(*order).limit(n)


def share(part: Column, digits: int = 2) -> Column:
    """Percentage of the whole result's sum; the frame has a row per group."""
    return pct(part, F.sum(part).over(Window.partitionBy()), digits)


# Transactions


def txn_volume_trend(txns: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    rows = since(txns, as_of, days).groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"), total(F.col("amount")).alias("amount"), count_if(F.col("flagged")).alias("flagged"))
    return rows.withColumn("flag_rate", pct(F.col("flagged"), F.col("n")))


def txn_hourly_distribution(txns: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    rows = since(txns, as_of, days).groupBy(F.hour("created_at").alias("hour")).agg(F.count("*").alias("n"), total(F.col("amount")).alias("s"), count_if(F.col("flagged")).alias("flagged"))
    return rows.select("hour", "n", rounded(F.col("s") / F.col("n")).alias("avg_amount"), "flagged")


def txn_flag_rate_by_type(txns: DataFrame) -> DataFrame:
    rows = txns.groupBy("transaction_type").agg(F.count("*").alias("n"), count_if(F.col("flagged")).alias("flagged"))
    return rows.withColumn("flag_rate", pct(F.col("flagged"), F.col("n")))


def txn_amount_distribution(txns: DataFrame) -> DataFrame:
    """Half-open amount buckets; empty ones are kept."""
    names = [f"{a}-{b}" if b else f"{a}+" for a, b in BUCKETS]
    which = F.coalesce(*(F.when((F.col("amount") >= a) & (F.col("amount") < (b or float("inf"))), F.lit(name)) for (a, b), name in zip(BUCKETS, names, strict=True)))
    found = txns.groupBy(which.alias("bucket")).agg(F.count("*").alias("n"), total(F.col("amount")).alias("amount"))
    return fixed_values(txns, "bucket", names).join(found, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("amount", F.lit(0.0)).alias("amount"))


def txn_country_corridors(txns: DataFrame, n: int | None = 15) -> DataFrame:
    a, b = F.col("originating_country"), F.col("destination_country")
    rows = txns.filter(a != b).groupBy(a.alias("origin"), b.alias("destination")).agg(F.count("*").alias("n"), count_if(F.col("flagged")).alias("flagged"), total(F.col("amount")).alias("amount"))
    return top(rows, n, F.desc("flagged"), F.desc("n"), "origin", "destination")


def txn_by_country(txns: DataFrame) -> DataFrame:
    rows = txns.filter(F.col("originating_country").isNotNull()).groupBy(F.col("originating_country").alias("country")).agg(F.count("*").alias("n"), total(F.col("amount")).alias("volume"), count_if(F.col("flagged")).alias("flagged"))
    return rows.withColumn("avg_amount", rounded(F.col("volume") / F.col("n")))


def txn_summary(txns: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    rows = since(txns, as_of, days).agg(F.count("*").alias("n"), total(F.col("amount")).alias("volume"), count_if(F.col("flagged")).alias("flagged"), count_if(F.col("is_international")).alias("international"))
    average = F.when(F.col("n") > 0, rounded(F.col("volume") / F.col("n"))).otherwise(0.0)
    return rows.select("n", "volume", "flagged", pct(F.col("flagged"), F.col("n")).alias("flag_rate"), average.alias("avg_amount"), "international", pct(F.col("international"), F.col("n")).alias("international_rate"))


# Alerts


def alert_velocity(alerts: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Total of the last days, mean per day, peak day (the earliest of equals) and change against the days before."""
    daily = alerts.filter((F.col("created_at") >= ago(as_of, days=2 * days)) & (F.col("created_at") <= stamp(as_of))).withColumn("recent", F.col("created_at") >= ago(as_of, days=days))
    by_day = daily.groupBy("recent", F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
    rank = F.struct("n", -F.datediff("day", F.lit("1970-01-01")))
    row = by_day.agg(
        F.coalesce(F.sum(F.when(F.col("recent"), F.col("n"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(~F.col("recent"), F.col("n"))), F.lit(0)).alias("previous"),
        F.max_by(F.when(F.col("recent"), F.col("day")), F.when(F.col("recent"), rank)).alias("peak_day"), F.max(F.when(F.col("recent"), F.col("n"))).alias("peak"),
    )
    change = F.when(F.col("previous") > 0, rounded((F.col("n") - F.col("previous")) * 100.0 / F.col("previous"))).otherwise(F.when(F.col("n") > 0, 100.0).otherwise(0.0))
    return row.select("n", rounded(F.col("n") / float(days)).alias("per_day"), F.col("peak_day").cast("string").alias("peak_day"), "peak", "previous", change.alias("change_pct"))


def alert_by_rule(alerts: DataFrame, rules: DataFrame) -> DataFrame:
    closed = F.col("status").isin(CLOSED)
    counts = [F.count("*").alias("n"), count_if(F.col("status") == "open").alias("open"), count_if(closed).alias("closed"), *(count_if(F.col("severity") == s).alias(s) for s in LEVELS)]
    found = alerts.groupBy("rule_id").agg(*counts)
    names = ["n", "open", "closed", *LEVELS]
    return rules.select("rule_id", F.col("name").alias("rule_name")).join(found, "rule_id", "left").select("rule_id", "rule_name", *(F.coalesce(c, F.lit(0)).alias(c) for c in names))


def alert_rates(alerts: DataFrame) -> DataFrame:
    open_ = F.col("status") == "open"
    row = alerts.agg(
        F.count("*").alias("n"), count_if(F.col("status") == "escalated").alias("escalated"), count_if(F.col("status") == "false_positive").alias("false_positive"),
        *(count_if(open_ & (F.col("severity") == s)).alias(f"open_{s}") for s in LEVELS),
    )
    return row.withColumn("escalation_rate", pct(F.col("escalated"), F.col("n"))).withColumn("false_positive_rate", pct(F.col("false_positive"), F.col("n")))


def alert_time_to_resolve(alerts: DataFrame) -> DataFrame:
    h = hours_between(F.col("created_at"), F.col("closed_at"))
    rows = alerts.filter(F.col("closed_at").isNotNull()).select(h.alias("h"))
    mean = F.sum(F.col("h").cast("decimal(18,4)")).cast("double") / F.count("*")
    row = rows.agg(F.count("*").alias("n"), rounded(mean).alias("mean_h"), rounded(F.min("h")).alias("min_h"), rounded(F.max("h")).alias("max_h"))
    return row.crossJoin(F.broadcast(median(rows, "h"))).select("n", "mean_h", rounded(F.col("median")).alias("median_h"), "min_h", "max_h")


def alert_severity_trend(alerts: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    severity = F.coalesce("severity", F.lit("low"))
    rows = since(alerts, as_of, days).withColumn("severity", severity).groupBy(F.to_date("created_at").alias("day")).pivot("severity", LEVELS).count()
    filled = rows.select("day", *(F.coalesce(s, F.lit(0)).alias(s) for s in LEVELS))
    return filled.withColumn("n", sum((F.col(s) for s in LEVELS[1:]), F.col("low")))


def top_alerted_customers(alerts: DataFrame, customers: DataFrame, n: int = 10) -> DataFrame:
    """The n customers with most alerts; one without a customer row drops out after the cut."""
    most = top(alerts.groupBy("customer_id").agg(F.count("*").alias("n"), count_if(F.col("severity") == "critical").alias("critical")), n, F.desc("n"), "customer_id")
    return most.join(customers.select("customer_id", "full_name", "risk_level"), "customer_id")


def alert_resolution_breakdown(alerts: DataFrame) -> DataFrame:
    rows = alerts.groupBy("status").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy())
    resolved = F.sum(F.when(F.col("status").isin(CLOSED), F.col("n")).otherwise(0)).over(Window.partitionBy())
    return rows.select("status", "n", share(F.col("n")).alias("pct"), pct(resolved, whole).alias("resolved_pct"))


# Customers


def risk_distribution(customers: DataFrame) -> DataFrame:
    found = customers.groupBy("risk_level").agg(F.count("*").alias("n"))
    rows = fixed_values(customers, "risk_level", LEVELS).join(found, "risk_level", "left").select("risk_level", F.coalesce("n", F.lit(0)).alias("n"))
    high = F.sum(F.when(F.col("risk_level").isin("high", "critical"), F.col("n")).otherwise(0)).over(Window.partitionBy())
    return rows.select("risk_level", "n", share(F.col("n")).alias("pct"), high.alias("high_and_critical"))


def risk_level_trend(customers: DataFrame, as_of: str, months: int = 6) -> DataFrame:
    """New customers of the last months. A month starts 30 days times i before the first of this month (not moved to a
    first), and ends on the first of the month after its start."""
    spark = customers.sparkSession
    start = F.expr(f"date_trunc('month', TIMESTAMP '{as_of}')") - F.make_interval(days=F.col("i") * 30)
    frame = spark.range(months).select(F.col("id").cast("int").alias("i")).select(start.alias("month_start")).withColumn("month_end", F.expr("date_trunc('month', month_start) + INTERVAL '1' MONTH"))
    day = customers.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"), count_if(F.col("risk_level").isin("high", "critical")).alias("high"))
    # Starts and ends lie on midnight, so counts per day are enough: a bounded frame joins a few months.
    found = F.broadcast(frame).join(day, (F.col("day") >= F.to_date("month_start")) & (F.col("day") < F.to_date("month_end")), "left")
    rows = found.groupBy("month_start").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("high"), F.lit(0)).alias("high"))
    return rows.select(F.to_date("month_start").cast("string").alias("month_start"), "n", "high", pct(F.col("high"), F.col("n")).alias("high_rate"))


def _special(customers: DataFrame, alerts: DataFrame, flag: str) -> DataFrame:
    active = alerts.filter(F.col("status") == "open").select("customer_id").distinct().withColumn("open_alert", F.lit(True))
    return customers.join(active, "customer_id", "left").withColumn("open_alert", F.coalesce("open_alert", F.lit(False))).withColumn("mine", F.coalesce(F.col(flag), F.lit(False)))


def pep_statistics(customers: DataFrame, alerts: DataFrame) -> DataFrame:
    mine, high = F.col("mine"), F.col("risk_level").isin("high", "critical")
    row = _special(customers, alerts, "pep_status").agg(
        F.count("*").alias("customers"), count_if(mine).alias("pep"), count_if(mine & high).alias("pep_high_risk"), count_if(mine & F.col("sanctions_flag")).alias("pep_sanctioned"),
        count_if(mine & F.col("open_alert")).alias("pep_with_open_alert"), F.count_distinct(F.when(mine, F.col("nationality"))).alias("pep_nationalities"),
    )
    return row.withColumn("pep_pct", pct(F.col("pep"), F.col("customers")))


def sanctioned_statistics(customers: DataFrame, alerts: DataFrame) -> DataFrame:
    mine = F.col("mine")
    row = _special(customers, alerts, "sanctions_flag").agg(
        F.count("*").alias("customers"), count_if(mine).alias("sanctioned"), *(count_if(mine & (F.col("risk_level") == s)).alias(s) for s in LEVELS),
        count_if(mine & F.col("open_alert")).alias("with_open_alert"), F.count_distinct(F.when(mine, F.col("nationality"))).alias("nationalities"),
    )
    return row.withColumn("sanctioned_pct", pct(F.col("sanctioned"), F.col("customers")))


def flagged_by_nationality(customers: DataFrame, flag: str) -> DataFrame:
    return customers.filter(F.col(flag)).groupBy(F.coalesce("nationality", F.lit("Unknown")).alias("nationality")).agg(F.count("*").alias("n"))


def nationality_risk(customers: DataFrame) -> DataFrame:
    rows = customers.groupBy(F.coalesce("nationality", F.lit("Unknown")).alias("nationality")).agg(
        F.count("*").alias("n"), count_if(F.col("risk_level").isin("high", "critical")).alias("high"), count_if(F.col("pep_status")).alias("pep"), count_if(F.col("sanctions_flag")).alias("sanctioned"))
    return rows.withColumn("high_pct", pct(F.col("high"), F.col("n")))


def risk_by_country(customers: DataFrame, n: int | None = 15) -> DataFrame:
    rows = customers.filter(F.col("country").isNotNull()).groupBy("country").agg(F.count("*").alias("n"), count_if(F.col("risk_level").isin("high", "critical")).alias("high"), count_if(F.col("pep_status")).alias("pep"))
    return top(rows, n, F.desc("n"), "country")


def risk_by_occupation(customers: DataFrame, n: int = 20) -> DataFrame:
    code = F.element_at(F.create_map(*(x for i, s in enumerate(LEVELS) for x in (F.lit(s), F.lit(i)))), F.col("risk_level"))
    rows = customers.filter(F.col("occupation").isNotNull()).groupBy("occupation").agg(F.count("*").alias("n"), F.sum(F.coalesce(code, F.lit(0))).alias("s"), count_if(F.col("risk_level").isin("high", "critical")).alias("high"))
    return top(rows, n, F.desc("n"), "occupation").select("occupation", "n", rounded(F.col("s") / F.col("n")).alias("mean_level"), pct(F.col("high"), F.col("n")).alias("high_pct"))


def alerts_per_risk_level(customers: DataFrame, alerts: DataFrame) -> DataFrame:
    per = alerts.groupBy("customer_id").agg(F.count("*").alias("alerts"))
    rows = customers.join(per, "customer_id", "left").groupBy("risk_level").agg(F.count("*").alias("customers"), F.coalesce(F.sum("alerts"), F.lit(0)).alias("alerts"), F.count("alerts").alias("with_alerts"))
    filled = fixed_values(customers, "risk_level", LEVELS).join(rows, "risk_level", "left").na.fill(0)
    return filled.select("risk_level", "customers", "alerts", F.when(F.col("customers") > 0, rounded(F.col("alerts") / F.col("customers"))).otherwise(0.0).alias("avg_alerts"), pct(F.col("with_alerts"), F.col("customers")).alias("with_alerts_pct"))


def risk_score_histogram(txns: DataFrame, bins: int = 10) -> DataFrame:
    """Half-open bins of [0, 100) for scores above 0; 100 itself is outside."""
    width = 100.0 / bins
    found = txns.filter((F.col("risk_score") > 0) & (F.col("risk_score") < 100)).groupBy(F.floor(F.col("risk_score") / width).alias("bin")).agg(F.count("*").alias("n"))
    return txns.sparkSession.range(bins).select(F.col("id").alias("bin")).join(found, "bin", "left").select("bin", (F.col("bin") * width).alias("low"), F.coalesce("n", F.lit(0)).alias("n"))


def weekly_risk_trend(txns: DataFrame, as_of: str, weeks: int = 8) -> DataFrame:
    rows = since(txns, as_of, 7 * weeks).groupBy(F.to_date(F.date_trunc("week", "created_at")).cast("string").alias("week")).agg(F.count("*").alias("n"), count_if(F.col("risk_score") >= 60).alias("high"))
    return rows.withColumn("high_pct", pct(F.col("high"), F.col("n")))
