"""Feature matrices and model metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions.columns import ago, count_if, rounded, stamp, total
from ledgerlark.functions.order import placed_values, quantiles, running
from ledgerlark.operators.behavior import deviation, moments
from ledgerlark.operators.risk import points

# Country sets and weights of the feature matrices.
HIGH = ["IR", "KP", "SY", "CU", "RU", "BY", "MM", "YE", "LY", "SO", "SD", "ZW", "CD", "CF", "ML", "IQ", "AF"]
MEDIUM = ["NG", "PK", "UA", "VE", "LB", "TN", "KZ", "UZ", "TM"]
RISK_HIGH = ["IR", "KP", "SY", "CU", "RU", "BY", "MM", "YE", "LY", "SO", "SD", "ZW", "CD", "CF", "ML", "IQ"]
SAR_HIGH = ["IR", "KP", "SY", "CU", "RU", "BY", "MM", "YE", "LY", "SO", "SD", "ZW", "CD", "AF"]
SAR_CODE = {"critical": 4, "high": 3, "medium": 2, "low": 1}
LEVEL_CODE = {"low": 0, "medium": 1, "high": 2, "critical": 3}
SEVERITY_WEIGHT = {"low": 1, "medium": 3, "high": 7, "critical": 15}


def _ratio(part: Column, n: Column, digits: int = 3) -> Column:
    return F.when(n > 0, rounded(part / n, digits)).otherwise(F.lit(0.0))


def _days_since(column: Column, as_of: str) -> Column:
    return F.floor((F.unix_micros(stamp(as_of)) - F.unix_micros(column)) / F.lit(86400e6)).cast("double")


def customer_features(customers: DataFrame, txns: DataFrame, alerts: DataFrame, as_of: str) -> DataFrame:
    """One row per customer: profile, amounts, velocity, time of day, geography and alerts, each history in a single
    aggregation but for the median, which is found in ranges of amounts, so a customer may have any number of them.
    Customers without history take the defaults."""
    a, h, c = F.col("amount"), F.hour("created_at"), F.col
    risky = F.coalesce(F.upper("originating_country").isin(HIGH), F.lit(False)) | F.coalesce(F.upper("destination_country").isin(HIGH), F.lit(False))
    s, q = moments(a)
    windows = {"1h": 1, "24h": 24, "7d": 168, "30d": 720}
    recent = {k: c("created_at") >= ago(as_of, hours=n) for k, n in windows.items()}
    t = txns.filter(c("from_customer_id").isNotNull()).groupBy(c("from_customer_id").alias("customer_id")).agg(
        F.count("*").alias("n"), s.alias("s"), q.alias("q"), F.max(a).alias("amount_max"), F.min(a).alias("amount_min"),
        count_if(a >= 10000).alias("large_txn_count"), count_if((a >= 8000) & (a < 10000)).alias("structuring_count"), count_if((a >= 1000) & (a % 1000 == 0)).alias("round_amount_count"),
        *(count_if(w).alias(f"count_{k}") for k, w in recent.items()), *(total(a, w).alias(f"volume_{k}") for k, w in recent.items()),
        count_if((h < 6) | (h >= 22)).alias("night"), count_if(F.weekday("created_at") >= 5).alias("weekend"), F.sum(h).alias("hours"), count_if(h.between(9, 17)).alias("business"),
        F.count_distinct("originating_country").alias("originating_countries"), F.count_distinct("destination_country").alias("destination_countries"), count_if(risky).alias("high_risk_country_txns"), count_if(c("is_international")).alias("international"),
    )
    al = alerts.groupBy("customer_id").agg(
        F.count("*").alias("alert_count"), count_if(c("created_at") >= ago(as_of, days=90)).alias("alert_count_90d"), count_if(c("severity") == "critical").alias("critical_alerts"), count_if(c("severity") == "high").alias("high_alerts"),
        count_if(c("status") == "open").alias("open_alerts"), F.sum(points("severity", SEVERITY_WEIGHT, 0)).alias("alert_severity_score"), F.max("created_at").alias("last_alert"),
    )
    middle = quantiles(txns.filter(c("from_customer_id").isNotNull()).select(c("from_customer_id").alias("customer_id"), "amount"), "customer_id", "amount", amount_median=0.5)
    rows = customers.join(t, "customer_id", "left").join(middle, "customer_id", "left").join(al, "customer_id", "left")
    n = F.coalesce("n", F.lit(0))
    mean, std = c("s") / c("n"), deviation(c("n"), c("s"), c("q"))
    zero = lambda x: F.coalesce(x, F.lit(0.0)).cast("double")
    place = lambda codes: F.coalesce(F.upper("country").isin(codes), F.lit(False)) | F.coalesce(F.upper("nationality").isin(codes), F.lit(False))
    return rows.select(
        "customer_id", points("risk_level", LEVEL_CODE, 0).alias("risk_level_code"), c("pep_status").cast("double").alias("is_pep"), c("sanctions_flag").cast("double").alias("is_sanctioned"),
        F.when(place(HIGH), 2.0).when(place(MEDIUM), 1.0).otherwise(0.0).alias("country_risk_code"), F.least(F.lit(3650.0), F.coalesce(_days_since(c("created_at"), as_of), F.lit(365.0))).alias("account_age_days"),
        rounded(F.log1p(zero("annual_income")), 6).alias("log_annual_income"), F.when(F.coalesce("id_number", F.lit("")) != "", 1.0).otherwise(0.0).alias("has_id_document"),
        zero(rounded(mean)).alias("amount_mean"), zero(rounded(std)).alias("amount_std"), zero("amount_max").alias("amount_max"), zero("amount_min").alias("amount_min"), zero(rounded(c("amount_median"))).alias("amount_median"),
        zero(F.when(std > 0, rounded((mean - c("amount_median")) * 3.0 / std, 4))).alias("amount_skew"), *(zero(k).alias(k) for k in ("large_txn_count", "structuring_count", "round_amount_count")),
        *(zero(f"{x}_{k}").alias(f"{x}_{k}") for k in windows for x in ("count", "volume")), _ratio(c("night"), n).alias("night_txn_ratio"), _ratio(c("weekend"), n).alias("weekend_txn_ratio"),
        F.coalesce(rounded(c("hours") / c("n")), F.lit(12.0)).alias("avg_hour_of_day"), _ratio(c("business"), n).alias("business_hours_ratio"), zero("originating_countries").alias("originating_countries"), zero("destination_countries").alias("destination_countries"),
        zero("high_risk_country_txns").alias("high_risk_country_txns"), _ratio(c("high_risk_country_txns"), n).alias("high_risk_country_ratio"), _ratio(c("international"), n).alias("international_ratio"),
        *(zero(k).alias(k) for k in ("alert_count", "alert_count_90d", "critical_alerts", "high_alerts", "open_alerts", "alert_severity_score")), F.least(F.lit(999.0), F.coalesce(_days_since(c("last_alert"), as_of), F.lit(999.0))).alias("days_since_last_alert"),
    )


RISK_FEATURES = [
    "txn_count", "log_total_amount", "log_avg_amount", "txn_velocity_per_week", "flag_ratio", "intl_ratio", "alert_count", "critical_alerts",
    "alert_severity_score", "risk_level_code", "is_pep", "is_sanctioned", "is_high_risk_country", "account_age_days",
]


def risk_model_features(customers: DataFrame, txns: DataFrame, alerts: DataFrame, as_of: str, days: int = 180) -> DataFrame:
    """Fourteen features over a lookback, for the risk model. Logarithms are rounded to six digits."""
    c = F.col
    recent = c("created_at") >= ago(as_of, days=days)
    t = txns.filter(recent & c("from_customer_id").isNotNull()).groupBy(c("from_customer_id").alias("customer_id")).agg(
        F.count("*").alias("n"), total(c("amount")).alias("s"), count_if(c("flagged")).alias("f"), count_if(c("is_international")).alias("i")
    )
    a = alerts.filter(recent).groupBy("customer_id").agg(
        F.count("*").alias("a"), count_if(c("severity") == "critical").alias("k"), count_if(c("severity") == "high").alias("h")
    )
    rows = customers.join(t, "customer_id", "left").join(a, "customer_id", "left").na.fill(0, ["n", "s", "f", "i", "a", "k", "h"])
    d = lambda x: x.cast("double")
    risky = F.coalesce(F.upper("country").isin(RISK_HIGH), F.lit(False)) | F.coalesce(F.upper("nationality").isin(RISK_HIGH), F.lit(False))
    values = [
        d(c("n")), rounded(F.log1p("s"), 6), F.when(c("n") > 0, rounded(F.log1p(c("s") / c("n")), 6)).otherwise(0.0),
        rounded(c("n") / F.lit(max(days / 7, 1.0)), 3), _ratio(c("f"), c("n")), _ratio(c("i"), c("n")), d(c("a")), d(c("k")), d(c("k") * 4 + c("h") * 2 + c("a")),
        points("risk_level", LEVEL_CODE, 0), F.coalesce(d(c("pep_status")), F.lit(0.0)), F.coalesce(d(c("sanctions_flag")), F.lit(0.0)), d(risky),
        F.least(F.lit(3650.0), F.coalesce(_days_since(c("created_at"), as_of), F.lit(365.0))),
    ]
    return rows.select("customer_id", *(v.alias(k) for k, v in zip(RISK_FEATURES, values, strict=True)))


def risk_training_set(customers: DataFrame, txns: DataFrame, alerts: DataFrame, cases: DataFrame, as_of: str, most_txns: int = 500, most_alerts: int = 200) -> DataFrame:
    """Features from each customer's latest transactions and alerts, and the label: any escalated or closed case."""
    newest = lambda key, uid: Window.partitionBy(key).orderBy(F.desc("created_at"), F.desc(uid))
    t = txns.withColumn("_k", F.row_number().over(newest("from_customer_id", "id"))).filter(F.col("_k") <= most_txns).drop("_k")
    a = alerts.withColumn("_k", F.row_number().over(newest("customer_id", "alert_id"))).filter(F.col("_k") <= most_alerts).drop("_k")
    bad = cases.filter(F.col("status").isin("escalated", "closed")).select("alert_id").join(alerts.select("alert_id", "customer_id"), "alert_id").select("customer_id").distinct().withColumn("label", F.lit(1))
    return risk_model_features(customers, t, a, as_of).join(bad, "customer_id", "left").withColumn("label", F.coalesce("label", F.lit(0)))


SAR_FEATURES = [
    "severity_score", "alert_risk_score", "alert_age_hours", "customer_risk_score", "is_pep", "has_sanctions", "txn_count_30d", "total_amount_30d",
    "flagged_count_30d", "flagged_ratio_30d", "is_international", "high_risk_country_txns", "mean_txn_amount", "max_txn_amount", "std_txn_amount",
    "off_hours_ratio", "unique_countries", "prior_alerts_count", "prior_cases_count", "txn_velocity_change",
]


def _earlier(alerts: DataFrame, cases: DataFrame) -> DataFrame:
    """``alert_id, prior_alerts, prior_cases``: alerts and cases of the alert's customer that were opened before it."""
    c = F.col
    opened = cases.select("alert_id", c("created_at").alias("at")).join(alerts.select("alert_id", "customer_id"), "alert_id")
    events = alerts.select("customer_id", "alert_id", c("created_at").alias("at"), F.lit(1).alias("is_alert")).unionByName(
        opened.select("customer_id", F.lit(None).cast("long").alias("alert_id"), "at", F.lit(0).alias("is_alert"))
    )
    before = Window.partitionBy("customer_id").orderBy(F.unix_micros(c("at").cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(x).over(before), F.lit(0)).alias(k) for k, x in (("prior_alerts", c("is_alert")), ("prior_cases", 1 - c("is_alert")))]
    return events.filter(c("customer_id").isNotNull()).select("alert_id", "is_alert", *sums).filter("is_alert = 1").drop("is_alert")


def sar_features(alerts: DataFrame, customers: DataFrame, txns: DataFrame, cases: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Twenty features of each alert: the alert, its customer, the customer's transactions in the days before it, and what
    was opened for that customer earlier. The velocity change compares the second half of the ordered list with the first,
    from four transactions on."""
    c = F.col
    t = txns.select(c("from_customer_id").alias("customer_id"), "id", "amount", c("created_at").cast("timestamp").alias("at"), "flagged", "is_international", "originating_country", "destination_country")
    raised = alerts.select("alert_id", "customer_id", c("created_at").alias("raised_at"))
    joined = raised.join(t, "customer_id").filter((c("at") <= c("raised_at")) & (c("at") >= c("raised_at") - F.make_interval(days=F.lit(days))))
    per = Window.partitionBy("alert_id")
    ranked = joined.withColumn("_k", F.row_number().over(per.orderBy("at", "id"))).withColumn("_n", F.count("*").over(per))
    first, paid, hour = c("_k") <= F.floor(c("_n") / 2), c("amount") != 0, F.hour("at")
    risky = F.coalesce(c("originating_country").isin(SAR_HIGH), F.lit(False)) | F.coalesce(c("destination_country").isin(SAR_HIGH), F.lit(False))
    s, q = moments(F.coalesce(c("amount"), F.lit(0.0)))
    rows = ranked.groupBy("alert_id").agg(
        F.count("*").alias("n"), s.alias("s"), q.alias("q"), count_if(paid).alias("p"), F.max(F.when(paid, c("amount"))).alias("m"), count_if(c("flagged")).alias("f"),
        count_if(c("is_international")).alias("i"), count_if(risky).alias("h"), count_if((hour < 8) | (hour >= 20)).alias("o"),
        F.count_distinct(F.when(c("destination_country") != "", c("destination_country"))).alias("u"),
        total(c("amount"), first).alias("early"), total(c("amount"), ~first).alias("late"),
    )
    d = lambda x: x.cast("double")
    who = customers.select("customer_id", points(F.lower("risk_level"), SAR_CODE, 1).alias("level"), F.coalesce(d(c("pep_status")), F.lit(0.0)).alias("pep"), F.coalesce(d(c("sanctions_flag")), F.lit(0.0)).alias("listed"))
    base = alerts.select("alert_id", "customer_id", points(F.lower("severity"), SAR_CODE, 1).alias("severity"), F.coalesce("risk_score", F.lit(0.0)).alias("score"), c("created_at").alias("raised_at"))
    base = base.join(who, "customer_id", "left").join(rows, "alert_id", "left").join(_earlier(alerts, cases), "alert_id", "left")
    base = base.na.fill(1.0, ["level"]).na.fill(0, ["pep", "listed", "n", "s", "q", "p", "m", "f", "i", "h", "o", "u", "early", "late", "prior_alerts", "prior_cases"])
    age = F.greatest(F.lit(0.0), rounded((F.unix_micros(stamp(as_of)) - F.unix_micros(c("raised_at").cast("timestamp"))) / F.lit(3.6e9)))
    values = [
        c("severity"), c("score"), age, c("level"), c("pep"), c("listed"), d(c("n")), c("s"), d(c("f")), _ratio(c("f"), c("n"), 4), _ratio(c("i"), c("n"), 4), d(c("h")),
        F.when(c("p") > 0, rounded(c("s") / c("p"))).otherwise(0.0), rounded(c("m")), rounded(deviation(c("p"), c("s"), c("q"))), _ratio(c("o"), c("n"), 4), d(c("u")),
        d(c("prior_alerts")), d(c("prior_cases")), F.when((c("n") >= 4) & (c("early") > 0), rounded(c("late") / c("early"), 4)).otherwise(1.0),
    ]
    return base.select("alert_id", *(v.cast("double").alias(k) for k, v in zip(SAR_FEATURES, values, strict=True)))


def time_features(txns: DataFrame) -> DataFrame:
    """Hour, weekday (Monday 0), month, weekend and off-hours; a missing time gives 12, 0, 1, 0, 0."""
    t = F.col("created_at")
    pick = lambda x, other: F.coalesce(x, F.lit(other)).cast("int")
    h, w = F.hour(t), F.weekday(t)
    return txns.select("id", pick(h, 12).alias("hour"), pick(w, 0).alias("weekday"), pick(F.month(t), 1).alias("month"), pick((w >= 5).cast("int"), 0).alias("is_weekend"), pick(((h < 8) | (h >= 20)).cast("int"), 0).alias("is_off_hours"))


def outliers(df: DataFrame, key: str, column: str, method: str = "iqr") -> DataFrame:
    """Rows outside the quartiles at places n//4 and 3n//4 by 1.5 ranges, or more than 3 deviations from the mean."""
    rows = df.filter(F.col(column).isNotNull()).select(key, column)
    if method == "z":
        s, q = moments(F.col(column))
        fit = rows.agg(F.count("*").alias("n"), s.alias("s"), q.alias("q")).select((F.col("s") / F.col("n")).alias("_m"), deviation(F.col("n"), F.col("s"), F.col("q")).alias("_d"))
        return rows.crossJoin(F.broadcast(fit)).filter((F.col("_d") > 0) & (F.abs(F.col(column) - F.col("_m")) / F.col("_d") > 3)).select(key, column)
    upto = placed_values(rows, column).crossJoin(F.broadcast(rows.agg(F.count("*").alias("_n"))))
    fit = upto.agg(F.min(F.when(F.col("_upto") > F.floor(F.col("_n") / 4), F.col(column))).alias("_a"), F.min(F.when(F.col("_upto") > F.floor(F.col("_n") * 3 / 4), F.col(column))).alias("_b"))
    low, high = F.col("_a") - (F.col("_b") - F.col("_a")) * 1.5, F.col("_b") + (F.col("_b") - F.col("_a")) * 1.5
    return rows.crossJoin(F.broadcast(fit)).filter((F.col(column) < low) | (F.col(column) > high)).select(key, column)


def _safe(a: Column, b: Column) -> Column:
    return F.when(b > 0, rounded(a / b, 4)).otherwise(F.lit(0.0))


def classification_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Confusion counts and the usual shares at a threshold, with a grade by F1."""
    p, y = F.col("score") >= threshold, F.col("label") == 1
    row = scored.agg(count_if(p & y).alias("tp"), count_if(p & ~y).alias("fp"), count_if(~p & ~y).alias("tn"), count_if(~p & y).alias("fn"))
    c = F.col
    row = row.select("*", _safe(c("tp") + c("tn"), c("tp") + c("fp") + c("tn") + c("fn")).alias("accuracy"), _safe(c("tp"), c("tp") + c("fp")).alias("precision"), _safe(c("tp"), c("tp") + c("fn")).alias("recall"), _safe(c("tn"), c("tn") + c("fp")).alias("specificity"), _safe(c("fp"), c("fp") + c("tn")).alias("fpr"), _safe(c("fn"), c("fn") + c("tp")).alias("fnr"))
    f1 = _safe(c("tp") * 2, c("tp") * 2 + c("fp") + c("fn"))
    return row.withColumn("f1", f1).withColumn("grade", F.when(c("f1") >= 0.9, "A").when(c("f1") >= 0.8, "B").when(c("f1") >= 0.7, "C").when(c("f1") >= 0.6, "D").otherwise("F"))


def ranking_metrics(scored: DataFrame) -> DataFrame:
    """ROC area (ties count half) and average precision, from counts per score: scores are ordered, not rows."""
    per = scored.groupBy("score").agg(F.count("*").alias("n"), F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("p"))
    c = F.col
    rows = running(per, F.desc("score"), _p="p", _n="n").crossJoin(F.broadcast(per.agg(F.sum("p").alias("_pos"), F.sum("n").alias("_all"))))
    negatives = c("n") - c("p")
    area = F.sum(negatives * (c("_p") - c("p")) + negatives * c("p") / 2.0)
    precision = F.sum((c("p") / c("_pos") * (c("_p") / c("_n"))).cast("decimal(38,12)")).cast("double")
    sums = rows.agg(area.alias("area"), precision.alias("ap"), F.max("_pos").alias("_pos"), F.max("_all").alias("_all"))
    return sums.select(rounded(c("area") / (c("_pos") * (c("_all") - c("_pos"))), 6).alias("roc_auc"), rounded(c("ap"), 6).alias("average_precision"))


def threshold_sweep(scored: DataFrame) -> DataFrame:
    """Metrics at 0.1 to 0.9, all in one pass."""
    marks = F.explode(F.array(*(F.lit(k / 10) for k in range(1, 10)))).alias("threshold")
    p, y, c = F.col("score") >= F.col("threshold"), F.col("label") == 1, F.col
    rows = scored.select("score", "label", marks).groupBy("threshold").agg(F.count("*").alias("n"), count_if(p & y).alias("tp"), count_if(p & ~y).alias("fp"), count_if(~p & y).alias("fn"))
    return rows.select("threshold", _safe(c("tp"), c("tp") + c("fp")).alias("precision"), _safe(c("tp"), c("tp") + c("fn")).alias("recall"), _safe(c("tp") * 2, c("tp") * 2 + c("fp") + c("fn")).alias("f1"), rounded((c("tp") + c("fp")) * 100.0 / c("n")).alias("flagged_pct"))


def compare_models(a: DataFrame, b: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Metric by metric, the difference and the winner; the model with the higher recall is recommended, A on a tie."""
    names = ["accuracy", "precision", "recall", "f1"]
    both = classification_metrics(a, threshold).select(*(F.col(k).alias(f"a_{k}") for k in names)).crossJoin(F.broadcast(classification_metrics(b, threshold).select(*(F.col(k).alias(f"b_{k}") for k in names))))
    rows = both.select(F.when(F.col("b_recall") > F.col("a_recall"), "B").otherwise("A").alias("recommended"), F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(f"a_{k}").alias("a"), F.col(f"b_{k}").alias("b")) for k in names))).alias("x")).select("x.*", "recommended")
    return rows.withColumn("delta", rounded(F.col("b") - F.col("a"), 4)).withColumn("winner", F.when(F.col("b") > F.col("a"), "B").when(F.col("a") > F.col("b"), "A").otherwise("tie"))
