"""Customer risk: scores, trajectories and level recalculation, for all customers at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.columns import ago, count_if, rounded, total
from ledgerlark.operators.rules import HIGH_RISK_COUNTRIES

# Country sets, points and weights of the scores.
MEDIUM_RISK_COUNTRIES = ["RU", "BY", "CN", "NG", "PK", "AF", "MM", "LA", "KH", "ZW"]
BATCH_COUNTRIES = ["IR", "KP", "SY", "AF", "MM", "YE", "SO"]
LEVEL_POINTS = {"low": 0, "medium": 15, "high": 30, "critical": 50}
SEVERITY_POINTS = {"low": 2, "medium": 5, "high": 10, "critical": 20}
BATCH_BASE = {"low": 0.10, "medium": 0.40, "high": 0.70, "critical": 0.90}
PREDICTED_BASE = {"low": 10, "medium": 35, "high": 60, "critical": 80}
TOP_BASE = {"low": 10, "medium": 40, "high": 75, "critical": 100}


def points(column: str | Column, table: dict[str, float], default: float) -> Column:
    out, x = F, F.col(column) if isinstance(column, str) else column
    for value, n in table.items():
        out = out.when(x == value, F.lit(float(n)))
    return out.otherwise(F.lit(float(default)))


def steps(x: Column, *marks: tuple[float, float]) -> Column:
    """Points of the first mark that ``x`` exceeds, marks from high to low."""
    out = F
    for mark, n in marks:
        out = out.when(x > mark, F.lit(float(n)))
    return out.otherwise(F.lit(0.0))


def band(x: Column, marks: tuple[float, float, float], names: tuple[str, str, str, str] = ("critical", "high", "medium", "low")) -> Column:
    return F.when(x >= marks[0], names[0]).when(x >= marks[1], names[1]).when(x >= marks[2], names[2]).otherwise(names[3])


def customer_risk_scores(customers: DataFrame, txns: DataFrame, alerts: DataFrame, as_of: str) -> DataFrame:
    """Profile (at most 60), 90 days of transactions (at most 30) and 180 days of alerts (at most 25), with a band."""
    t = txns.filter(F.col("created_at") >= ago(as_of, days=90)).groupBy(F.col("from_customer_id").alias("customer_id")).agg(F.count("*").alias("n"), count_if(F.col("flagged")).alias("f"), total(F.col("amount")).alias("s"))
    a = alerts.filter((F.col("created_at") >= ago(as_of, days=180)) & (F.col("status") != "false_positive")).groupBy("customer_id").agg(F.sum(points("severity", SEVERITY_POINTS, 0)).alias("w"), F.max(F.col("severity") == "critical").alias("c"))
    rows = customers.join(t, "customer_id", "left").join(a, "customer_id", "left")
    country = F.upper(F.coalesce("nationality", "country", F.lit("")))
    flag = lambda c, n: F.when(F.col(c), float(n)).otherwise(0.0)
    place = F.when(country.isin(HIGH_RISK_COUNTRIES), 20.0).when(country.isin(MEDIUM_RISK_COUNTRIES), 10.0).otherwise(0.0)
    profile = F.least(F.lit(60.0), points("risk_level", LEVEL_POINTS, 0) + flag("pep_status", 20) + flag("sanctions_flag", 30) + place)
    behaviour = F.when(F.col("n").isNull(), 0.0).otherwise(F.least(F.lit(30.0), F.col("f") / F.col("n") * 25.0 + steps(F.col("s"), (500000, 15), (100000, 8), (50000, 4)) + steps(F.col("n"), (50, 10), (20, 5))))
    weighed = F.least(F.lit(25.0), F.col("w") / 50.0 * 25.0)
    history = F.when(F.col("w").isNull(), 0.0).otherwise(F.when(F.col("c"), F.least(F.lit(25.0), weighed + 10.0)).otherwise(weighed))
    rows = rows.select("customer_id", "customer_number", profile.alias("p"), behaviour.alias("b"), history.alias("h"))
    score = F.least(F.lit(100.0), rounded(F.col("p") + F.col("b") + F.col("h"), 1))
    return rows.withColumn("risk_score", score).select(
        "customer_id", "customer_number", "risk_score", band(F.col("risk_score"), (75, 50, 25)).alias("risk_band"),
        rounded(F.col("p"), 1).alias("profile_score"), rounded(F.col("b"), 1).alias("transaction_score"), rounded(F.col("h"), 1).alias("alert_score"),
    )


def _change(new: Column, old: Column) -> Column:
    return F.when(old == 0, F.when(new > 0, 100.0).otherwise(0.0)).otherwise(rounded((new - old) / old * 100.0, 1))


def risk_trajectory(customers: DataFrame, txns: DataFrame, alerts: DataFrame, as_of: str) -> DataFrame:
    """Three spans of 30 days, their changes, velocity points, trend, predicted score and pattern match."""
    spans = {"recent": (0, 30), "mid": (30, 60), "older": (60, 90)}
    inside = {k: (F.col("created_at") >= ago(as_of, days=b)) & (F.col("created_at") < ago(as_of, days=a)) for k, (a, b) in spans.items()}
    window = (F.col("created_at") >= ago(as_of, days=90)) & (F.col("created_at") < ago(as_of, days=0))
    t = txns.filter(window).groupBy(F.col("from_customer_id").alias("customer_id")).agg(*(x for k, w in inside.items() for x in (
        count_if(w).alias(f"{k}_n"), total(F.col("amount"), w).alias(f"{k}_amount"), count_if(w & F.col("flagged")).alias(f"{k}_flagged"),
        F.count_distinct(F.when(w, F.col("destination_country"))).alias(f"{k}_countries"))))
    a = alerts.filter(window & (F.col("status") != "false_positive")).groupBy("customer_id").agg(*(x for k, w in inside.items() for x in (
        count_if(w).alias(f"{k}_alerts"), count_if(w & (F.col("severity") == "critical")).alias(f"{k}_critical"), count_if(w & (F.col("severity") == "high")).alias(f"{k}_high"))))
    rows = customers.select("customer_id", "risk_level").join(t, "customer_id", "left").join(a, "customer_id", "left").na.fill(0)
    for k in spans:
        rows = rows.withColumn(f"{k}_ratio", F.when(F.col(f"{k}_n") > 0, rounded(F.col(f"{k}_flagged") / F.col(f"{k}_n"), 3)).otherwise(0.0))
    c = F.col
    rows = rows.withColumns({f"{x}_change": _change(c(f"recent_{y}"), c(f"mid_{y}")) for x, y in (("txn", "n"), ("amount", "amount"), ("alert", "alerts"), ("flag", "ratio"))})
    velocity = (
        steps(c("txn_change"), (50, 15), (20, 8)) + steps(c("amount_change"), (100, 20), (50, 12), (20, 6)) + steps(c("alert_change"), (100, 25), (50, 15), (0, 8)) + steps(c("flag_change"), (50, 20), (20, 10))
        + steps(c("recent_critical"), (0, 15)) + steps(c("recent_high"), (1, 10)) + steps(c("recent_countries") - c("mid_countries"), (2, 10))
    )
    rows = rows.withColumn("velocity_score", F.least(F.lit(100.0), velocity))
    v = c("velocity_score")
    return rows.select(
        "customer_id", "recent_n", "mid_n", "older_n", "recent_amount", "mid_amount", "recent_alerts", "mid_alerts", "recent_ratio", "txn_change", "amount_change", "alert_change", "flag_change", "velocity_score",
        band(v, (60, 30, 10), ("escalating", "increasing", "stable", "declining")).alias("trend"), F.least(F.lit(100.0), rounded(points("risk_level", PREDICTED_BASE, 10) + v * 0.4, 1)).alias("predicted_score"),
        F.least(F.lit(95.0), rounded(v * 0.87, 1)).alias("pattern_match"),
    )


def batch_risk_recalculate(customers: DataFrame, alerts: DataFrame, as_of: str, min_change: float = 0.0) -> DataFrame:
    recent = alerts.filter((F.col("created_at") >= ago(as_of, days=30)) & (F.col("status") != "false_positive")).groupBy("customer_id").agg(F.count("*").alias("n"))
    old_level = F.coalesce("risk_level", F.lit("low"))
    flag = lambda c, n: F.when(c, n).otherwise(0.0)
    bonus = flag(F.col("pep_status"), 0.10) + flag(F.col("sanctions_flag"), 0.20) + F.least(F.coalesce("n", F.lit(0)) * 0.05, F.lit(0.20)) + flag(F.upper("nationality").isin(BATCH_COUNTRIES), 0.05)
    rows = customers.join(recent, "customer_id", "left").select("customer_id", old_level.alias("old_level"), points("risk_level", BATCH_BASE, 0.10).alias("old_score"), bonus.alias("bonus"))
    rows = rows.withColumn("new_score", F.least(F.lit(1.0), rounded(F.col("old_score") + F.col("bonus"), 3)))
    rows = rows.withColumn("new_level", band(F.col("new_score"), (0.75, 0.55, 0.30))).withColumn("delta", rounded(F.abs(F.col("new_score") - F.col("old_score")), 3))
    changed = (F.col("delta") >= 0.001) | (F.col("old_level") != F.col("new_level"))
    return rows.select("customer_id", "old_score", "new_score", "old_level", "new_level", changed.alias("changed"), (changed & (F.col("delta") >= min_change)).alias("committed"))


def top_risky_customers(customers: DataFrame, alerts: DataFrame, n: int | None = 20) -> DataFrame:
    active = alerts.filter(F.col("status").isin("open", "escalated")).groupBy("customer_id").agg(F.count("*").alias("alerts"))
    flag = lambda c, k: F.when(F.col(c), float(k)).otherwise(0.0)
    score = points("risk_level", TOP_BASE, 10) + flag("pep_status", 15) + flag("sanctions_flag", 20) + F.least(F.coalesce("alerts", F.lit(0)) * 5.0, F.lit(30.0))
    rows = customers.join(active, "customer_id", "left").select("customer_id", "full_name", "risk_level", F.coalesce("alerts", F.lit(0)).alias("alerts"), F.least(F.lit(150.0), score).alias("score"))
    return rows if n is None else rows.orderBy(F.desc("score"), "customer_id").limit(n)
