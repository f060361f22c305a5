"""Behaviour and laundering patterns per customer, for all customers in one aggregation or window each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions.columns import ago, cents, count_if, dollars_of, money, pct, rounded, total
from ledgerlark.functions.sliding import Span, sliding
from ledgerlark.operators.risk import band, steps
from ledgerlark.operators.rules import MICROS

DAY = 24 * MICROS


def sent(txns: DataFrame) -> DataFrame:
    return txns.filter(F.col("from_customer_id").isNotNull()).withColumn("customer_id", F.col("from_customer_id"))


def moments(x: Column) -> tuple[Column, Column]:
    """Sums of values and squares as exact decimals, so that means and deviations don't depend on the order of rows."""
    m = money(x)
    return F.sum(m).cast("double"), F.sum((m * m).cast("decimal(37,4)")).cast("double")


def deviation(n: Column, s: Column, q: Column) -> Column:
    """Sample standard deviation from a count, a sum and a sum of squares; 0 for one value."""
    return F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (q - s * s / n) / (n - 1)))).otherwise(F.lit(0.0))


def behavior_off_hours(txns: DataFrame) -> DataFrame:
    h = F.hour("created_at")
    off = (h < 8) | (h >= 20)
    by_hour = sent(txns).groupBy("customer_id", F.when(off, h).alias("h")).agg(F.count("*").alias("n"))
    rows = by_hour.groupBy("customer_id").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("h").isNotNull(), F.col("n"))), F.lit(0)).alias("off"), F.max(F.when(F.col("h").isNotNull(), F.struct("n", -F.col("h")))).alias("m"))
    return rows.select("customer_id", "n", F.col("off").alias("off_hours"), pct(F.col("off"), F.col("n")).alias("off_hours_pct"), (-F.col("m").getField("col2")).alias("most_active_hour"))


def behavior_amount_anomaly(txns: DataFrame, times: float = 2.5) -> DataFrame:
    """Transactions above mean + ``times`` sample deviations of their sender, who has at least three."""
    rows = sent(txns).filter(F.col("amount").isNotNull())
    s, q = moments(F.col("amount"))
    per = rows.groupBy("customer_id").agg(F.count("*").alias("n"), s.alias("s"), q.alias("q")).filter("n >= 3").select("customer_id", (F.col("s") / F.col("n")).alias("mean"), deviation(F.col("n"), F.col("s"), F.col("q")).alias("std"))
    high = rows.join(per, "customer_id").filter(F.col("amount") > F.col("mean") + F.col("std") * times)
    return high.select(F.col("id").alias("txn_id"), "customer_id", "amount", rounded(F.col("mean")).alias("mean_amount"), F.when(F.col("std") > 0, rounded((F.col("amount") - F.col("mean")) / F.col("std"))).otherwise(0.0).alias("deviation"))


def _change(new: Column, old: Column) -> Column:
    return F.when(old == 0, F.when(new > 0, 100.0).otherwise(0.0)).otherwise(rounded((new - old) / old * 100.0))


def behavior_velocity_spike(txns: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    recent = F.col("created_at") >= ago(as_of, days=days)
    prior = (F.col("created_at") >= ago(as_of, days=2 * days)) & ~recent
    rows = sent(txns).groupBy("customer_id").agg(count_if(recent).alias("recent_n"), count_if(prior).alias("prior_n"), total(F.col("amount"), recent).alias("recent_volume"), total(F.col("amount"), prior).alias("prior_volume"))
    rows = rows.withColumn("count_change", _change(F.col("recent_n"), F.col("prior_n"))).withColumn("volume_change", _change(F.col("recent_volume"), F.col("prior_volume")))
    return rows.withColumn("is_spike", (F.col("count_change") > 200) | (F.col("volume_change") > 200))


def _band_days(txns: DataFrame, low: float, high: Column) -> DataFrame:
    return sent(txns).filter((F.col("amount") >= low) & high).groupBy("customer_id", F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"), total(F.col("amount")).alias("s"))


def behavior_structuring(txns: DataFrame, limit: float = 10000.0) -> DataFrame:
    days = _band_days(txns, limit * 0.7, F.col("amount") <= limit * 0.98).filter((F.col("n") >= 2) & (F.col("s") >= limit))
    rows = days.groupBy("customer_id").agg(F.count("*").alias("days"), total(F.col("s")).alias("amount"))
    return rows.withColumn("structuring_score", rounded(F.least(F.lit(100.0), F.col("days") * 20.0 + F.col("amount") / limit * 5.0)))


def behavior_round_amounts(txns: DataFrame) -> DataFrame:
    """Share of amounts divisible by 1000, and amounts within 1% of a multiple k * 1000 with k from 1 to 999: the nearest
    multiples on both sides decide, held to that range."""
    a = F.col("amount")
    near = F.lit(False)
    for k in (F.floor(a / 1000), F.ceil(a / 1000)):
        k = F.least(F.greatest(k, F.lit(1)), F.lit(999)).cast("double") * 1000.0
        near = near | (F.abs(a - k) / k < 0.01)
    whole = a % 1000 == 0
    rows = sent(txns).filter(a > 0).groupBy("customer_id").agg(F.count("*").alias("n"), count_if(whole).alias("round_n"), count_if(~whole & near).alias("near_round_n"))
    return rows.withColumn("round_pct", pct(F.col("round_n"), F.col("n")))


def behavior_profile(txns: DataFrame) -> DataFrame:
    s, q = moments(F.col("amount"))
    rows = sent(txns).groupBy("customer_id").agg(
        F.count("*").alias("n"), s.alias("s"), q.alias("q"), F.max("amount").alias("max_amount"), F.count_distinct("destination_country").alias("destinations"), F.count_distinct("originating_country").alias("origins"),
        F.array_join(F.array_sort(F.collect_set("transaction_type")), ",").alias("types"), count_if(F.col("flagged")).alias("flagged"), count_if(F.col("is_international")).alias("international"),
    )
    rows = rows.select("customer_id", "n", F.col("s").alias("total_amount"), rounded(F.col("s") / F.col("n")).alias("mean_amount"), rounded(deviation(F.col("n"), F.col("s"), F.col("q"))).alias("std_amount"), "max_amount", "destinations", "origins", "types", "flagged", "international")
    off, st, ro = behavior_off_hours(txns), behavior_structuring(txns), behavior_round_amounts(txns)
    rows = rows.join(off.select("customer_id", "off_hours_pct"), "customer_id", "left").join(st.select("customer_id", "structuring_score"), "customer_id", "left").join(ro.select("customer_id", "round_pct"), "customer_id", "left").na.fill(0.0)
    flags = {"off_hours": F.col("off_hours_pct") > 30, "structuring": F.col("structuring_score") > 50, "round_amounts": F.col("round_pct") > 40, "many_destinations": F.col("destinations") > 5}
    return rows.withColumn("flags", F.concat_ws(",", *(F.when(test, name) for name, test in flags.items())))


def behavior_risk_score(txns: DataFrame, as_of: str) -> DataFrame:
    base = sent(txns).groupBy("customer_id").agg(F.count_distinct("destination_country").alias("countries"))
    out = behavior_amount_anomaly(txns).groupBy("customer_id").agg(F.count("*").alias("outliers"))
    for part in (behavior_off_hours(txns).select("customer_id", "off_hours_pct"), behavior_structuring(txns).select("customer_id", "structuring_score"), behavior_round_amounts(txns).select("customer_id", "round_pct"), behavior_velocity_spike(txns, as_of).select("customer_id", "is_spike", "count_change"), out):
        base = base.join(part, "customer_id", "left")
    base = base.na.fill(0).na.fill(False)
    least = lambda x, most: F.least(F.lit(float(most)), x)
    speed = F.when(F.col("is_spike"), 20.0).otherwise(steps(F.col("count_change"), (100, 12), (50, 7)))
    parts = [least(F.col("off_hours_pct") * 0.5, 15), least(F.col("structuring_score") * 0.25, 25), least(F.col("round_pct") * 0.2, 10), speed, least(F.col("outliers") * 3.0, 15), least(F.col("countries") * 2.0, 15)]
    score = F.least(F.lit(100.0), rounded(parts[0] + parts[1] + parts[2] + parts[3] + parts[4] + parts[5]))
    return base.select("customer_id", score.alias("behavioral_score")).withColumn("risk_band", band(F.col("behavioral_score"), (75, 50, 25)))


def pattern_smurfing(txns: DataFrame, limit: float = 10000.0, days: int = 3) -> DataFrame:
    """Groups: from each day with a candidate, the next ``days`` days hold at least two that sum to the limit."""
    daily = _band_days(txns, limit * 0.70, F.col("amount") < limit * 0.99).withColumn("d", F.datediff("day", F.lit("1970-01-01")))
    ahead = Window.partitionBy("customer_id").orderBy("d").rangeBetween(0, days - 1)
    groups = daily.select("customer_id", F.sum("n").over(ahead).alias("n"), F.sum(money(F.col("s"))).over(ahead).cast("double").alias("s")).filter((F.col("n") >= 2) & (F.col("s") >= limit))
    rows = groups.groupBy("customer_id").agg(F.count("*").alias("groups"), total(F.col("s")).alias("amount"))
    return rows.withColumn("confidence", rounded(F.least(F.lit(100.0), F.col("groups") * 25.0 + F.col("amount") / limit * 5.0)))


def pattern_integration(txns: DataFrame, least: float = 5000.0, days: int = 7) -> DataFrame:
    """Payments or wires with a flagged transaction of the sender in the days before."""
    rows = sent(txns).withColumn("at", F.unix_micros(F.col("created_at").cast("timestamp")))
    event = F.col("transaction_type").isin("payment", "wire") & (F.col("amount") >= least)
    one = F.lit(1).cast("long")
    cells = sliding(rows, "customer_id", "at", {"events": F.when(event, one), "flagged": F.when(F.col("flagged"), one)}, {"before": Span("flagged", -days * DAY, -1, event)})
    per = cells.groupBy("customer_id").agg(F.coalesce(F.sum(F.when(F.col("before") > 0, F.col("events"))), F.lit(0)).alias("events"), F.sum("flagged").alias("flagged"))
    return per.withColumn("confidence", F.least(F.lit(100.0), F.col("events") * 15.0 + F.col("flagged") * 5.0))


def pattern_rapid_clusters(txns: DataFrame, hours: int = 24, limit: float = 10000.0) -> DataFrame:
    """Transactions from which the next hours hold at least three that sum to the limit."""
    rows = sent(txns).withColumn("at", F.unix_micros(F.col("created_at").cast("timestamp")))
    ahead = {name: Span(measure, 0, hours * MICROS) for name, measure in (("n", "own"), ("s", "volume"))}
    cells = sliding(rows, "customer_id", "at", {"own": F.lit(1).cast("long"), "volume": cents(F.col("amount"))}, ahead).withColumn("s", dollars_of(F.col("s")))
    per = cells.filter((F.col("n") >= 3) & (F.col("s") >= limit)).groupBy("customer_id").agg(F.sum("own").alias("clusters"), F.max("s").alias("largest"))
    return per.withColumn("confidence", F.least(F.lit(100.0), F.col("clusters") * 20.0))


def pattern_counterparties(txns: DataFrame) -> DataFrame:
    both = F.array(F.struct(F.col("from_customer_id").alias("customer_id"), F.col("to_customer_id").alias("other")), F.struct(F.col("to_customer_id").alias("customer_id"), F.col("from_customer_id").alias("other")))
    pairs = txns.select(F.inline(both)).filter(F.col("customer_id") != F.col("other")).groupBy("customer_id", "other").agg(F.count("*").alias("n"))
    rows = pairs.groupBy("customer_id").agg(F.count("*").alias("others"), count_if(F.col("n") == 1).alias("one_time"))
    flags = F.concat_ws(",", F.when(F.col("others") > 10, "high_diversity"), F.when((F.col("one_time") > F.col("others") * 0.8) & (F.col("others") >= 5), "mostly_one_time"))
    return rows.withColumn("anomalies", flags).withColumn("confidence", F.least(F.lit(100.0), F.col("others") * 5.0 + F.col("one_time") * 3.0))


def pattern_scores(txns: DataFrame, layering: DataFrame) -> DataFrame:
    """Confidence of each pattern per sender and their weighted mean; ``layering`` has customer_id and confidence."""
    parts = {"smurfing": (pattern_smurfing(txns), 0.25), "layering": (layering, 0.25), "integration": (pattern_integration(txns), 0.20), "rapid_movement": (pattern_rapid_clusters(txns), 0.15), "counterparties": (pattern_counterparties(txns), 0.15)}
    rows = sent(txns).select("customer_id").distinct()
    for name, (frame, _) in parts.items():
        rows = rows.join(frame.select("customer_id", F.col("confidence").alias(name)), "customer_id", "left")
    rows = rows.na.fill(0.0)
    whole = F.lit(0.0)
    for name, (_, weight) in parts.items():
        whole = whole + F.col(name) * weight
    return rows.withColumn("composite", rounded(F.least(F.lit(100.0), whole)))
