"""Detection rules over whole transaction tables.

All rules share one pass. Each transaction is a leg of its sender and a leg of its receiver; every count and sum over the
hours before a leg is a difference of running sums over all legs in the order of customer and time, which are sorted into
ranges, so a customer of any size is spread over many tasks. Every transaction carries an array of its matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ledgerlark.functions.columns import cents, dollars_of, padded, rounded
from ledgerlark.functions.order import running
from ledgerlark.functions.sliding import Span, sliding

# Countries that the rules hold to be of high risk.
HIGH_RISK_COUNTRIES = ["IR", "KP", "SY", "CU", "SD", "RU", "BY", "MM", "AF", "IQ", "LY", "SO", "YE", "VE", "ZW"]

INCOMING, OUTGOING = ["deposit", "transfer", "wire"], ["withdrawal", "transfer", "wire"]
MICROS = 3_600_000_000
#: Hours that a rule looks back where its row doesn't say.
WINDOW_HOURS = {"structuring": 72, "frequency": 24, "velocity": 24, "rapid_movement": 24, "round_amount": 48, "micro_transaction": 1}

MATCH = "struct<rule_id:int,rule_name:string,category:string,severity:string,reason:string,risk_score:double,details:string>"


def window_hours(rule: Row) -> int:
    return rule.time_window_hours or WINDOW_HOURS.get(rule.category, 0)


def dollars(x: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(x, 2))


def capped(score: Column, most: float) -> Column:
    return rounded(F.least(F.lit(most), score), 2)


class Frames:
    """What the rules ask about the hours up to a leg (equal times included) of the same customer."""

    def __init__(self):
        self.measures: dict[str, Column] = {}
        self.spans: dict[str, Span] = {}
        self.firsts: dict[str, str] = {}
        self.receivers = False

    def sum(self, measure: str, value: Column, hours: float, wanted: Column | None = None, role: str = "S") -> Column:
        """The sum of ``value`` over legs in one role, for senders' legs that ``wanted`` holds for."""
        self.receivers |= role == "R"
        self.measures[measure] = F.when(F.col("role") == role, value)
        sender = F.col("role") == "S"
        name = f"{measure}_{hours}h"
        self.spans[name] = Span(measure, -int(hours * MICROS), 0, sender if wanted is None else sender & wanted)
        return F.col(name)

    def count(self, measure: str, test: Column, hours: float, wanted: Column | None = None) -> Column:
        return self.sum(measure, F.when(test, F.lit(1).cast("long")), hours, wanted)

    def first(self, measure: str, hours: float) -> Column:
        """The time of the first leg that a count over the same hours counts."""
        self.firsts[f"first_{measure}_{hours}h"] = f"{measure}_{hours}h"
        return F.col(f"first_{measure}_{hours}h")


def _large(rule: Row, w: Frames) -> tuple[Column, Column, Column, Column]:
    limit = rule.threshold_amount or 10000.0
    a = F.col("amount")
    reason = F.concat(F.lit("Transaction amount "), dollars(a), F.lit(" exceeds large transaction threshold of "), dollars(F.lit(limit)))
    return a >= limit, capped(50 + (a - limit) / limit * 30, 100.0), reason, F.struct("amount", F.lit(limit).alias("threshold"), "currency")


def _structuring(rule: Row, w: Frames) -> tuple[Column, Column, Column, Column]:
    limit, hours = rule.threshold_amount or 10000.0, window_hours(rule)
    a = F.col("amount")
    band = a.between(limit * 0.80, limit * 0.999)
    n = w.count(f"band_{rule.rule_id}", band, hours, band) - 1
    reason = F.concat(F.lit("Potential structuring: amount "), dollars(a), F.lit(" is just below reporting threshold. "), n.cast("string"), F.lit(f" similar transactions in the past {hours}h."))
    return band, capped(55 + n * 8.0, 95.0), reason, F.struct("amount", F.lit(limit).alias("threshold"), n.alias("similar_transactions_in_window"), F.lit(hours).alias("window_hours"))


def _frequency(rule: Row, w: Frames) -> tuple[Column, Column, Column, Column]:
    hours, most = window_hours(rule), rule.threshold_count or 5
    n = w.count("sent", F.lit(True), hours)
    reason = F.concat(F.lit("High transaction frequency: "), n.cast("string"), F.lit(f" transactions in the past {hours} hours (threshold: {most})"))
    return n >= most, capped(50 + (n - most) * 5.0, 90.0), reason, F.struct(n.alias("transaction_count"), F.lit(most).alias("count_threshold"), F.lit(hours).alias("window_hours"))


def _velocity(rule: Row, w: Frames) -> tuple[Column, Column, Column, Column]:
    hours, limit = window_hours(rule), rule.threshold_amount or 25000.0
    s = dollars_of(w.sum("volume", cents(F.col("amount")), hours))
    reason = F.concat(F.lit("High velocity: cumulative amount "), dollars(s), F.lit(f" in {hours}h exceeds threshold of "), dollars(F.lit(limit)))
    return s >= limit, capped(55 + (s - limit) / limit * 25, 92.0), reason, F.struct(rounded(s).alias("total_volume_in_window"), F.lit(limit).alias("amount_threshold"), F.lit(hours).alias("window_hours"))


def _country(rule: Row, w: Frames) -> tuple[Column, Column, Column, Column]:
    more = F.coalesce(F.from_json(F.lit(rule.high_risk_countries).cast("string"), "array<string>"), F.array().cast("array<string>"))
    risky = F.array_union(F.array(*map(F.lit, HIGH_RISK_COUNTRIES)), more)
    roles = (("originating", "originating_country"), ("destination", "destination_country"), ("customer_country", "customer_country"))
    hits = F.array_compact(F.array(*(F.when(F.array_contains(risky, F.upper(c)), F.struct(F.lit(role).alias("role"), F.col(c).alias("code"))) for role, c in roles)))
    listed = F.concat_ws(", ", F.transform(hits, lambda h: F.concat(h["role"], F.lit("="), h["code"])))
    return F.size(hits) > 0, capped(65 + F.size(hits) * 10.0, 95.0), F.concat(F.lit("Transaction involves high-risk country: "), listed), F.struct(hits.alias("hit_countries"), "amount")


def _rapid(rule: Row, w: Frames) -> tuple[Column, Column, Column, Column]:
    hours, least = window_hours(rule), rule.threshold_amount or 5000.0
    kind = F.col("transaction_type")
    got = dollars_of(w.sum("in", F.when(kind.isin(INCOMING), cents(F.col("amount"))), hours, role="R"))
    sent = dollars_of(w.sum("out", F.when(kind.isin(OUTGOING), cents(F.col("amount"))), hours))
    ratio = sent / got
    reason = F.concat(F.lit("Rapid fund movement: received "), dollars(got), F.lit(" and sent "), dollars(sent), F.lit(f" within {hours}h (turnover ratio: "), F.format_number(ratio * 100, 0), F.lit("%)"))
    details = F.struct(rounded(got).alias("incoming_total"), rounded(sent).alias("outgoing_total"), rounded(ratio, 3).alias("turnover_ratio"), F.lit(hours).alias("window_hours"))
    return (got >= least) & (sent >= least * 0.7), capped(60 + ratio * 20, 90.0), reason, details


def _round(rule: Row, w: Frames) -> tuple[Column, Column, Column, Column]:
    limit, hours = rule.threshold_amount or 1000.0, window_hours(rule)
    a = F.col("amount")
    whole = ((a % 1000 == 0) | ((a % 500 == 0) & (a >= 5000))) & (a - F.floor(a) < 0.01)
    n = w.count(f"from_{rule.rule_id}", a >= limit, hours, (a >= limit) & whole) - 1
    reason = F.concat(F.lit("Suspicious round-number transaction: "), dollars(a), F.lit(". "), n.cast("string"), F.lit(f" similar round amounts in past {hours}h."))
    score = 45 + n * 5.0 + F.when(a >= 10000, 15.0).otherwise(0.0)
    return (a >= limit) & whole & ((n >= 1) | (a >= 10000)), capped(score, 85.0), reason, F.struct("amount", n.alias("round_transactions_in_window"))


def _pep(rule: Row, w: Frames) -> tuple[Column, Column, Column, Column]:
    a = F.col("amount")
    reason = F.concat(F.lit("Transaction of "), dollars(a), F.lit(" involves a Politically Exposed Person (PEP): "), F.col("customer_name"))
    details = F.struct("customer_name", F.lit(True).alias("pep_status"), "amount")
    return F.col("customer_pep") & (a >= (rule.threshold_amount or 0.0)), capped(70 + a / 10000 * 5, 95.0), reason, details


def _micro(rule: Row, w: Frames) -> tuple[Column, Column, Column, Column]:
    most, least, hours = rule.threshold_amount or 100.0, rule.threshold_count or 4, window_hours(rule)
    small = F.col("amount") <= most
    n = w.count(f"small_{rule.rule_id}", small, hours, small)
    first = w.first(f"small_{rule.rule_id}", hours)
    # The mean gap of ordered times is their span over the number of gaps; the leg itself is the latest.
    gap = F.when(n >= 2, (F.col("at") - first) / 6e7 / (n - 1)).otherwise(F.lit(0.0))
    reason = F.concat(
        F.lit("Micro-transaction pattern detected: "), n.cast("string"), F.lit(" transactions of ≤"), dollars(F.lit(most)), F.lit(f" in {hours}h with an average interval of "),
        F.format_number(gap, 1), F.lit(" min. Possible automated account testing or micro-layering."),
    )
    details = F.struct(n.alias("micro_transaction_count"), F.lit(most).alias("max_micro_amount"), rounded(gap).alias("avg_interval_minutes"), F.lit(hours).alias("window_hours"), F.col("amount").alias("current_amount"))
    return (F.col("amount") <= most) & (n >= least) & (gap <= 30), capped(50 + n * 5.0 + F.greatest(F.lit(0.0), 30 - gap) * 0.5, 88.0), reason, details


RULES: dict[str, Callable] = {
    "large_transaction": _large, "structuring": _structuring, "frequency": _frequency, "velocity": _velocity, "high_risk_country": _country,
    "rapid_movement": _rapid, "round_amount": _round, "pep_transaction": _pep, "micro_transaction": _micro,
}


def legs(txns: DataFrame, receivers: bool = True) -> DataFrame:
    """``who, role`` and ``at`` (microseconds) of each transaction's sender, and of its receiver where it has one."""
    sides = [F.struct(F.col("from_customer_id").alias("who"), F.lit("S").alias("role"))]
    if receivers:
        sides.append(F.struct(F.col("to_customer_id").alias("who"), F.lit("R").alias("role")))
    return txns.select("*", F.inline(F.array(*sides))).filter((F.col("role") == "S") | F.col("who").isNotNull())


def active_rules(rules: DataFrame) -> list[Row]:
    return [r for r in rules.filter("is_active").orderBy("rule_id").collect() if r.category in RULES]


def evaluate_rules(txns: DataFrame, customers: DataFrame, rules: DataFrame) -> DataFrame:
    """``txn_id, customer_id, created_at`` and the columns of a match, one row per active rule and transaction it fires on.

    The time of a transaction is the end of its windows. Missing thresholds (null or 0) take each rule's default. The
    rules table is configuration of a few rows and is read by the driver to build the expressions."""
    active = active_rules(rules)
    w = Frames()
    made = [(r, *RULES[r.category](r, w)) for r in active]
    known = customers.select(F.col("customer_id").alias("_id"), F.col("country").alias("customer_country"), F.col("pep_status").alias("customer_pep"), F.col("full_name").alias("customer_name"))
    slim = txns.select("id", "from_customer_id", "to_customer_id", "amount", "currency", "transaction_type", "originating_country", "destination_country", "created_at")
    rows = slim.withColumn("at", F.unix_micros(F.col("created_at").cast("timestamp")))
    if w.spans:
        spans = sliding(legs(rows, w.receivers), "who", "at", w.measures, w.spans, w.firsts).select("who", F.col("at").alias("_at"), *w.spans, *w.firsts)
        rows = rows.join(spans, F.col("from_customer_id").eqNullSafe(F.col("who")) & (F.col("at") == F.col("_at")), "left")
    rows = rows.join(known, rows["from_customer_id"] == known["_id"], "left")
    found = [
        F.when(test, F.struct(
            F.lit(r.rule_id).alias("rule_id"), F.lit(r.name).alias("rule_name"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"),
            reason.alias("reason"), score.alias("risk_score"), F.to_json(details).alias("details"),
        ))
        for r, test, score, reason, details in made
    ]
    matches = F.array_compact(F.array(*found)) if found else F.array().cast(f"array<{MATCH}>")
    return rows.select(F.col("id").alias("txn_id"), F.col("from_customer_id").alias("customer_id"), F.col("created_at").cast("timestamp").alias("created_at"), F.inline(matches))


def one_rule(category: str, txns: DataFrame, customers: DataFrame, rules: DataFrame) -> DataFrame:
    return evaluate_rules(txns, customers, rules.filter(F.col("category") == category))


def generate_alerts(matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alerts, rejected matches). An alert needs a customer. Numbers count per day in the order of time, transaction and
    rule: running counts over sorted ranges, so a day of any size is numbered by many tasks."""
    alerts = matches.filter(F.col("customer_id").isNotNull()).withColumn("day", F.to_date("created_at")).withColumn("_one", F.lit(1).cast("long"))
    placed = running(alerts, [F.col("created_at"), F.col("txn_id"), F.col("rule_id")], _k="_one")
    first = placed.groupBy("day").agg(F.min("_k").alias("_first"))
    numbered = placed.join(first, "day").withColumn("k", F.col("_k") - F.col("_first") + 1)
    made = numbered.select(
        F.concat(F.lit("ALT-"), F.date_format("day", "yyyyMMdd"), F.lit("-"), padded(F.col("k"), 5)).alias("alert_number"),
        F.col("txn_id").alias("transaction_id"), "customer_id", "rule_id", "severity", F.lit("open").alias("status"), "reason", "details", "risk_score", "created_at",
    )
    return made, matches.filter(F.col("customer_id").isNull())


def flag_transactions(txns: DataFrame, matches: DataFrame) -> DataFrame:
    """Transactions with ``flagged`` and ``risk_score`` set from their highest match; others stay as they are."""
    best = matches.groupBy(F.col("txn_id").alias("id")).agg(F.max("risk_score").alias("_score"))
    return txns.join(best, "id", "left").withColumn("flagged", F.col("flagged") | F.col("_score").isNotNull()).withColumn("risk_score", F.coalesce("_score", "risk_score")).drop("_score")
