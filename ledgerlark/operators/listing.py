"""Listings, exports, validation, enrichment and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.columns import ago, padded
from ledgerlark.functions.order import running

TYPES = ["deposit", "withdrawal", "transfer", "wire", "payment", "cash"]
LEVELS = ["low", "medium", "high", "critical"]
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"


def page(df: DataFrame, key: str, limit: int | None, offset: int = 0, newest: str = "created_at") -> DataFrame:
    ordered = df.orderBy(F.desc(newest), F.desc(key)) if newest in df.columns else df.orderBy(key)
    if offset:
        ordered = ordered.offset(offset)
    return ordered if limit is None else ordered.limit(limit)


def _equal(df: DataFrame, **wanted) -> DataFrame:
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def filter_transactions(txns: DataFrame, customer_id: int | None = None, transaction_type: str | None = None, status: str | None = None, flagged: bool | None = None, min_amount: float | None = None, max_amount: float | None = None, date_from: str | None = None, date_to: str | None = None, originating_country: str | None = None) -> DataFrame:
    rows = _equal(txns, transaction_type=transaction_type, status=status, flagged=flagged, originating_country=originating_country)
    if customer_id is not None:
        rows = rows.filter((F.col("from_customer_id") == customer_id) | (F.col("to_customer_id") == customer_id))
    for column, value, test in (("amount", min_amount, "ge"), ("amount", max_amount, "le"), ("created_at", date_from, "ge"), ("created_at", date_to, "le")):
        if value is not None:
            bound = F.lit(value).cast("timestamp") if column == "created_at" else F.lit(value)
            rows = rows.filter(F.col(column) >= bound if test == "ge" else F.col(column) <= bound)
    return rows


def filter_alerts(alerts: DataFrame, customer_id: int | None = None, severity: str | None = None, status: str | None = None) -> DataFrame:
    return _equal(alerts, customer_id=customer_id, severity=severity, status=status)


def filter_cases(cases: DataFrame, status: str | None = None, priority: str | None = None, assigned_to: str | None = None) -> DataFrame:
    return _equal(cases, status=status, priority=priority, assigned_to=assigned_to)


def _like(text: str) -> str:
    return "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"


def search_customers(customers: DataFrame, text: str | None = None, risk_level: str | None = None, pep_status: bool | None = None, sanctions_flag: bool | None = None) -> DataFrame:
    rows = _equal(customers, risk_level=risk_level, pep_status=pep_status, sanctions_flag=sanctions_flag)
    if text:
        found = F.lit(False)
        for c in ("full_name", "customer_number", "email"):
            found = found | F.coalesce(F.col(c).ilike(_like(text)), F.lit(False))
        rows = rows.filter(found)
    return rows


def search_sanctions_entries(entries: DataFrame, text: str | None = None, entity_type: str | None = None, program: str | None = None) -> DataFrame:
    for column, value in (("primary_name", text), ("entity_type", entity_type), ("programs", program)):
        if value:
            entries = entries.filter(F.col(column).ilike(_like(value)))
    return entries


def filter_audit_logs(logs: DataFrame, action: str | None = None, entity_type: str | None = None, user_id: int | None = None) -> DataFrame:
    return _equal(logs, action=action, entity_type=entity_type, user_id=user_id)


def audit_actions(logs: DataFrame) -> DataFrame:
    return logs.select("action").distinct()


def _yes(c: str) -> Column:
    return F.when(F.col(c), "yes").otherwise("no").alias(c)


def export_transactions(txns: DataFrame, customers: DataFrame, as_of: str, days: int | None = None, min_amount: float | None = None, flagged_only: bool = False) -> DataFrame:
    rows = txns if days is None else txns.filter(F.col("created_at") >= ago(as_of, days=days))
    rows = rows if min_amount is None else rows.filter(F.col("amount") >= min_amount)
    rows = rows.filter("flagged") if flagged_only else rows
    for side in ("from", "to"):
        rows = rows.join(customers.select(F.col("customer_id").alias(f"{side}_customer_id"), F.col("full_name").alias(f"{side}_name")), f"{side}_customer_id", "left")
    texts = ["reference", "from_name", "to_name", "currency", "transaction_type", "originating_country", "destination_country", "channel"]
    return rows.select("id", *(F.coalesce(c, F.lit("")).alias(c) for c in texts), "amount", _yes("is_international"), _yes("flagged"), "risk_score", "created_at")


def export_alerts(alerts: DataFrame, customers: DataFrame, rules: DataFrame, as_of: str, status: str | None = None, severity: str | None = None, days: int | None = None) -> DataFrame:
    rows = _equal(alerts, status=status, severity=severity)
    rows = rows if days is None else rows.filter(F.col("created_at") >= ago(as_of, days=days))
    rows = rows.join(customers.select("customer_id", "full_name", "risk_level"), "customer_id", "left").join(rules.select("rule_id", F.col("name").alias("rule_name")), "rule_id", "left")
    name = F.coalesce("full_name", F.concat(F.lit("Customer "), F.col("customer_id").cast("string")))
    return rows.select("alert_id", "alert_number", name.alias("customer_name"), F.coalesce("risk_level", F.lit("unknown")).alias("customer_risk_level"), F.coalesce("rule_name", F.lit("N/A")).alias("rule_name"), "severity", "status", "reason", "risk_score", "created_at")


def export_customers(customers: DataFrame, risk_level: str | None = None, pep_only: bool = False, sanctioned_only: bool = False) -> DataFrame:
    rows = _equal(customers, risk_level=risk_level)
    rows = rows.filter("pep_status") if pep_only else rows
    rows = rows.filter("sanctions_flag") if sanctioned_only else rows
    texts = ["full_name", "email", "nationality", "country", "risk_level", "occupation", "id_type", "id_number", "address"]
    return rows.select("customer_id", "customer_number", *(F.coalesce(c, F.lit("")).alias(c) for c in texts), _yes("pep_status"), _yes("sanctions_flag"), F.coalesce(F.col("date_of_birth").cast("string"), F.lit("")).alias("date_of_birth"), "annual_income", "created_at")


def enrich_transactions(raw: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(landed, rejected): sender and receiver from their accounts, whether international, and a reference that counts
    the day's rows in the order of time and id. An unknown sending account is rejected. Rows are numbered by running
    counts over sorted ranges, so a day, or one booked at a single time, is numbered by many tasks."""
    sender = accounts.select(F.col("account_id").alias("from_account_id"), F.col("customer_id").alias("from_customer_id"))
    receiver = accounts.select(F.col("account_id").alias("to_account_id"), F.col("customer_id").alias("to_customer_id"))
    rows = raw.join(sender, "from_account_id", "left").join(receiver, "to_account_id", "left")
    a, b = F.col("originating_country"), F.col("destination_country")
    good = rows.filter(F.col("from_customer_id").isNotNull()).withColumn("is_international", F.coalesce(a != b, F.lit(False)))
    placed = running(good.withColumn("_day", F.to_date("created_at")).withColumn("_one", F.lit(1).cast("long")), [F.col("created_at"), F.col("id")], _k="_one")
    first = placed.groupBy(F.col("_day").alias("_of")).agg(F.min("_k").alias("_first"))
    numbered = placed.join(first, F.col("_day") == F.col("_of"))
    reference = F.concat(F.lit("TXN-"), F.date_format("_day", "yyyyMMdd"), F.lit("-"), padded(F.col("_k") - F.col("_first") + 1, 6))
    return numbered.withColumn("reference", reference).drop("_day", "_of", "_one", "_k", "_first"), rows.filter(F.col("from_customer_id").isNull())


def sanitize(c: Column, most: int = 500) -> Column:
    """Trimmed, tags stripped, blanks as single spaces, at most so many characters."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", ""), r"\s+", " ")), 1, most)


def reasons(tests: dict[str, Column]) -> Column:
    return F.concat_ws(";", *(F.when(F.coalesce(bad, F.lit(True)), name) for name, bad in tests.items()))


def validate_transactions(txns: DataFrame) -> DataFrame:
    """Each row with ``reasons`` (empty if valid) and ``valid``; a null in a checked column fails it."""
    code = lambda c: F.when(F.col(c).isNull(), False).otherwise(~F.col(c).rlike("^[A-Z]{2}$"))
    why = reasons({"amount": ~F.col("amount").between(0.01, 1e8), "transaction_type": ~F.col("transaction_type").isin(TYPES), "originating_country": code("originating_country"), "destination_country": code("destination_country")})
    return txns.withColumn("reasons", why).withColumn("valid", F.col("reasons") == "")


def validate_customers(customers: DataFrame) -> DataFrame:
    name = F.trim("full_name")
    email = F.when(F.col("email").isNull(), False).otherwise((F.length("email") > 254) | ~F.col("email").rlike(EMAIL))
    country = F.when(F.col("country").isNull(), False).otherwise(~F.col("country").rlike("^[A-Z]{2}$"))
    why = reasons({"full_name": ~(F.length(name).between(2, 200) & name.rlike("[A-Za-z]")), "email": email, "country": country, "risk_level": ~F.col("risk_level").isin(LEVELS)})
    return customers.withColumn("reasons", why).withColumn("valid", F.col("reasons") == "").withColumn("address", sanitize(F.col("address")))


def retention_cleanup(audit: DataFrame, cases: DataFrame, notes: DataFrame, alerts: DataFrame, as_of: str, days: int = 90) -> tuple[dict[str, DataFrame], DataFrame]:
    """(kept tables, counts of what goes): old audit rows, cases closed before the cut with their notes, and alerts that
    were closed before it."""
    cut = ago(as_of, days=days)
    old = {
        "audit": (audit, F.col("created_at") < cut), "cases": (cases, (F.col("status") == "closed") & (F.col("closed_at") < cut)),
        "alerts": (alerts, F.col("status").isin("closed", "false_positive") & (F.col("closed_at") < cut)),
    }
    kept = {k: df.filter(~F.coalesce(test, F.lit(False))) for k, (df, test) in old.items()}
    gone_cases = cases.filter(old["cases"][1]).select("case_id")
    kept["notes"] = notes.join(gone_cases, "case_id", "left_anti")
    counts = [df.filter(test).agg(F.lit(k).alias("table"), F.count("*").alias("n")) for k, (df, test) in old.items()]
    counts.append(notes.join(gone_cases, "case_id", "left_semi").agg(F.lit("notes").alias("table"), F.count("*").alias("n")))
    return kept, counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


def export_report_bundle(frames: dict[str, DataFrame], path: str, as_of: str, fmt: str = "parquet") -> DataFrame:
    """Writes each frame under ``path`` and a manifest of names, counts and the reporting time; returns the manifest."""
    spark = next(iter(frames.values())).sparkSession
    rows = []
    for name, frame in frames.items():
        frame.write.mode("overwrite").format(fmt).save(f"{path}/{name}")
        rows.append((name, spark.read.format(fmt).schema(frame.schema).load(f"{path}/{name}").count(), as_of))
    manifest = spark.createDataFrame(rows, "name string, n long, as_of string")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest
