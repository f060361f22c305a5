"""Listing, export, validation and retention queries over the AML views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.functions.storage import fresh_path
from ledgerlark.operators import listing as L
from ledgerlark.plans.sql import AT, NOW, padded
from ledgerlark.sources.exports import read_export, write_export

_TXN = "id, from_customer_id, to_customer_id, amount, transaction_type, flagged, created_at"
_COLS = [c.strip() for c in _TXN.split(",")]
_RAW = "SELECT t.id, t.amount, t.created_at, t.originating_country, t.destination_country, t.from_customer_id AS from_account_id, t.to_customer_id AS to_account_id FROM aml_txn t"


def _raw(t):
    return t.aml_txn.select("id", "amount", "created_at", "originating_country", "destination_country", F.col("from_customer_id").alias("from_account_id"), F.col("to_customer_id").alias("to_account_id"))


PLANS = {
    "filter_transactions": (
        lambda t: L.page(L.filter_transactions(t.aml_txn, customer_id=1, min_amount=50.0, max_amount=20000.0, date_from="2023-12-20", date_to=AT), "id", 50, 5).select(*_COLS),
        f"SELECT {_TXN} FROM aml_txn WHERE (from_customer_id = 1 OR to_customer_id = 1) AND amount BETWEEN 50 AND 20000 AND created_at >= TIMESTAMP '2023-12-20 00:00:00' AND created_at <= {NOW} ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 5",
    ),
    "filter_transactions_all": (
        lambda t: L.filter_transactions(t.aml_txn, transaction_type="wire", flagged=True, originating_country="IR").select(*_COLS),
        f"SELECT {_TXN} FROM aml_txn WHERE transaction_type = 'wire' AND flagged AND originating_country = 'IR'",
    ),
    "filter_alerts": (
        lambda t: L.page(L.filter_alerts(t.aml_alert, severity="high", status="open"), "alert_id", 100).select("alert_id", "customer_id", "severity", "status", "created_at"),
        "SELECT alert_id, customer_id, severity, status, created_at FROM aml_alert WHERE severity = 'high' AND status = 'open' ORDER BY created_at DESC, alert_id DESC LIMIT 100",
    ),
    "filter_cases": (
        lambda t: L.page(L.filter_cases(t.aml_case, status="open", priority="low"), "case_id", 100).select("case_id", "status", "priority", "created_at"),
        "SELECT case_id, status, priority, created_at FROM aml_case WHERE status = 'open' AND priority = 'low' ORDER BY created_at DESC, case_id DESC LIMIT 100",
    ),
    "search_customers": (
        lambda t: L.search_customers(t.aml_customer, text="U1", risk_level="low").select("customer_id", "full_name", "email"),
        "SELECT customer_id, full_name, email FROM aml_customer WHERE risk_level = 'low' AND (full_name ILIKE '%U1%' OR customer_number ILIKE '%U1%' OR email ILIKE '%U1%')",
    ),
    "search_sanctions_entries": (
        lambda t: L.search_sanctions_entries(t.aml_sanctions_entry, text="an", entity_type="ent", program="dprk").select("entry_id", "primary_name"),
        "SELECT entry_id, primary_name FROM aml_sanctions_entry WHERE primary_name ILIKE '%an%' AND entity_type ILIKE '%ent%' AND programs ILIKE '%dprk%'",
    ),
    "filter_audit_logs": (
        lambda t: L.filter_audit_logs(t.aml_audit, action="UPDATE_ALERT", entity_type="alert").select("audit_id", "user_id", "created_at"),
        "SELECT audit_id, user_id, created_at FROM aml_audit WHERE action = 'UPDATE_ALERT' AND entity_type = 'alert'",
    ),
    "audit_actions": (lambda t: L.audit_actions(t.aml_audit), "SELECT DISTINCT action FROM aml_audit"),
    "export_transactions": (
        lambda t: L.export_transactions(t.aml_txn, t.aml_customer, AT, days=45, min_amount=100.0, flagged_only=True),
        f"""SELECT t.id, coalesce(reference, '') AS reference, coalesce(f.full_name, '') AS from_name, coalesce(g.full_name, '') AS to_name, currency, transaction_type, coalesce(originating_country, '') AS originating_country,
        coalesce(destination_country, '') AS destination_country, channel, amount, CASE WHEN is_international THEN 'yes' ELSE 'no' END AS is_international, 'yes' AS flagged, risk_score, t.created_at
        FROM aml_txn t LEFT JOIN aml_customer f ON f.customer_id = from_customer_id LEFT JOIN aml_customer g ON g.customer_id = to_customer_id WHERE t.created_at >= {NOW} - INTERVAL 45 DAY AND amount >= 100 AND flagged""",
    ),
    "export_alerts": (
        lambda t: L.export_alerts(t.aml_alert, t.aml_customer, t.aml_rule, AT, days=60),
        f"""SELECT alert_id, alert_number, coalesce(full_name, 'Customer ' || a.customer_id) AS customer_name, coalesce(risk_level, 'unknown') AS customer_risk_level, coalesce(r.name, 'N/A') AS rule_name, a.severity, a.status, reason, risk_score, a.created_at
        FROM aml_alert a LEFT JOIN aml_customer c ON c.customer_id = a.customer_id LEFT JOIN aml_rule r ON r.rule_id = a.rule_id WHERE a.created_at >= {NOW} - INTERVAL 60 DAY""",
    ),
    "export_customers": (
        lambda t: L.export_customers(t.aml_customer, pep_only=True),
        f"""SELECT customer_id, customer_number, {', '.join(f"coalesce({c}, '') AS {c}" for c in ("full_name", "email", "nationality", "country", "risk_level", "occupation", "id_type", "id_number", "address"))},
        'yes' AS pep_status, CASE WHEN sanctions_flag THEN 'yes' ELSE 'no' END AS sanctions_flag, coalesce(CAST(date_of_birth AS VARCHAR), '') AS date_of_birth, annual_income, created_at FROM aml_customer WHERE pep_status""",
    ),
    "enrich_transactions": (
        lambda t: L.enrich_transactions(_raw(t), t.aml_account)[0].select("id", "reference", "from_customer_id", "to_customer_id", "is_international"),
        f"""SELECT r.id, 'TXN-' || strftime(r.created_at, '%Y%m%d') || '-' || {padded('row_number() OVER (PARTITION BY CAST(r.created_at AS DATE) ORDER BY r.created_at, r.id)', 6)} AS reference,
        a.customer_id AS from_customer_id, b.customer_id AS to_customer_id, coalesce(originating_country <> destination_country, false) AS is_international
        FROM ({_RAW}) r JOIN aml_account a ON a.account_id = from_account_id LEFT JOIN aml_account b ON b.account_id = to_account_id""",
    ),
    "enrich_rejects": (
        lambda t: L.enrich_transactions(_raw(t), t.aml_account)[1].select("id", "from_account_id"),
        f"SELECT id, from_account_id FROM ({_RAW}) r WHERE from_account_id NOT IN (SELECT account_id FROM aml_account)",
    ),
    "validate_transactions": (
        lambda t: L.validate_transactions(t.aml_txn.withColumn("amount", F.col("amount") - 50).withColumn("destination_country", F.when(F.col("id") % 5 == 0, "usa").otherwise(F.col("destination_country")))).select("id", "reasons", "valid"),
        """SELECT id, reasons, reasons = '' AS valid FROM (SELECT id, concat_ws(';', CASE WHEN NOT (amount - 50 BETWEEN 0.01 AND 1E8) THEN 'amount' END,
        CASE WHEN transaction_type NOT IN ('deposit', 'withdrawal', 'transfer', 'wire', 'payment', 'cash') THEN 'transaction_type' END, CASE WHEN id % 5 = 0 THEN 'destination_country' END) AS reasons FROM aml_txn) x""",
    ),
    "validate_customers": (
        lambda t: L.validate_customers(t.aml_customer.withColumn("email", F.when(F.col("customer_id") % 3 == 0, "nobody").otherwise(F.col("email")))).select("customer_id", "reasons", "valid"),
        "SELECT customer_id, CASE WHEN customer_id % 3 = 0 THEN 'email' ELSE '' END AS reasons, customer_id % 3 <> 0 AS valid FROM aml_customer",
    ),
    "retention_cleanup": (
        lambda t: L.retention_cleanup(t.aml_audit, t.aml_case, t.aml_case_note, t.aml_alert, AT, 15)[1],
        f"""WITH k AS (SELECT {NOW} - INTERVAL 15 DAY AS cut), c AS (SELECT case_id FROM aml_case, k WHERE status = 'closed' AND closed_at < cut)
        SELECT 'audit' AS "table", count(*) AS n FROM aml_audit, k WHERE created_at < cut UNION ALL SELECT 'cases', count(*) FROM c
        UNION ALL SELECT 'alerts', count(*) FROM aml_alert, k WHERE status IN ('closed', 'false_positive') AND closed_at < cut UNION ALL SELECT 'notes', count(*) FROM aml_case_note WHERE case_id IN (SELECT case_id FROM c)""",
    ),
}

# The same rows, written as files and read back.


def _written(name: str, order: str, fmt: str):
    def run(t):
        df = PLANS[name][0](t)
        path = fresh_path(df.sparkSession, name)
        write_export(df, path, [order], fmt)
        return read_export(df.sparkSession, path)

    return run


PLANS |= {f"{name}_{fmt}": (_written(name, order, fmt), PLANS[name][1]) for name, order, fmt in (("export_transactions", "id", "csv"), ("export_alerts", "alert_id", "json"))}
