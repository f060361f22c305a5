"""Rule queries over the AML views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.operators import rules as R
from ledgerlark.plans.sql import padded

COLUMNS = ("txn_id", "customer_id", "rule_id", "rule_name", "category", "severity", "reason", "risk_score")


def _one(category: str):
    return lambda t: R.one_rule(category, t.aml_txn, t.aml_customer, t.aml_rule).select(*COLUMNS)


def _all(t):
    return R.evaluate_rules(t.aml_txn, t.aml_customer, t.aml_rule)


def _r(x: str) -> str:
    return f"floor(({x}) * 100E0 + 0.5E0) / 100E0"


def _usd(x: str) -> str:
    return f"'$' || format('{{:,.2f}}', CAST({x} AS DOUBLE))"


def _over(hours: int) -> str:
    return f"OVER (PARTITION BY from_customer_id ORDER BY created_at RANGE BETWEEN INTERVAL {hours} HOUR PRECEDING AND CURRENT ROW)"


def _rows(category: str, source: str, where: str, reason: str, score: str) -> str:
    return f"""SELECT s.id AS txn_id, s.from_customer_id AS customer_id, CAST(r.rule_id AS INTEGER) AS rule_id, r.name AS rule_name, r.category AS category, r.severity AS severity,
  {reason} AS reason, {_r(score)} AS risk_score
FROM ({source}) s JOIN aml_rule r ON r.category = '{category}' WHERE {where}"""


_RISKY = ", ".join(f"'{c}'" for c in R.HIGH_RISK_COUNTRIES)
_SQL = {
    "large_transaction": _rows("large_transaction", "SELECT * FROM aml_txn", "amount >= 10000",
        f"'Transaction amount ' || {_usd('amount')} || ' exceeds large transaction threshold of $10,000.00'", "least(100E0, 50E0 + (amount - 10000E0) / 10000E0 * 30E0)"),
    "structuring": _rows("structuring", f"SELECT *, count(*) {_over(72)} - 1 AS n FROM aml_txn WHERE amount BETWEEN 8000E0 AND 9990E0", "true",
        f"'Potential structuring: amount ' || {_usd('amount')} || ' is just below reporting threshold. ' || n || ' similar transactions in the past 72h.'", "least(95E0, 55E0 + n * 8E0)"),
    "frequency": _rows("frequency", f"SELECT *, count(*) {_over(24)} AS n FROM aml_txn", "n >= 5",
        "'High transaction frequency: ' || n || ' transactions in the past 24 hours (threshold: 5)'", "least(90E0, 50E0 + (n - 5) * 5E0)"),
    "velocity": _rows("velocity", f"SELECT *, CAST(sum(CAST(amount AS DECIMAL(18,2))) {_over(24)} AS DOUBLE) AS v FROM aml_txn", "v >= 25000",
        f"'High velocity: cumulative amount ' || {_usd('v')} || ' in 24h exceeds threshold of $25,000.00'", "least(92E0, 55E0 + (v - 25000E0) / 25000E0 * 25E0)"),
    "high_risk_country": _rows("high_risk_country", f"""SELECT t.*, c.country AS cc, coalesce(t.originating_country IN ({_RISKY}), false) AS o, coalesce(t.destination_country IN ({_RISKY}), false) AS d,
      coalesce(c.country IN ({_RISKY}), false) AS k FROM aml_txn t LEFT JOIN aml_customer c ON t.from_customer_id = c.customer_id""", "o OR d OR k",
        "'Transaction involves high-risk country: ' || concat_ws(', ', CASE WHEN o THEN 'originating=' || originating_country END, CASE WHEN d THEN 'destination=' || destination_country END, CASE WHEN k THEN 'customer_country=' || cc END)",
        "least(95E0, 65E0 + (CAST(o AS INT) + CAST(d AS INT) + CAST(k AS INT)) * 10E0)"),
    "rapid_movement": _rows("rapid_movement", """SELECT * FROM (SELECT *, coalesce(CAST(sum(i) OVER w AS DOUBLE), 0E0) AS got, coalesce(CAST(sum(o) OVER w AS DOUBLE), 0E0) AS sent FROM (
        SELECT id, from_customer_id, from_customer_id AS who, created_at, true AS mine, CAST(NULL AS DECIMAL(18,2)) AS i,
          CASE WHEN transaction_type IN ('withdrawal', 'transfer', 'wire') THEN CAST(amount AS DECIMAL(18,2)) END AS o FROM aml_txn
        UNION ALL SELECT id, from_customer_id, to_customer_id, created_at, false,
          CASE WHEN transaction_type IN ('deposit', 'transfer', 'wire') THEN CAST(amount AS DECIMAL(18,2)) END, CAST(NULL AS DECIMAL(18,2)) FROM aml_txn) l
        WINDOW w AS (PARTITION BY who ORDER BY created_at RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW)) x WHERE mine""", "got >= 5000 AND sent >= 3500",
        f"'Rapid fund movement: received ' || {_usd('got')} || ' and sent ' || {_usd('sent')} || ' within 24h (turnover ratio: ' || format('{{:,.0f}}', sent / got * 100) || '%)'",
        "least(90E0, 60E0 + sent / got * 20E0)"),
    "round_amount": _rows("round_amount", f"SELECT *, count(*) {_over(48)} - 1 AS n FROM aml_txn WHERE amount >= 1000",
        "(amount % 1000 = 0 OR (amount % 500 = 0 AND amount >= 5000)) AND amount - floor(amount) < 0.01E0 AND (n >= 1 OR amount >= 10000)",
        f"'Suspicious round-number transaction: ' || {_usd('amount')} || '. ' || n || ' similar round amounts in past 48h.'",
        "least(85E0, 45E0 + n * 5E0 + CASE WHEN amount >= 10000 THEN 15E0 ELSE 0E0 END)"),
    "pep_transaction": _rows("pep_transaction", "SELECT t.*, c.full_name FROM aml_txn t JOIN aml_customer c ON t.from_customer_id = c.customer_id WHERE c.pep_status", "true",
        f"'Transaction of ' || {_usd('amount')} || ' involves a Politically Exposed Person (PEP): ' || full_name", "least(95E0, 70E0 + amount / 10000E0 * 5E0)"),
    "micro_transaction": _rows("micro_transaction", f"""SELECT *, CASE WHEN n >= 2 THEN (epoch_us(created_at) - f) / 6E7 / (n - 1) ELSE 0E0 END AS gap FROM (
        SELECT *, count(*) {_over(1)} AS n, min(epoch_us(created_at)) {_over(1)} AS f FROM aml_txn WHERE amount <= 100) m""", "n >= 4 AND gap <= 30",
        "'Micro-transaction pattern detected: ' || n || ' transactions of ≤$100.00 in 1h with an average interval of ' || format('{:,.1f}', gap) || ' min. Possible automated account testing or micro-layering.'",
        "least(88E0, 50E0 + n * 5E0 + greatest(0E0, 30E0 - gap) * 0.5E0)"),
}
_EVERY = "\nUNION ALL\n".join(f"({s})" for s in _SQL.values())

PLANS = {f"rule_{c}": (_one(c), sql) for c, sql in _SQL.items()}
PLANS["evaluate_rules"] = (lambda t: _all(t).select(*COLUMNS), _EVERY)
PLANS["generate_alerts"] = (
    lambda t: R.generate_alerts(_all(t))[0].select("alert_number", "transaction_id", "customer_id", "rule_id", "severity", "status", "reason", "risk_score"),
    f"""SELECT 'ALT-' || strftime(t.created_at, '%Y%m%d') || '-' ||
      {padded('row_number() OVER (PARTITION BY CAST(t.created_at AS DATE) ORDER BY t.created_at, m.txn_id, m.rule_id)', 5)} AS alert_number,
      m.txn_id AS transaction_id, m.customer_id, m.rule_id, m.severity, 'open' AS status, m.reason, m.risk_score
    FROM ({_EVERY}) m JOIN aml_txn t ON t.id = m.txn_id WHERE m.customer_id IS NOT NULL""",
)
PLANS["flag_transactions"] = (
    lambda t: R.flag_transactions(t.aml_txn, _all(t)).select("id", "flagged", "risk_score"),
    f"""SELECT t.id, t.flagged OR m.s IS NOT NULL AS flagged, coalesce(m.s, t.risk_score) AS risk_score
    FROM aml_txn t LEFT JOIN (SELECT txn_id, max(risk_score) AS s FROM ({_EVERY}) e GROUP BY txn_id) m ON m.txn_id = t.id""",
)
PLANS["rules_throughput"] = (
    lambda t: R.evaluate_rules(
        t.aml_txn_big, t.aml_customer, t.aml_rule,
    ).groupBy("rule_id").agg(F.count("*").alias("n"), F.min("risk_score").alias("least"), F.max("risk_score").alias("most")),
    "SELECT rule_id, count(*) AS n, min(risk_score) AS least, max(risk_score) AS most FROM ("
    + "\nUNION ALL\n".join(f"({_SQL[c].replace('aml_txn', 'aml_txn_big')})" for c in _SQL) + ") e GROUP BY rule_id",
)
