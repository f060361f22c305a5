"""Compliance and dashboard queries over the AML views."""

from __future__ import annotations

from ledgerlark.operators import compliance as C
from ledgerlark.plans.sql import AT, NOW, cnt, hours, pct, r, total, values

_SAR = f"SELECT count(*) AS closed, {cnt('sar_filed')} AS sars FROM aml_case WHERE status IN ('closed', 'filed_sar') AND created_at >= {NOW} - INTERVAL 90 DAY"
_RES = f"""SELECT count(*) AS n, {r('CAST(sum(CAST(h AS DECIMAL(18,4))) AS DOUBLE) / count(*)')} AS mean_hours, {r('median(h)')} AS median_hours, {r('min(h)')} AS least_hours, {r('max(h)')} AS most_hours, {cnt('h <= 24')} AS within_24h, {cnt('h <= 72')} AS within_72h
FROM (SELECT {hours('created_at', 'closed_at')} AS h FROM aml_case WHERE closed_at IS NOT NULL) q"""
_RESOLUTION = f"SELECT *, {pct('within_24h', 'n')} AS sla_24h_pct, {pct('within_72h', 'n')} AS sla_72h_pct FROM ({_RES}) x"
_DONE = "status IN ('closed', 'false_positive')"
_SCORE = f"""SELECT {r('sar')} AS sar, {r('sla')} AS sla, {r('fp')} AS fp, {r('resolved')} AS resolved, {r('kyc')} AS kyc, overall,
  CASE WHEN overall >= 90 THEN 'A' WHEN overall >= 80 THEN 'B' WHEN overall >= 70 THEN 'C' WHEN overall >= 60 THEN 'D' ELSE 'F' END AS grade FROM (
  SELECT *, least(100E0, {r(' + '.join(r(f'{c} * {w}E0') for c, w in (('sar', 0.15), ('sla', 0.2), ('fp', 0.2), ('resolved', 0.2), ('kyc', 0.25))))}) AS overall FROM (
    SELECT (SELECT least(100E0, least(100E0, {pct('sars', 'closed')}) * 1.5E0) FROM ({_SAR}) s) AS sar, (SELECT sla_72h_pct FROM ({_RESOLUTION}) s) AS sla,
      (SELECT greatest(0E0, 100E0 - {cnt("status = 'false_positive'")} / {cnt(_DONE)} * 100E0) FROM aml_alert) AS fp, (SELECT {cnt(_DONE)} / count(*) * 100E0 FROM aml_alert) AS resolved,
      (SELECT {cnt('id_type IS NOT NULL AND id_number IS NOT NULL AND date_of_birth IS NOT NULL')} / count(*) * 100E0 FROM aml_customer) AS kyc) a) b"""
_BREACH = f"""SELECT *, stale_critical_alerts + stale_open_cases + open_alerts_of_sanctioned AS total_breaches FROM (SELECT
  (SELECT count(*) FROM aml_alert WHERE severity = 'critical' AND status = 'open' AND created_at <= {NOW} - INTERVAL 5 DAY) AS stale_critical_alerts,
  (SELECT count(*) FROM aml_case WHERE status IN ('open', 'investigating') AND updated_at <= {NOW} - INTERVAL 7 DAY) AS stale_open_cases,
  (SELECT count(*) FROM aml_alert WHERE status = 'open' AND customer_id IN (SELECT customer_id FROM aml_customer WHERE sanctions_flag)) AS open_alerts_of_sanctioned,
  (SELECT count(*) FROM aml_customer WHERE sanctions_flag) AS sanctioned_customers) x"""
_FILLED = {c: f"({c} IS NOT NULL AND trim(CAST({c} AS VARCHAR)) <> '')" for c in C.KYC_FIELDS}


def _period(fact: str, counts: str) -> str:
    keys = [("strftime(created_at, '%Y-%m')", "m"), ("CAST(year(created_at) AS VARCHAR) || '-Q' || quarter(created_at)", "q"), ("CAST(year(created_at) AS VARCHAR)", "y")]
    return " UNION ALL ".join(f"SELECT {k} AS period, {counts} FROM {fact} WHERE created_at IS NOT NULL GROUP BY 1" for k, _ in keys)


def _effect(kind: str, where: str) -> str:
    return f"""SELECT r.rule_id, r.name AS rule_name, r.category, coalesce(n, 0) AS n, coalesce(f, 0) AS false_positives, coalesce(c, 0) AS confirmed, {pct('coalesce(f, 0)', 'coalesce(n, 0)')} AS false_positive_pct, CASE WHEN n > 0 THEN {r('s / n')} ELSE 0E0 END AS avg_score
    FROM aml_rule r {kind} JOIN (SELECT rule_id, count(*) AS n, {cnt("status = 'false_positive'")} AS f, {cnt("status IN ('escalated', 'closed')")} AS c, {total('risk_score')} AS s FROM aml_alert WHERE {where} GROUP BY 1) a ON a.rule_id = r.rule_id"""


_GROUPS = (("total", "'all'"), ("type", "transaction_type"), ("currency", "currency"), ("day", "CAST(CAST(created_at AS DATE) AS VARCHAR)"))
_TODAY = f"date_trunc('day', {NOW})"

PLANS = {
    "sar_filing_rate": (
        lambda t: C.sar_filing_rate(t.aml_case, AT),
        f"SELECT month, closed, sars, {pct('sars', 'closed')} AS rate FROM (SELECT 'all' AS month, * FROM ({_SAR}) a UNION ALL SELECT strftime(created_at, '%Y-%m') AS month, count(*) AS closed, {cnt('sar_filed')} AS sars FROM aml_case WHERE status IN ('closed', 'filed_sar') AND created_at >= {NOW} - INTERVAL 90 DAY GROUP BY 1) x",
    ),
    "case_resolution_stats": (lambda t: C.case_resolution_stats(t.aml_case), _RESOLUTION),
    "rule_effectiveness": (lambda t: C.rule_effectiveness(t.aml_alert, t.aml_rule), _effect("", "true")),
    "rule_effectiveness_window": (lambda t: C.rule_effectiveness(t.aml_alert, t.aml_rule, AT, 3), _effect("LEFT", f"created_at >= {NOW} - INTERVAL 3 DAY")),
    "alert_to_case_conversion": (
        lambda t: C.alert_to_case_conversion(t.aml_alert, t.aml_case, AT),
        f"""WITH a AS (SELECT severity, alert_id IN (SELECT alert_id FROM aml_case) AS k FROM aml_alert WHERE created_at >= {NOW} - INTERVAL 90 DAY), g AS (SELECT severity, count(*) AS n, {cnt('k')} AS w FROM a GROUP BY 1 UNION ALL SELECT 'all', count(*), {cnt('k')} FROM a)
        SELECT l.severity, coalesce(n, 0) AS n, coalesce(w, 0) AS with_case, {pct('coalesce(w, 0)', 'coalesce(n, 0)')} AS conversion_pct FROM {values('severity', [*C.LEVELS, 'all'])} l LEFT JOIN g ON g.severity = l.severity""",
    ),
    "kyc_coverage": (
        lambda t: C.kyc_coverage(t.aml_customer),
        " UNION ALL ".join(f"SELECT '{n}' AS field, {cnt(w)} AS filled, {pct(cnt(w), 'count(*)')} AS pct FROM aml_customer" for n, w in [*_FILLED.items(), ("all_fields", " AND ".join(_FILLED.values()))]),
    ),
    "compliance_score": (lambda t: C.compliance_score(t.aml_case, t.aml_alert, t.aml_customer, AT), _SCORE),
    "regulatory_breaches": (lambda t: C.regulatory_breaches(t.aml_alert, t.aml_case, t.aml_customer, AT), _BREACH),
    "kpi_table": (
        lambda t: C.kpi_table(t.aml_case, t.aml_alert, t.aml_customer, AT),
        f"""WITH s AS ({_SCORE}), b AS ({_BREACH}), a AS ({_SAR}), k AS (SELECT 'compliance_score' AS kpi, overall AS value, 80E0 AS benchmark FROM s UNION ALL SELECT 'sar_filing_rate', {pct('sars', 'closed')}, 20E0 FROM a UNION ALL SELECT 'sla_72h', sla, 80E0 FROM s
        UNION ALL SELECT 'false_positive_score', fp, 70E0 FROM s UNION ALL SELECT 'alert_resolution', resolved, 70E0 FROM s UNION ALL SELECT 'kyc_coverage', kyc, 90E0 FROM s UNION ALL SELECT 'regulatory_breaches', CAST(total_breaches AS DOUBLE), 0E0 FROM b)
        SELECT kpi, value, benchmark, CASE WHEN (kpi = 'regulatory_breaches' AND value <= benchmark) OR (kpi <> 'regulatory_breaches' AND value >= benchmark) THEN 'OK' ELSE 'CONCERN' END AS status FROM k""",
    ),
    "monthly_transaction_summary": (
        lambda t: C.monthly_transaction_summary(t.aml_txn, "2024-01-01", "2024-02-01"),
        " UNION ALL ".join(f"SELECT '{g}' AS grouping, {k} AS key, count(*) AS n, {total('amount')} AS volume, {cnt('flagged')} AS flagged FROM aml_txn WHERE created_at >= TIMESTAMP '2024-01-01 00:00:00' AND created_at < TIMESTAMP '2024-02-01 00:00:00' GROUP BY 2" for g, k in _GROUPS),
    ),
    "alert_statistics": (
        lambda t: C.alert_statistics(t.aml_alert, AT),
        f"""SELECT n, {', '.join(C.LEVELS)}, status_open, status_under_review, status_escalated, status_closed, status_false_positive, {pct('status_false_positive', 'n')} AS false_positive_pct, CASE WHEN k > 0 THEN {r('h / k')} ELSE 0E0 END AS avg_resolution_hours FROM (SELECT count(*) AS n, {', '.join(f"{cnt(f"severity = '{s}'")} AS {s}" for s in C.LEVELS)},
        {', '.join(f"{cnt(f"status = '{s}'")} AS status_{s}" for s in ("open", "under_review", "escalated", "closed", "false_positive"))}, CAST(sum(CAST({hours('created_at', 'closed_at')} AS DECIMAL(18,4))) FILTER (WHERE status = 'closed') AS DOUBLE) AS h, count(closed_at) FILTER (WHERE status = 'closed') AS k FROM aml_alert WHERE created_at >= {NOW} - INTERVAL 30 DAY) x""",
    ),
    "alert_top_rules": (
        lambda t: C.top_rules(t.aml_alert, t.aml_rule, AT, 30),
        f"SELECT a.rule_id, n, r.name AS rule_name, r.severity FROM (SELECT rule_id, count(*) AS n FROM aml_alert WHERE rule_id IS NOT NULL AND created_at >= {NOW} - INTERVAL 30 DAY GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5) a JOIN aml_rule r ON r.rule_id = a.rule_id",
    ),
    "sar_summary": (
        lambda t: C.sar_summary(t.aml_case, t.aml_alert, t.aml_customer, 2023),
        "SELECT case_id, case_number, sar_reference, a.customer_id, full_name, c.risk_level, severity, k.created_at AS filed_at FROM aml_case k LEFT JOIN aml_alert a ON a.alert_id = k.alert_id LEFT JOIN aml_customer c ON c.customer_id = a.customer_id WHERE sar_filed AND year(k.created_at) = 2023",
    ),
    "customer_risk_report": (
        lambda t: C.customer_risk_report(t.aml_customer),
        " UNION ALL ".join(f"SELECT 'count' AS kind, '{n}' AS name, {cnt(w)} AS n FROM aml_customer" for n, w in [*((f"level_{s}", f"risk_level = '{s}'") for s in C.LEVELS), ("pep", "pep_status"), ("sanctioned", "sanctions_flag")])
        + " UNION ALL SELECT * FROM (SELECT 'place', coalesce(nationality, country, 'Unknown') AS p, count(*) AS n FROM aml_customer GROUP BY 2 ORDER BY n DESC, 2 LIMIT 10) z",
    ),
    "compliance_periods": (
        lambda t: C.compliance_periods(t.aml_txn, t.aml_alert, t.aml_case),
        f"""WITH t AS ({_period('aml_txn', f"count(*) AS txns, {total('amount')} AS volume, {cnt('flagged')} AS flagged")}), a AS ({_period('aml_alert', f'''count(*) AS alerts, {cnt("status = 'false_positive'")} AS false_positives''')}), c AS ({_period('aml_case', f"count(*) AS cases, {cnt('sar_filed')} AS sars")}),
        p AS (SELECT period FROM t UNION SELECT period FROM a UNION SELECT period FROM c) SELECT p.period, coalesce(txns, 0) AS txns, coalesce(volume, 0E0) AS volume, coalesce(flagged, 0) AS flagged, coalesce(alerts, 0) AS alerts, coalesce(false_positives, 0) AS false_positives, coalesce(cases, 0) AS cases, coalesce(sars, 0) AS sars
        FROM p LEFT JOIN t ON t.period = p.period LEFT JOIN a ON a.period = p.period LEFT JOIN c ON c.period = p.period""",
    ),
    "period_report": (
        lambda t: C.period_report(t.aml_txn, t.aml_alert, t.aml_customer, t.aml_case, "2024-01-01 00:00:00", AT),
        f"""WITH t AS (SELECT count(*) AS txns, {total('amount')} AS volume, {cnt('flagged')} AS flagged, {total('amount', 'flagged')} AS flagged_volume FROM aml_txn WHERE created_at BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND {NOW}),
        a AS (SELECT count(*) AS alerts, {', '.join(f"{cnt(f"severity = '{s}'")} AS alerts_{s}" for s in C.LEVELS)}, {', '.join(f"{cnt(f"status = '{s}'")} AS alerts_{s}" for s in ("open", "closed", "escalated", "false_positive"))} FROM aml_alert WHERE created_at BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND {NOW}),
        c AS (SELECT count(*) AS customers, {cnt("risk_level IN ('high', 'critical')")} AS high_risk, {cnt(f"created_at BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND {NOW}")} AS new_customers FROM aml_customer), k AS (SELECT {cnt("status IN ('open', 'investigating', 'pending_review')")} AS open_cases FROM aml_case) SELECT * FROM t, a, c, k""",
    ),
    "dashboard_kpis": (
        lambda t: C.dashboard_kpis(t.aml_txn, t.aml_alert, t.aml_case, t.aml_customer, t.aml_audit, AT),
        f"""WITH t AS (SELECT {cnt(f'created_at >= {_TODAY}')} AS txns_today, count(*) AS txns_month, {total('amount', f'created_at >= {_TODAY}')} AS volume_today, {total('amount')} AS volume_month, {cnt(f'flagged AND created_at >= {_TODAY}')} AS flagged_today FROM aml_txn WHERE created_at >= date_trunc('month', {NOW})),
        a AS (SELECT {cnt("status = 'open'")} AS open_alerts, {cnt("status = 'open' AND severity IN ('high', 'critical')")} AS high_critical_alerts FROM aml_alert), c AS (SELECT {cnt("status IN ('open', 'investigating', 'pending_review')")} AS open_cases FROM aml_case),
        k AS (SELECT {cnt("risk_level IN ('high', 'critical')")} AS high_risk_customers FROM aml_customer), s AS (SELECT {cnt(f"action = 'SANCTIONS_SEARCH' AND created_at >= {_TODAY}")} AS screenings_today FROM aml_audit) SELECT * FROM t, a, c, k, s""",
    ),
    "dashboard_series": (
        lambda t: C.dashboard_series(t.aml_txn, t.aml_alert, AT),
        f"""WITH d AS (SELECT CAST({NOW} AS DATE) - CAST(i AS INTEGER) AS day FROM range(30) q(i)), t AS (SELECT CAST(created_at AS DATE) AS day, count(*) AS n, {total('amount')} AS s FROM aml_txn GROUP BY 1), a AS (SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM aml_alert GROUP BY 1)
        SELECT d.day, coalesce(t.n, 0) AS txns, coalesce(t.s, 0E0) AS amount, coalesce(a.n, 0) AS alerts FROM d LEFT JOIN t ON t.day = d.day LEFT JOIN a ON a.day = d.day""",
    ),
    "dashboard_top_rules": (
        lambda t: C.top_rules(t.aml_alert, t.aml_rule),
        "SELECT a.rule_id, n, r.name AS rule_name, r.severity FROM (SELECT rule_id, count(*) AS n FROM aml_alert WHERE rule_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5) a JOIN aml_rule r ON r.rule_id = a.rule_id",
    ),
    "dashboard_open_alerts": (
        lambda t: C.newest_open_alerts(t.aml_alert, t.aml_customer),
        "SELECT alert_id, alert_number, full_name AS customer_name, severity, CASE WHEN length(reason) > 80 THEN substr(reason, 1, 80) || '...' ELSE reason END AS reason, strftime(a.created_at, '%Y-%m-%d %H:%M') AS created_at FROM aml_alert a JOIN aml_customer c ON c.customer_id = a.customer_id WHERE status = 'open' ORDER BY a.created_at DESC, alert_id LIMIT 10",
    ),
    "dashboard_cases_by_status": (
        lambda t: C.cases_by_status(t.aml_case),
        f"SELECT l.status, count(k.case_id) AS n FROM {values('status', C.CASE_STATUSES)} l LEFT JOIN aml_case k ON k.status = l.status GROUP BY 1",
    ),
    "sar_packets": (
        lambda t: C.sar_packets(t.aml_case, t.aml_alert, t.aml_customer, t.aml_txn, t.aml_rule).select("case_id", "customer_id", "full_name", "rule_name", "n_txns", "total_amount", "types", "first_at", "last_at", "activity", "missing"),
        f"""WITH x AS (SELECT *, row_number() OVER (PARTITION BY from_customer_id ORDER BY created_at DESC, id DESC) AS k FROM aml_txn WHERE flagged), p AS (SELECT from_customer_id AS customer_id, count(*) AS n, {total('amount')} AS s, string_agg(DISTINCT transaction_type, ',' ORDER BY transaction_type) AS types, min(created_at) AS f, max(created_at) AS l,
          {cnt('amount BETWEEN 7000 AND 10000')} AS b, {cnt('is_international')} AS i, {cnt("transaction_type IN ('cash', 'deposit', 'withdrawal')")} AS c FROM x WHERE k <= 20 GROUP BY 1)
        SELECT case_id, a.customer_id, full_name, r.name AS rule_name, coalesce(n, 0) AS n_txns, coalesce(s, 0E0) AS total_amount, coalesce(types, '') AS types, f AS first_at, l AS last_at,
          concat_ws(',', CASE WHEN b >= 2 THEN 'structuring' END, CASE WHEN i > 0 THEN 'international_transfers' END, CASE WHEN c >= 3 THEN 'cash_activity' END, CASE WHEN s >= 10000 THEN 'large_volume' END) AS activity,
          concat_ws(',', {', '.join(f"CASE WHEN {c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '' THEN '{c}' END" for c in ("full_name", "id_type", "id_number", "address", "date_of_birth"))}, CASE WHEN n IS NULL THEN 'transactions' END) AS missing
        FROM aml_case q LEFT JOIN aml_alert a ON a.alert_id = q.alert_id LEFT JOIN aml_rule r ON r.rule_id = a.rule_id LEFT JOIN aml_customer u ON u.customer_id = a.customer_id LEFT JOIN p ON p.customer_id = a.customer_id""",
    ),
    "data_health": (
        lambda t: C.data_health(t.aml_sanctions_entry, t.aml_alert, t.aml_txn, t.aml_rule, t.aml_customer, t.aml_case, AT),
        f"""WITH x AS (SELECT 'sanctions_list' AS c, (SELECT count(*) FROM aml_sanctions_entry) AS a, CAST(0 AS BIGINT) AS b UNION ALL SELECT 'alert_queue', {cnt("status = 'open'")}, {cnt("status = 'open' AND severity = 'critical'")} FROM aml_alert
        UNION ALL SELECT 'transaction_volume', {cnt(f'created_at >= {NOW} - INTERVAL 24 HOUR')}, {cnt(f'created_at >= {NOW} - INTERVAL 1 HOUR')} FROM aml_txn UNION ALL SELECT 'rules_engine', {cnt('is_active')}, count(*) FROM aml_rule
        UNION ALL SELECT 'high_risk_customers', {cnt("risk_level IN ('high', 'critical')")}, {cnt('sanctions_flag')} FROM aml_customer UNION ALL SELECT 'sar_backlog', {cnt(f"status = 'escalated' AND created_at <= {NOW} - INTERVAL 7 DAY")}, 0 FROM aml_case)
        SELECT c AS "check", CASE WHEN (c = 'sanctions_list' AND a = 0) OR (c = 'alert_queue' AND b > 20) OR (c = 'rules_engine' AND a = 0) OR (c = 'sar_backlog' AND a > 5) THEN 'CRITICAL' WHEN (c = 'sanctions_list' AND a <= 10000) OR (c = 'alert_queue' AND a > 100)
        OR (c = 'transaction_volume' AND (a = 0 OR b = 0)) OR (c = 'rules_engine' AND a < 3) OR (c = 'high_risk_customers' AND b > 0) OR (c = 'sar_backlog' AND a > 0) THEN 'WARN' ELSE 'OK' END AS status, a, b FROM x""",
    ),
}
