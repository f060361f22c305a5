"""Analytics queries over the AML views."""

from __future__ import annotations

from ledgerlark.operators import analytics as A
from ledgerlark.plans.sql import AT, NOW, big, cnt, hours, last, pct, r, total, values

_HIGH = "risk_level IN ('high', 'critical')"
_BUCKETS = " ".join(f"WHEN amount >= {a} AND amount < {b or '1e300'} THEN '{a}-{b}'" if b else f"WHEN amount >= {a} THEN '{a}+'" for a, b in A.BUCKETS)
_NAMES = [f"{a}-{b}" if b else f"{a}+" for a, b in A.BUCKETS]
_SEV = ", ".join(f"{cnt(f"severity = '{s}'")} AS {s}" for s in A.LEVELS)

PLANS = {
    "txn_volume_trend": (
        lambda t: A.txn_volume_trend(t.aml_txn, AT),
        f"SELECT day, n, amount, flagged, {pct('flagged', 'n')} AS flag_rate FROM (SELECT CAST(created_at AS DATE) AS day, count(*) AS n, {total('amount')} AS amount, {cnt('flagged')} AS flagged FROM aml_txn WHERE {last(30)} GROUP BY 1) x",
    ),
    "txn_hourly_distribution": (
        lambda t: A.txn_hourly_distribution(t.aml_txn, AT),
        f"SELECT hour, n, {r('s / n')} AS avg_amount, flagged FROM (SELECT CAST(hour(created_at) AS INTEGER) AS hour, count(*) AS n, {total('amount')} AS s, {cnt('flagged')} AS flagged FROM aml_txn WHERE {last(30)} GROUP BY 1) x",
    ),
    "txn_flag_rate_by_type": (
        lambda t: A.txn_flag_rate_by_type(t.aml_txn),
        f"SELECT *, {pct('flagged', 'n')} AS flag_rate FROM (SELECT transaction_type, count(*) AS n, {cnt('flagged')} AS flagged FROM aml_txn GROUP BY 1) x",
    ),
    "txn_amount_distribution": (
        lambda t: A.txn_amount_distribution(t.aml_txn),
        f"SELECT b.bucket, coalesce(n, 0) AS n, coalesce(amount, 0E0) AS amount FROM {values('bucket', _NAMES)} b LEFT JOIN (SELECT CASE {_BUCKETS} END AS bucket, count(*) AS n, {total('amount')} AS amount FROM aml_txn GROUP BY 1) x ON b.bucket = x.bucket",
    ),
    "txn_country_corridors": (
        lambda t: A.txn_country_corridors(t.aml_txn),
        f"SELECT originating_country AS origin, destination_country AS destination, count(*) AS n, {cnt('flagged')} AS flagged, {total('amount')} AS amount FROM aml_txn WHERE originating_country <> destination_country GROUP BY 1, 2 ORDER BY flagged DESC, n DESC, 1, 2 LIMIT 15",
    ),
    "txn_by_country": (
        lambda t: A.txn_by_country(t.aml_txn),
        f"SELECT *, {r('volume / n')} AS avg_amount FROM (SELECT originating_country AS country, count(*) AS n, {total('amount')} AS volume, {cnt('flagged')} AS flagged FROM aml_txn WHERE originating_country IS NOT NULL GROUP BY 1) x",
    ),
    "txn_summary": (
        lambda t: A.txn_summary(t.aml_txn, AT),
        f"SELECT n, volume, flagged, {pct('flagged', 'n')} AS flag_rate, CASE WHEN n > 0 THEN {r('volume / n')} ELSE 0E0 END AS avg_amount, international, {pct('international', 'n')} AS international_rate FROM (SELECT count(*) AS n, {total('amount')} AS volume, {cnt('flagged')} AS flagged, {cnt('is_international')} AS international FROM aml_txn WHERE {last(30)}) x",
    ),
    "alert_velocity": (
        lambda t: A.alert_velocity(t.aml_alert, AT),
        f"""WITH d AS (SELECT created_at >= {NOW} - INTERVAL 30 DAY AS recent, CAST(created_at AS DATE) AS day, count(*) AS n FROM aml_alert WHERE {last(60)} GROUP BY 1, 2)
        SELECT n, {r('n / 30E0')} AS per_day, peak_day, peak, previous, CASE WHEN previous > 0 THEN {r('(n - previous) * 100E0 / previous')} WHEN n > 0 THEN 100E0 ELSE 0E0 END AS change_pct FROM (
          SELECT {big("sum(n) FILTER (WHERE recent)")} AS n, {big("sum(n) FILTER (WHERE NOT recent)")} AS previous, max(n) FILTER (WHERE recent) AS peak,
            (SELECT CAST(day AS VARCHAR) FROM d WHERE recent ORDER BY n DESC, day LIMIT 1) AS peak_day FROM d) x""",
    ),
    "alert_by_rule": (
        lambda t: A.alert_by_rule(t.aml_alert, t.aml_rule),
        f"""SELECT r.rule_id, r.name AS rule_name, coalesce(n, 0) AS n, coalesce(open, 0) AS open, coalesce(closed, 0) AS closed, {', '.join(f'coalesce({s}, 0) AS {s}' for s in A.LEVELS)}
        FROM aml_rule r LEFT JOIN (SELECT rule_id, count(*) AS n, {cnt("status = 'open'")} AS open, {cnt("status IN ('closed', 'false_positive')")} AS closed, {_SEV} FROM aml_alert GROUP BY 1) a ON a.rule_id = r.rule_id""",
    ),
    "alert_rates": (
        lambda t: A.alert_rates(t.aml_alert),
        f"""SELECT *, {pct('escalated', 'n')} AS escalation_rate, {pct('false_positive', 'n')} AS false_positive_rate FROM (SELECT count(*) AS n, {cnt("status = 'escalated'")} AS escalated, {cnt("status = 'false_positive'")} AS false_positive,
        {', '.join(f"{cnt(f"status = 'open' AND severity = '{s}'")} AS open_{s}" for s in A.LEVELS)} FROM aml_alert) x""",
    ),
    "alert_time_to_resolve": (
        lambda t: A.alert_time_to_resolve(t.aml_alert),
        f"SELECT count(*) AS n, {r('CAST(sum(CAST(h AS DECIMAL(18,4))) AS DOUBLE) / count(*)')} AS mean_h, {r('median(h)')} AS median_h, {r('min(h)')} AS min_h, {r('max(h)')} AS max_h FROM (SELECT {hours('created_at', 'closed_at')} AS h FROM aml_alert WHERE closed_at IS NOT NULL) x",
    ),
    "alert_severity_trend": (
        lambda t: A.alert_severity_trend(t.aml_alert, AT),
        f"SELECT CAST(created_at AS DATE) AS day, {_SEV}, count(*) AS n FROM aml_alert WHERE {last(30)} GROUP BY 1",
    ),
    "top_alerted_customers": (
        lambda t: A.top_alerted_customers(t.aml_alert, t.aml_customer),
        f"SELECT a.*, c.full_name, c.risk_level FROM (SELECT customer_id, count(*) AS n, {cnt("severity = 'critical'")} AS critical FROM aml_alert GROUP BY 1 ORDER BY n DESC, customer_id LIMIT 10) a JOIN aml_customer c ON c.customer_id = a.customer_id",
    ),
    "alert_resolution_breakdown": (
        lambda t: A.alert_resolution_breakdown(t.aml_alert),
        f"""WITH g AS (SELECT status, count(*) AS n FROM aml_alert GROUP BY 1), w AS (SELECT sum(n) AS whole, sum(n) FILTER (WHERE status IN ('closed', 'false_positive')) AS resolved FROM g)
        SELECT status, n, {pct('n', 'whole')} AS pct, {pct('resolved', 'whole')} AS resolved_pct FROM g, w""",
    ),
    "risk_distribution": (
        lambda t: A.risk_distribution(t.aml_customer),
        f"""WITH g AS (SELECT l.risk_level, count(c.customer_id) AS n FROM {values('risk_level', A.LEVELS)} l LEFT JOIN aml_customer c ON c.risk_level = l.risk_level GROUP BY 1), w AS (SELECT sum(n) AS whole, CAST(sum(n) FILTER (WHERE {_HIGH}) AS BIGINT) AS high_and_critical FROM g)
        SELECT risk_level, n, {pct('n', 'whole')} AS pct, high_and_critical FROM g, w""",
    ),
    "risk_level_trend": (
        lambda t: A.risk_level_trend(t.aml_customer, AT),
        f"""WITH m AS (SELECT CAST(date_trunc('month', {NOW}) - INTERVAL 1 DAY * (30 * i) AS TIMESTAMP) AS s FROM range(6) x(i)), f AS (SELECT s, date_trunc('month', s) + INTERVAL 1 MONTH AS e FROM m)
        SELECT CAST(CAST(s AS DATE) AS VARCHAR) AS month_start, n, high, {pct('high', 'n')} AS high_rate FROM (SELECT s, count(customer_id) AS n, count(customer_id) FILTER (WHERE {_HIGH}) AS high FROM f LEFT JOIN aml_customer ON created_at >= s AND created_at < e GROUP BY 1) x""",
    ),
    "pep_statistics": (
        lambda t: A.pep_statistics(t.aml_customer, t.aml_alert),
        f"""SELECT *, {pct('pep', 'customers')} AS pep_pct FROM (SELECT count(*) AS customers, {cnt('pep_status')} AS pep, {cnt(f'pep_status AND {_HIGH}')} AS pep_high_risk, {cnt('pep_status AND sanctions_flag')} AS pep_sanctioned,
        {cnt("pep_status AND customer_id IN (SELECT customer_id FROM aml_alert WHERE status = 'open')")} AS pep_with_open_alert, count(DISTINCT nationality) FILTER (WHERE pep_status) AS pep_nationalities FROM aml_customer) x""",
    ),
    "pep_by_nationality": (
        lambda t: A.flagged_by_nationality(t.aml_customer, "pep_status"),
        "SELECT coalesce(nationality, 'Unknown') AS nationality, count(*) AS n FROM aml_customer WHERE pep_status GROUP BY 1",
    ),
    "sanctioned_statistics": (
        lambda t: A.sanctioned_statistics(t.aml_customer, t.aml_alert),
        f"""SELECT *, {pct('sanctioned', 'customers')} AS sanctioned_pct FROM (SELECT count(*) AS customers, {cnt('sanctions_flag')} AS sanctioned, {', '.join(f"{cnt(f"sanctions_flag AND risk_level = '{s}'")} AS {s}" for s in A.LEVELS)},
        {cnt("sanctions_flag AND customer_id IN (SELECT customer_id FROM aml_alert WHERE status = 'open')")} AS with_open_alert, count(DISTINCT nationality) FILTER (WHERE sanctions_flag) AS nationalities FROM aml_customer) x""",
    ),
    "nationality_risk": (
        lambda t: A.nationality_risk(t.aml_customer),
        f"SELECT *, {pct('high', 'n')} AS high_pct FROM (SELECT coalesce(nationality, 'Unknown') AS nationality, count(*) AS n, {cnt(_HIGH)} AS high, {cnt('pep_status')} AS pep, {cnt('sanctions_flag')} AS sanctioned FROM aml_customer GROUP BY 1) x",
    ),
    "risk_by_country": (
        lambda t: A.risk_by_country(t.aml_customer),
        f"SELECT country, count(*) AS n, {cnt(_HIGH)} AS high, {cnt('pep_status')} AS pep FROM aml_customer WHERE country IS NOT NULL GROUP BY 1 ORDER BY n DESC, country LIMIT 15",
    ),
    "risk_by_occupation": (
        lambda t: A.risk_by_occupation(t.aml_customer),
        f"SELECT occupation, n, {r('s / n')} AS mean_level, {pct('high', 'n')} AS high_pct FROM (SELECT occupation, count(*) AS n, CAST(sum(CASE risk_level WHEN 'medium' THEN 1 WHEN 'high' THEN 2 WHEN 'critical' THEN 3 ELSE 0 END) AS DOUBLE) AS s, {cnt(_HIGH)} AS high FROM aml_customer WHERE occupation IS NOT NULL GROUP BY 1 ORDER BY n DESC, occupation LIMIT 20) x",
    ),
    "alerts_per_risk_level": (
        lambda t: A.alerts_per_risk_level(t.aml_customer, t.aml_alert),
        f"""SELECT risk_level, customers, alerts, CASE WHEN customers > 0 THEN {r('alerts / customers')} ELSE 0E0 END AS avg_alerts, {pct('w', 'customers')} AS with_alerts_pct FROM (SELECT l.risk_level, count(c.customer_id) AS customers, {big('sum(a.n)')} AS alerts, count(a.n) AS w
        FROM {values('risk_level', A.LEVELS)} l LEFT JOIN aml_customer c ON c.risk_level = l.risk_level LEFT JOIN (SELECT customer_id, count(*) AS n FROM aml_alert GROUP BY 1) a ON a.customer_id = c.customer_id GROUP BY 1) x""",
    ),
    "risk_score_histogram": (
        lambda t: A.risk_score_histogram(t.aml_txn),
        "SELECT b.bin, b.bin * 10E0 AS low, count(x.risk_score) AS n FROM (SELECT CAST(i AS BIGINT) AS bin FROM range(10) q(i)) b LEFT JOIN (SELECT risk_score FROM aml_txn WHERE risk_score > 0 AND risk_score < 100) x ON CAST(floor(x.risk_score / 10) AS BIGINT) = b.bin GROUP BY 1",
    ),
    "weekly_risk_trend": (
        lambda t: A.weekly_risk_trend(t.aml_txn, AT),
        f"SELECT *, {pct('high', 'n')} AS high_pct FROM (SELECT CAST(CAST(date_trunc('week', created_at) AS DATE) AS VARCHAR) AS week, count(*) AS n, {cnt('risk_score >= 60')} AS high FROM aml_txn WHERE {last(56)} GROUP BY 1) x",
    ),
}
