"""Risk, escalation and block-list queries over the AML views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.operators import lifecycle as L
from ledgerlark.operators import risk as K
from ledgerlark.operators.rules import HIGH_RISK_COUNTRIES
from ledgerlark.plans.sql import AT, NOW, cnt, r, total


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _case(column: str, table: dict[str, float], default: float) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {float(v)}E0" for k, v in table.items()) + f" ELSE {float(default)}E0 END"


def _steps(x: str, *marks) -> str:
    return "CASE " + " ".join(f"WHEN {x} > {m} THEN {float(n)}E0" for m, n in marks) + " ELSE 0E0 END"


def _ago(n: int, unit: str = "DAY") -> str:
    return f"{NOW} - INTERVAL {n} {unit}"


_SCORES = f"""
WITH t AS (SELECT from_customer_id AS customer_id, count(*) AS n, {cnt('flagged')} AS f, {total('amount')} AS s FROM aml_txn WHERE created_at >= {_ago(90)} GROUP BY 1),
a AS (SELECT customer_id, sum({_case('severity', K.SEVERITY_POINTS, 0)}) AS w, bool_or(severity = 'critical') AS c FROM aml_alert WHERE created_at >= {_ago(180)} AND status <> 'false_positive' GROUP BY 1),
x AS (SELECT c.customer_id, c.customer_number,
  least(60E0, {_case('c.risk_level', K.LEVEL_POINTS, 0)} + CASE WHEN pep_status THEN 20E0 ELSE 0E0 END + CASE WHEN sanctions_flag THEN 30E0 ELSE 0E0 END
    + CASE WHEN coalesce(nationality, country, '') IN {_in(HIGH_RISK_COUNTRIES)} THEN 20E0 WHEN coalesce(nationality, country, '') IN {_in(K.MEDIUM_RISK_COUNTRIES)} THEN 10E0 ELSE 0E0 END) AS p,
  CASE WHEN t.n IS NULL THEN 0E0 ELSE least(30E0, f / n * 25E0 + {_steps('s', (500000, 15), (100000, 8), (50000, 4))} + {_steps('n', (50, 10), (20, 5))}) END AS b,
  CASE WHEN w IS NULL THEN 0E0 WHEN a.c THEN least(25E0, least(25E0, w / 50E0 * 25E0) + 10E0) ELSE least(25E0, w / 50E0 * 25E0) END AS h
  FROM aml_customer c LEFT JOIN t ON t.customer_id = c.customer_id LEFT JOIN a ON a.customer_id = c.customer_id),
y AS (SELECT *, least(100E0, {r('p + b + h', 1)}) AS risk_score FROM x)
SELECT customer_id, customer_number, risk_score, CASE WHEN risk_score >= 75 THEN 'critical' WHEN risk_score >= 50 THEN 'high' WHEN risk_score >= 25 THEN 'medium' ELSE 'low' END AS risk_band,
  {r('p', 1)} AS profile_score, {r('b', 1)} AS transaction_score, {r('h', 1)} AS alert_score FROM y"""

_SPANS = {"recent": (0, 30), "mid": (30, 60), "older": (60, 90)}
_W = {k: f"created_at >= {_ago(b)} AND created_at < {_ago(a)}" for k, (a, b) in _SPANS.items()}


def _ch(y: str) -> str:
    return f"CASE WHEN mid_{y} = 0 THEN CASE WHEN recent_{y} > 0 THEN 100E0 ELSE 0E0 END ELSE {r(f'(recent_{y} - mid_{y}) / mid_{y} * 100E0', 1)} END"


_NAMES = [f"{k}_{m}" for k in _SPANS for m in ("n", "amount", "flagged", "countries", "alerts", "critical", "high")]
_TRAJECTORY = f"""
WITH t AS (SELECT from_customer_id AS customer_id, {', '.join(f"{cnt(w)} AS {k}_n, {total('amount', w)} AS {k}_amount, {cnt(w + ' AND flagged')} AS {k}_flagged, count(DISTINCT destination_country) FILTER (WHERE {w}) AS {k}_countries" for k, w in _W.items())} FROM aml_txn GROUP BY 1),
a AS (SELECT customer_id, {', '.join(f"{cnt(w)} AS {k}_alerts, {cnt(w + " AND severity = 'critical'")} AS {k}_critical, {cnt(w + " AND severity = 'high'")} AS {k}_high" for k, w in _W.items())} FROM aml_alert WHERE status <> 'false_positive' GROUP BY 1),
j AS (SELECT c.customer_id, c.risk_level, {', '.join(f'coalesce({n}, 0) AS {n}' for n in _NAMES)} FROM aml_customer c LEFT JOIN t ON t.customer_id = c.customer_id LEFT JOIN a ON a.customer_id = c.customer_id),
q AS (SELECT *, {', '.join(f"CASE WHEN {k}_n > 0 THEN {r(f'{k}_flagged / {k}_n', 3)} ELSE 0E0 END AS {k}_ratio" for k in _SPANS)} FROM j),
d AS (SELECT *, {_ch('n')} AS txn_change, {_ch('amount')} AS amount_change, {_ch('alerts')} AS alert_change, {_ch('ratio')} AS flag_change FROM q),
v AS (SELECT *, least(100E0, {_steps('txn_change', (50, 15), (20, 8))} + {_steps('amount_change', (100, 20), (50, 12), (20, 6))} + {_steps('alert_change', (100, 25), (50, 15), (0, 8))} + {_steps('flag_change', (50, 20), (20, 10))}
  + {_steps('recent_critical', (0, 15))} + {_steps('recent_high', (1, 10))} + {_steps('recent_countries - mid_countries', (2, 10))}) AS velocity_score FROM d)
SELECT customer_id, recent_n, mid_n, older_n, recent_amount, mid_amount, recent_alerts, mid_alerts, recent_ratio, txn_change, amount_change, alert_change, flag_change, velocity_score,
  CASE WHEN velocity_score >= 60 THEN 'escalating' WHEN velocity_score >= 30 THEN 'increasing' WHEN velocity_score >= 10 THEN 'stable' ELSE 'declining' END AS trend,
  least(100E0, {r(f"{_case('risk_level', K.PREDICTED_BASE, 10)} + velocity_score * 0.4E0", 1)}) AS predicted_score, least(95E0, {r('velocity_score * 0.87E0', 1)}) AS pattern_match FROM v"""

_BATCH = f"""
WITH a AS (SELECT customer_id, count(*) AS n FROM aml_alert WHERE created_at >= {_ago(30)} AND status <> 'false_positive' GROUP BY 1),
x AS (SELECT c.customer_id, coalesce(risk_level, 'low') AS old_level, {_case('risk_level', K.BATCH_BASE, 0.1)} AS old_score,
  CASE WHEN pep_status THEN 0.1E0 ELSE 0E0 END + CASE WHEN sanctions_flag THEN 0.2E0 ELSE 0E0 END + least(coalesce(n, 0) * 0.05E0, 0.2E0) + CASE WHEN nationality IN {_in(K.BATCH_COUNTRIES)} THEN 0.05E0 ELSE 0E0 END AS bonus
  FROM aml_customer c LEFT JOIN a ON a.customer_id = c.customer_id),
y AS (SELECT *, least(1E0, {r('old_score + bonus', 3)}) AS new_score FROM x),
z AS (SELECT *, CASE WHEN new_score >= 0.75E0 THEN 'critical' WHEN new_score >= 0.55E0 THEN 'high' WHEN new_score >= 0.3E0 THEN 'medium' ELSE 'low' END AS new_level, {r('abs(new_score - old_score)', 3)} AS delta FROM y)
SELECT customer_id, old_score, new_score, old_level, new_level, delta >= 0.001E0 OR old_level <> new_level AS changed, (delta >= 0.001E0 OR old_level <> new_level) AND delta >= 0 AS committed FROM z"""

_STALE = f"status = 'open' AND created_at < {_ago(48, 'HOUR')} AND severity <> 'critical'"
_HIGH = f"status IN ('open', 'under_review') AND severity = 'high' AND created_at < {_ago(24, 'HOUR')}"
_OFTEN = f"SELECT customer_id FROM {{}} WHERE created_at >= {_ago(7)} AND status <> 'false_positive' GROUP BY 1 HAVING count(*) >= 3"
_CHAIN = f"""
WITH s1 AS (SELECT alert_id, customer_id, created_at, {_STALE} AS hit, status, severity FROM aml_alert),
a1 AS (SELECT alert_id, customer_id, created_at, hit, CASE WHEN hit THEN 'escalated' ELSE status END AS status, CASE WHEN hit THEN 'critical' ELSE severity END AS severity FROM s1),
s2 AS (SELECT alert_id, customer_id, created_at, {_HIGH} AS hit, status, severity FROM a1),
a2 AS (SELECT alert_id, customer_id, created_at, hit, status, CASE WHEN hit THEN 'critical' ELSE severity END AS severity FROM s2),
s3 AS (SELECT alert_id, customer_id, created_at, status = 'open' AND customer_id IN ({_OFTEN.format('a2')}) AS hit, status, severity FROM a2),
a3 AS (SELECT alert_id, customer_id, hit, CASE WHEN hit THEN 'escalated' ELSE status END AS status, severity FROM s3)
"""
_OUT = ("alert_id", "status", "severity", "_hit")

PLANS = {
    "customer_risk_scores": (lambda t: K.customer_risk_scores(t.aml_customer, t.aml_txn, t.aml_alert, AT), _SCORES),
    "risk_trajectory": (lambda t: K.risk_trajectory(t.aml_customer, t.aml_txn, t.aml_alert, AT), _TRAJECTORY),
    "batch_risk_recalculate": (lambda t: K.batch_risk_recalculate(t.aml_customer, t.aml_alert, AT), _BATCH),
    "top_risky_customers": (
        lambda t: K.top_risky_customers(t.aml_customer, t.aml_alert),
        f"""SELECT c.customer_id, full_name, risk_level, coalesce(n, 0) AS alerts, least(150E0, {_case('risk_level', K.TOP_BASE, 10)} + CASE WHEN pep_status THEN 15E0 ELSE 0E0 END + CASE WHEN sanctions_flag THEN 20E0 ELSE 0E0 END + least(coalesce(n, 0) * 5E0, 30E0)) AS score
        FROM aml_customer c LEFT JOIN (SELECT customer_id, count(*) AS n FROM aml_alert WHERE status IN ('open', 'escalated') GROUP BY 1) a ON a.customer_id = c.customer_id ORDER BY score DESC, 1 LIMIT 20""",
    ),
    "escalate_stale": (lambda t: L.escalate_stale(t.aml_alert, AT).select(*_OUT).withColumnRenamed("_hit", "hit"), _CHAIN + "SELECT alert_id, status, severity, hit FROM a1"),
    "escalate_high": (
        lambda t: L.escalate_high(t.aml_alert, AT).select(*_OUT).withColumnRenamed("_hit", "hit"),
        f"SELECT alert_id, status, CASE WHEN {_HIGH} THEN 'critical' ELSE severity END AS severity, {_HIGH} AS hit FROM aml_alert",
    ),
    "escalate_repeat": (
        lambda t: L.escalate_repeat(t.aml_alert, AT).select(*_OUT).withColumnRenamed("_hit", "hit"),
        f"SELECT alert_id, CASE WHEN hit THEN 'escalated' ELSE status END AS status, severity, hit FROM (SELECT *, status = 'open' AND customer_id IN ({_OFTEN.format('aml_alert')}) AS hit FROM aml_alert) x",
    ),
    "run_escalation": (lambda t: L.run_escalation(t.aml_alert, AT)[0].select("alert_id", "status", "severity"), _CHAIN + "SELECT alert_id, status, severity FROM a3"),
    "escalation_log": (
        lambda t: L.run_escalation(t.aml_alert, AT)[1],
        _CHAIN + "SELECT alert_id, 'stale' AS action, status, severity FROM a1 WHERE hit UNION ALL SELECT alert_id, 'high', status, severity FROM a2 WHERE hit UNION ALL SELECT alert_id, 'repeat', status, severity FROM a3 WHERE hit",
    ),
    "escalation_candidates": (
        lambda t: L.escalation_candidates(t.aml_alert, AT),
        f"SELECT {cnt(_STALE)} AS stale, {cnt(_HIGH)} AS high, (SELECT count(*) FROM ({_OFTEN.format('aml_alert')}) o) AS repeat_customers FROM aml_alert",
    ),
    "blacklist_screen_transactions": (
        lambda t: L.blacklist_screen_transactions(t.aml_txn, t.aml_blacklist, AT),
        f"""SELECT s.txn_id, s.side, b.value AS country, b.entry_id, b.list_type, b.severity FROM (SELECT id AS txn_id, 'originating' AS side, lower(originating_country) AS v FROM aml_txn UNION ALL SELECT id, 'destination', lower(destination_country) FROM aml_txn) s
        JOIN aml_blacklist b ON b.value = s.v WHERE b.is_active AND (b.expires_at IS NULL OR b.expires_at >= {NOW})""",
    ),
    "blacklist_status": (
        lambda t: L.blacklist_status(t.aml_customer.select("customer_id", F.lit("country").alias("entry_type"), F.concat(F.lit(" "), "country").alias("value")), t.aml_blacklist, AT),
        f"""SELECT c.customer_id, 'country' AS entry_type, ' ' || c.country AS value, b.list_type, b.reason, b.severity FROM aml_customer c LEFT JOIN aml_blacklist b ON b.value = lower(c.country) AND b.is_active AND (b.expires_at IS NULL OR b.expires_at >= {NOW})""",
    ),
    "blacklist_merge": (
        lambda t: L.blacklist_merge(t.aml_blacklist, t.aml_customer.select(F.col("customer_id").alias("entry_id"), F.when(F.col("customer_id") % 7 == 0, "planet").otherwise("country").alias("entry_type"), F.col("country").alias("value"), F.lit("yellow").alias("list_type"), F.lit("new").alias("reason")))[1],
        """SELECT entry_id, 'none' AS from_list, 'yellow' AS to_list, 'new' AS reason FROM (SELECT customer_id AS entry_id, row_number() OVER (PARTITION BY lower(country) ORDER BY customer_id) AS k, lower(country) AS v FROM aml_customer WHERE customer_id % 7 <> 0 AND country IS NOT NULL) x
        WHERE k = 1 AND v NOT IN (SELECT value FROM aml_blacklist WHERE is_active)""",
    ),
    "blacklist_moves": (
        lambda t: L.blacklist_moves(t.aml_blacklist, t.aml_blacklist_move),
        """SELECT b.entry_id, coalesce(m.to_list, b.list_type) AS current_list, coalesce(n, 0) AS moves, moved_at FROM aml_blacklist b LEFT JOIN (SELECT entry_id, arg_max(to_list, created_at) AS to_list, count(*) AS n, max(created_at) AS moved_at FROM aml_blacklist_move GROUP BY 1) m ON m.entry_id = b.entry_id""",
    ),
    "blacklist_history": (
        lambda t: L.blacklist_history(t.aml_blacklist_move),
        "SELECT entry_id, CAST(row_number() OVER (PARTITION BY entry_id ORDER BY created_at DESC, log_id DESC) AS INTEGER) AS place, from_list, to_list, reason, created_at FROM aml_blacklist_move",
    ),
    "blacklist_stats": (
        lambda t: L.blacklist_stats(t.aml_blacklist),
        f"""WITH f AS (SELECT 'total' AS kind, 'all' AS name {' '.join(f"UNION ALL SELECT 'type', '{v}'" for v in L.ENTRY_TYPES)} {' '.join(f"UNION ALL SELECT 'list', '{v}'" for v in L.LIST_TYPES)})
        SELECT kind, name, (SELECT count(*) FROM aml_blacklist b WHERE is_active AND (kind = 'total' OR (kind = 'type' AND entry_type = name) OR (kind = 'list' AND list_type = name))) AS n FROM f""",
    ),
}
