"""Feature and metric queries over the AML views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.operators import features as X
from ledgerlark.operators.preparation import fit_preparation, impute_encode_scale
from ledgerlark.plans.network import _SD, _SQ
from ledgerlark.plans.risk import _case, _in
from ledgerlark.plans.sql import AT, NOW, cnt, r, total


def _h(n: int) -> str:
    return f"created_at >= {NOW} - INTERVAL {n} HOUR"


def _ratio(a: str, b: str, n: int = 3) -> str:
    return f"CASE WHEN {b} > 0 THEN {r(f'{a} / {b}', n)} ELSE 0E0 END"


_RISKY = f"(coalesce(originating_country IN {_in(X.HIGH)}, false) OR coalesce(destination_country IN {_in(X.HIGH)}, false))"
_WIN = {"1h": 1, "24h": 24, "7d": 168, "30d": 720}
_DAYS = "floor((epoch_us({}) - epoch_us({})) / 86400E6)"
_Z = lambda x: f"coalesce(CAST({x} AS DOUBLE), 0E0)"
_FEATURES = f"""WITH t AS (SELECT from_customer_id AS c, count(*) AS n, {_SQ}, max(amount) AS mx, min(amount) AS mn, median(amount) AS md, {cnt('amount >= 10000')} AS lg, {cnt('amount >= 8000 AND amount < 10000')} AS st, {cnt('amount >= 1000 AND amount % 1000 = 0')} AS rd,
  {', '.join(f"{cnt(_h(h))} AS count_{k}, {total('amount', _h(h))} AS volume_{k}" for k, h in _WIN.items())}, {cnt('hour(created_at) < 6 OR hour(created_at) >= 22')} AS night, {cnt('isodow(created_at) >= 6')} AS wk, CAST(sum(hour(created_at)) AS DOUBLE) AS hs, {cnt('hour(created_at) BETWEEN 9 AND 17')} AS bz,
  count(DISTINCT originating_country) AS oc, count(DISTINCT destination_country) AS dc, {cnt(_RISKY)} AS hr, {cnt('is_international')} AS il FROM aml_txn GROUP BY 1),
a AS (SELECT customer_id AS c, count(*) AS ac, {cnt(f'created_at >= {NOW} - INTERVAL 90 DAY')} AS a9, {cnt("severity = 'critical'")} AS cr, {cnt("severity = 'high'")} AS hi, {cnt("status = 'open'")} AS op, sum({_case('severity', X.SEVERITY_WEIGHT, 0)}) AS sv, max(created_at) AS la FROM aml_alert GROUP BY 1)
SELECT u.customer_id, {_case('risk_level', X.LEVEL_CODE, 0)} AS risk_level_code, CAST(pep_status AS DOUBLE) AS is_pep, CAST(sanctions_flag AS DOUBLE) AS is_sanctioned,
  CASE WHEN coalesce(country IN {_in(X.HIGH)}, false) OR coalesce(nationality IN {_in(X.HIGH)}, false) THEN 2E0 WHEN coalesce(country IN {_in(X.MEDIUM)}, false) OR coalesce(nationality IN {_in(X.MEDIUM)}, false) THEN 1E0 ELSE 0E0 END AS country_risk_code,
  least(3650E0, {_DAYS.format(NOW, 'u.created_at')}) AS account_age_days, {r('ln(1E0 + coalesce(annual_income, 0E0))', 6)} AS log_annual_income, CASE WHEN coalesce(id_number, '') <> '' THEN 1E0 ELSE 0E0 END AS has_id_document,
  {_Z(r('s / n'))} AS amount_mean, {_Z(r(_SD))} AS amount_std, {_Z('mx')} AS amount_max, {_Z('mn')} AS amount_min, {_Z(r('md'))} AS amount_median, coalesce(CASE WHEN ({_SD}) > 0 THEN {r(f'(s / n - md) * 3E0 / ({_SD})', 4)} END, 0E0) AS amount_skew,
  {_Z('lg')} AS large_txn_count, {_Z('st')} AS structuring_count, {_Z('rd')} AS round_amount_count, {', '.join(f"{_Z(f'count_{k}')} AS count_{k}, {_Z(f'volume_{k}')} AS volume_{k}" for k in _WIN)}, {_ratio('night', 'n')} AS night_txn_ratio, {_ratio('wk', 'n')} AS weekend_txn_ratio, coalesce({r('hs / n')}, 12E0) AS avg_hour_of_day, {_ratio('bz', 'n')} AS business_hours_ratio,
  {_Z('oc')} AS originating_countries, {_Z('dc')} AS destination_countries, {_Z('hr')} AS high_risk_country_txns, {_ratio('hr', 'n')} AS high_risk_country_ratio, {_ratio('il', 'n')} AS international_ratio,
  {_Z('ac')} AS alert_count, {_Z('a9')} AS alert_count_90d, {_Z('cr')} AS critical_alerts, {_Z('hi')} AS high_alerts, {_Z('op')} AS open_alerts, {_Z('sv')} AS alert_severity_score, least(999E0, coalesce({_DAYS.format(NOW, 'la')}, 999E0)) AS days_since_last_alert
FROM aml_customer u LEFT JOIN t ON t.c = u.customer_id LEFT JOIN a ON a.c = u.customer_id"""


def _risk(txn: str = "aml_txn", alert: str = "aml_alert", days: int = 180) -> str:
    since = f"created_at >= {NOW} - INTERVAL {days} DAY"
    risky = f"coalesce(upper(country) IN {_in(X.RISK_HIGH)}, false) OR coalesce(upper(nationality) IN {_in(X.RISK_HIGH)}, false)"
    return f"""SELECT u.customer_id, {_Z('n')} AS txn_count, {r(f"ln(1E0 + {_Z('s')})", 6)} AS log_total_amount, CASE WHEN n > 0 THEN {r('ln(1E0 + s / n)', 6)} ELSE 0E0 END AS log_avg_amount,
    {r(f"{_Z('n')} / ({days}E0 / 7E0)", 3)} AS txn_velocity_per_week, {_ratio('f', 'n')} AS flag_ratio, {_ratio('i', 'n')} AS intl_ratio, {_Z('ac')} AS alert_count, {_Z('cr')} AS critical_alerts,
    {_Z('cr')} * 4E0 + {_Z('hi')} * 2E0 + {_Z('ac')} AS alert_severity_score, {_case('risk_level', X.LEVEL_CODE, 0)} AS risk_level_code,
    CAST(coalesce(pep_status, false) AS DOUBLE) AS is_pep, CAST(coalesce(sanctions_flag, false) AS DOUBLE) AS is_sanctioned, CASE WHEN {risky} THEN 1E0 ELSE 0E0 END AS is_high_risk_country,
    least(3650E0, coalesce({_DAYS.format(NOW, 'u.created_at')}, 365E0)) AS account_age_days
    FROM aml_customer u
    LEFT JOIN (SELECT from_customer_id AS c, count(*) AS n, {total('amount')} AS s, {cnt('flagged')} AS f, {cnt('is_international')} AS i FROM {txn} WHERE {since} GROUP BY 1) t ON t.c = u.customer_id
    LEFT JOIN (SELECT customer_id AS c, count(*) AS ac, {cnt("severity = 'critical'")} AS cr, {cnt("severity = 'high'")} AS hi FROM {alert} WHERE {since} GROUP BY 1) a ON a.c = u.customer_id"""


_TRAIN = f"""WITH lt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY from_customer_id ORDER BY created_at DESC, id DESC) AS rk FROM aml_txn) x WHERE rk <= 500), la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, alert_id DESC) AS rk FROM aml_alert) x WHERE rk <= 200),
f AS ({_risk('lt', 'la')}) SELECT f.*, CAST(f.customer_id IN (SELECT a.customer_id FROM aml_case c JOIN aml_alert a ON a.alert_id = c.alert_id WHERE c.status IN ('escalated', 'closed')) AS INTEGER) AS label FROM f"""
_SAR_RISKY = f"(coalesce(originating_country IN {_in(X.SAR_HIGH)}, false) OR coalesce(destination_country IN {_in(X.SAR_HIGH)}, false))"
_SARF = f"""WITH j AS (
  SELECT a.alert_id, t.*, row_number() OVER w AS k, count(*) OVER (PARTITION BY a.alert_id) AS c
  FROM aml_alert a JOIN aml_txn t ON t.from_customer_id = a.customer_id AND t.created_at <= a.created_at AND t.created_at >= a.created_at - INTERVAL 30 DAY
  WINDOW w AS (PARTITION BY a.alert_id ORDER BY t.created_at, t.id)
), g AS (
  SELECT alert_id, count(*) AS c, {cnt('amount <> 0')} AS n, {_SQ}, max(amount) FILTER (WHERE amount <> 0) AS m, {cnt('flagged')} AS f, {cnt('is_international')} AS i, {cnt(_SAR_RISKY)} AS h,
    {cnt('hour(created_at) < 8 OR hour(created_at) >= 20')} AS o, count(DISTINCT CASE WHEN destination_country <> '' THEN destination_country END) AS u,
    {total('amount', 'k <= floor(c / 2)')} AS early, {total('amount', 'k > floor(c / 2)')} AS late
  FROM j GROUP BY 1
), pa AS (
  SELECT a.alert_id, count(*) AS pa FROM aml_alert a JOIN aml_alert b ON b.customer_id = a.customer_id AND b.created_at < a.created_at GROUP BY 1
), pc AS (
  SELECT a.alert_id, count(*) AS pc FROM aml_alert a JOIN aml_alert b ON b.customer_id = a.customer_id JOIN aml_case x ON x.alert_id = b.alert_id AND x.created_at < a.created_at GROUP BY 1
)
SELECT a.alert_id, {_case('lower(severity)', X.SAR_CODE, 1)} AS severity_score, coalesce(risk_score, 0E0) AS alert_risk_score,
  greatest(0E0, {r(f'(epoch_us({NOW}) - epoch_us(a.created_at)) / 3.6E9')}) AS alert_age_hours, {_case('lower(risk_level)', X.SAR_CODE, 1)} AS customer_risk_score,
  CAST(coalesce(pep_status, false) AS DOUBLE) AS is_pep, CAST(coalesce(sanctions_flag, false) AS DOUBLE) AS has_sanctions, {_Z('c')} AS txn_count_30d, {_Z('s')} AS total_amount_30d,
  {_Z('f')} AS flagged_count_30d, {_ratio('f', 'c', 4)} AS flagged_ratio_30d, {_ratio('i', 'c', 4)} AS is_international, {_Z('h')} AS high_risk_country_txns,
  CASE WHEN n > 0 THEN {r('s / n')} ELSE 0E0 END AS mean_txn_amount, {_Z(r('m'))} AS max_txn_amount, {_Z(r(_SD))} AS std_txn_amount, {_ratio('o', 'c', 4)} AS off_hours_ratio,
  {_Z('u')} AS unique_countries, {_Z('pa')} AS prior_alerts_count, {_Z('pc')} AS prior_cases_count, CASE WHEN c >= 4 AND early > 0 THEN {r('late / early', 4)} ELSE 1E0 END AS txn_velocity_change
FROM aml_alert a LEFT JOIN aml_customer v ON v.customer_id = a.customer_id LEFT JOIN g ON g.alert_id = a.alert_id LEFT JOIN pa ON pa.alert_id = a.alert_id LEFT JOIN pc ON pc.alert_id = a.alert_id"""


def _s(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN {r(f'({a}) / ({b})', 4)} ELSE 0E0 END"


def _metrics(scored: str, mark: str = "0.5E0") -> str:
    return f"""SELECT *, CASE WHEN f1 >= 0.9 THEN 'A' WHEN f1 >= 0.8 THEN 'B' WHEN f1 >= 0.7 THEN 'C' WHEN f1 >= 0.6 THEN 'D' ELSE 'F' END AS grade FROM (SELECT *, {_s('tp + tn', 'tp + fp + tn + fn')} AS accuracy, {_s('tp', 'tp + fp')} AS precision, {_s('tp', 'tp + fn')} AS recall, {_s('tn', 'tn + fp')} AS specificity, {_s('fp', 'fp + tn')} AS fpr, {_s('fn', 'fn + tp')} AS fnr, {_s('2 * tp', '2 * tp + fp + fn')} AS f1
    FROM (SELECT {cnt(f'score >= {mark} AND label = 1')} AS tp, {cnt(f'score >= {mark} AND label <> 1')} AS fp, {cnt(f'score < {mark} AND label <> 1')} AS tn, {cnt(f'score < {mark} AND label = 1')} AS fn FROM {scored}) c) m"""


_OTHER = "(SELECT row_id, label, CAST((row_id * 53 + label * 35) % 101 AS DOUBLE) / 100 AS score FROM aml_scored)"
_SWEEP = " UNION ALL ".join(f"SELECT {k / 10}E0 AS threshold, {_s('tp', 'tp + fp')} AS precision, {_s('tp', 'tp + fn')} AS recall, {_s('2 * tp', '2 * tp + fp + fn')} AS f1, {r('(tp + fp) * 100E0 / n')} AS flagged_pct FROM (SELECT count(*) AS n, {cnt(f'score >= {k / 10}E0 AND label = 1')} AS tp, {cnt(f'score >= {k / 10}E0 AND label <> 1')} AS fp, {cnt(f'score < {k / 10}E0 AND label = 1')} AS fn FROM aml_scored) x" for k in range(1, 10))


def _prep(t):
    return impute_encode_scale(t.aml_customer, "customer_id", ["annual_income"], ["nationality", "occupation"])[0]


def _prep_halves(t):
    half = F.col("customer_id") % 2 == 0
    numbers, words = ["annual_income"], ["nationality", "occupation"]
    return fit_preparation(t.aml_customer.filter(half), numbers, words).transform(t.aml_customer, "customer_id", numbers, words)


def _code(column: str, value: str) -> str:
    """Code of a word among those that were fitted; else how many there are."""
    word = f"(SELECT {column} AS v, count(*) AS n, row_number() OVER (ORDER BY {column}) - 1 AS code FROM h WHERE {column} IS NOT NULL GROUP BY 1)"
    return f"(SELECT coalesce(max(code) FILTER (WHERE v = coalesce({value}, (SELECT v FROM {word} b ORDER BY n DESC, v LIMIT 1))), count(*)) FROM {word} a)"


_HALVES = f"""WITH h AS (SELECT * FROM aml_customer WHERE customer_id % 2 = 0), m AS (SELECT median(annual_income) AS md, min(annual_income) AS lo, max(annual_income) AS hi FROM h)
SELECT customer_id, CASE WHEN hi > lo THEN {r('least(1E0, greatest(0E0, (coalesce(annual_income, md) - lo) / (hi - lo)))', 6)} ELSE 0E0 END AS annual_income, {_code('nationality', 'c.nationality')} AS nationality_code, {_code('occupation', 'c.occupation')} AS occupation_code FROM aml_customer c, m"""


PLANS = {
    "customer_features": (lambda t: X.customer_features(t.aml_customer, t.aml_txn, t.aml_alert, AT), _FEATURES),
    "risk_model_features": (lambda t: X.risk_model_features(t.aml_customer, t.aml_txn, t.aml_alert, AT), _risk()),
    "risk_training_set": (lambda t: X.risk_training_set(t.aml_customer, t.aml_txn, t.aml_alert, t.aml_case, AT), _TRAIN),
    "risk_training_set_whole": (lambda t: X.risk_training_set(t.aml_customer, t.aml_txn, t.aml_alert, t.aml_case, AT), _TRAIN),
    "sar_features": (lambda t: X.sar_features(t.aml_alert, t.aml_customer, t.aml_txn, t.aml_case, AT), _SARF),
    "time_features": (
        lambda t: X.time_features(t.aml_txn),
        "SELECT id, CAST(hour(created_at) AS INTEGER) AS hour, CAST(isodow(created_at) - 1 AS INTEGER) AS weekday, CAST(month(created_at) AS INTEGER) AS month, CAST(isodow(created_at) >= 6 AS INTEGER) AS is_weekend, CAST(hour(created_at) < 8 OR hour(created_at) >= 20 AS INTEGER) AS is_off_hours FROM aml_txn",
    ),
    "impute_encode_scale": (
        _prep,
        f"""WITH m AS (SELECT median(annual_income) AS md FROM aml_customer), f AS (SELECT customer_id, coalesce(annual_income, md) AS x, coalesce(nationality, (SELECT nationality FROM aml_customer WHERE nationality IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS na, occupation FROM aml_customer, m),
        g AS (SELECT min(x) AS lo, max(x) AS hi FROM f), c AS (SELECT nationality AS v, row_number() OVER (ORDER BY nationality) - 1 AS code FROM (SELECT DISTINCT nationality FROM aml_customer WHERE nationality IS NOT NULL) z), o AS (SELECT occupation AS v, row_number() OVER (ORDER BY occupation) - 1 AS code FROM (SELECT DISTINCT occupation FROM aml_customer) z)
        SELECT customer_id, {r('(x - lo) / (hi - lo)', 6)} AS annual_income, c.code AS nationality_code, o.code AS occupation_code FROM f JOIN c ON c.v = f.na JOIN o ON o.v = f.occupation, g""",
    ),
    "prepare_unseen": (_prep_halves, _HALVES),
    "outliers_iqr": (
        lambda t: X.outliers(t.aml_txn, "id", "amount"),
        "WITH s AS (SELECT amount, row_number() OVER (ORDER BY amount) - 1 AS k, count(*) OVER () AS n FROM aml_txn), q AS (SELECT min(amount) FILTER (WHERE k = n // 4) AS a, min(amount) FILTER (WHERE k = 3 * n // 4) AS b FROM s) SELECT id, amount FROM aml_txn, q WHERE amount < a - (b - a) * 1.5E0 OR amount > b + (b - a) * 1.5E0",
    ),
    "outliers_z": (
        lambda t: X.outliers(t.aml_txn, "id", "amount", "z"),
        f"WITH f AS (SELECT s / n AS m, {_SD} AS d FROM (SELECT count(*) AS n, {_SQ} FROM aml_txn) x) SELECT id, amount FROM aml_txn, f WHERE abs(amount - m) / d > 3",
    ),
    "classification_metrics": (lambda t: X.classification_metrics(t.aml_scored), _metrics("aml_scored")),
    "ranking_metrics": (
        lambda t: X.ranking_metrics(t.aml_scored),
        f"""WITH g AS (SELECT score, count(*) AS n, sum(CAST(label = 1 AS INTEGER)) AS p FROM aml_scored GROUP BY 1), w AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn, sum(p) OVER () AS tp, sum(n) OVER () AS tn FROM g)
        SELECT {r('sum((n - p) * (cp - p) + (n - p) * p / 2E0) / (max(tp) * (max(tn) - max(tp)))', 6)} AS roc_auc, {r('CAST(sum(CAST(p / tp * (cp / cn) AS DECIMAL(38,12))) AS DOUBLE)', 6)} AS average_precision FROM w""",
    ),
    "threshold_sweep": (lambda t: X.threshold_sweep(t.aml_scored), _SWEEP),
    "compare_models": (
        lambda t: X.compare_models(t.aml_scored, t.aml_scored.withColumn("score", ((F.col("row_id") * 53 + F.col("label") * 35) % 101).cast("double") / 100)),
        f"WITH a AS ({_metrics('aml_scored')}), b AS ({_metrics(_OTHER + ' y')}) " + " UNION ALL ".join(f"SELECT '{k}' AS metric, a.{k} AS a, b.{k} AS b, CASE WHEN b.recall > a.recall THEN 'B' ELSE 'A' END AS recommended, {r(f'b.{k} - a.{k}', 4)} AS delta, CASE WHEN b.{k} > a.{k} THEN 'B' WHEN a.{k} > b.{k} THEN 'A' ELSE 'tie' END AS winner FROM a, b" for k in ("accuracy", "precision", "recall", "f1")),
    ),
}
