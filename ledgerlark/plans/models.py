"""Model and session queries over the AML views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.functions.storage import materialize
from ledgerlark.operators import features as X
from ledgerlark.operators import models as M
from ledgerlark.plans.features import _SARF
from ledgerlark.plans.sql import AT, r, total
from ledgerlark.streaming.jobs import customer_sessions


def _risk_scored(t):
    """(scores of all customers with ``held_out`` for the fifth of each class that the fit left out, the training set)"""
    rows = materialize(X.risk_training_set(t.aml_customer, t.aml_txn, t.aml_alert, t.aml_case, AT), "risk-features")
    fit, test = M.held_out(rows, "customer_id")
    return M.predict_risk(M.train_risk_model(fit), rows, unseen=test), rows


def _risk(t):
    return _risk_scored(t)[0]


def _risk_metrics(t):
    scores, rows = _risk_scored(t)
    return X.classification_metrics(scores.filter("held_out").join(rows.select("customer_id", "label"), "customer_id").select("label", F.col("probability").alias("score")))


def _sar(t):
    filed = t.aml_case.filter("sar_filed").select("alert_id", F.lit(1).alias("label"))
    rows = X.sar_features(t.aml_alert, t.aml_customer, t.aml_txn, t.aml_case, AT).join(filed, "alert_id", "left").withColumn("label", F.coalesce("label", F.lit(0)))
    rows = materialize(rows, "sar-features")
    return M.predict_sar(M.train_sar_classifier(rows, X.SAR_FEATURES), rows)


def _descent(features: list[str], rate: str = "0.01E0", epochs: int = 100) -> str:
    """The descent as a recursion over (epoch, bias, weights), and the probabilities of its last state."""
    k = range(len(features))
    each = lambda form: ", ".join(form.format(i=i, c=c) for i, c in enumerate(features))
    z = "b + " + " + ".join(f"x{i} * w{i}" for i in k)
    step = lambda v: f"{rate} * (CAST(sum(CAST(floor({v} * 1E9 + 0.5E0) AS BIGINT)) AS DOUBLE) / 1E9) / n"
    state = "b, " + each("w{i}")
    return f"""WITH RECURSIVE s AS MATERIALIZED (SELECT f.*, coalesce(c.label, 0) AS y FROM ({_SARF}) f LEFT JOIN (SELECT alert_id, 1 AS label FROM aml_case WHERE sar_filed) c ON c.alert_id = f.alert_id),
    m AS MATERIALIZED (SELECT count(*) AS n, {each("CAST(min({c}) AS DOUBLE) AS lo{i}, CAST(max({c}) AS DOUBLE) AS hi{i}")} FROM s),
    x AS MATERIALIZED (SELECT alert_id, y, n, {each("({c} - lo{i}) / (CASE WHEN hi{i} > lo{i} THEN hi{i} - lo{i} ELSE 1E0 END) AS x{i}")} FROM s, m),
    d AS (SELECT 0 AS k, 0E0 AS b, {each("0E0 AS w{i}")} UNION ALL
      SELECT k + 1, b - {step("e")}, {", ".join(f"w{i} - {step(f'x{i} * e')}" for i in k)} FROM (SELECT d.*, x.*, 1E0 / (1E0 + exp(-({z}))) - y AS e FROM d, x WHERE d.k < {epochs}) q GROUP BY k, n, {state})
    SELECT alert_id, probability, CAST(probability >= 0.5E0 AS INTEGER) AS prediction FROM (SELECT alert_id, {r(f"1E0 / (1E0 + exp(-({z})))", 4)} AS probability FROM x, d WHERE d.k = {epochs}) p"""


PLANS = {
    "predict_risk": (_risk, None),
    "risk_model_metrics": (_risk_metrics, None),
    "predict_sar": (_sar, _descent(X.SAR_FEATURES)),
    "anomaly_scores": (lambda t: M.anomaly_scores(t.aml_txn), None),
    "customer_sessions": (
        lambda t: customer_sessions(t.aml_txn, late=None),
        f"""WITH x AS (SELECT from_customer_id AS c, amount, created_at AS t, lag(created_at) OVER (PARTITION BY from_customer_id ORDER BY created_at) AS p FROM aml_txn WHERE amount <= 100),
        y AS (SELECT *, sum(CASE WHEN p IS NULL OR t >= p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY t RANGE UNBOUNDED PRECEDING) AS s FROM x)
        SELECT c AS customer_id, min(t) AS start, max(t) + INTERVAL 30 MINUTE AS "end", count(*) AS n, {total('amount')} AS volume FROM y GROUP BY c, s""",
    ),
}
