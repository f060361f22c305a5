"""Registered queries do the operators' own whole jobs."""

import os

import pytest

from ledgerlark.operators import models
from ledgerlark.plans import features as features_plans
from ledgerlark.plans import models as plans
from ledgerlark.sources.fixtures import Tables

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")


def test_models_train_with_the_defaults(spark, monkeypatch):
    asked = {}

    def keep(name):
        monkeypatch.setattr(models, name, lambda rows, *args, **more: asked.setdefault(name, (len(args), more)))

    for name in ("train_risk_model", "train_sar_classifier", "predict_risk", "predict_sar"):
        keep(name)
    t = Tables(spark, DATA)
    plans._risk(t)
    plans._sar(t)
    assert asked["train_risk_model"] == (0, {}) and asked["train_sar_classifier"] == (1, {})


def test_training_set_sees_all_of_500_and_200_rows(spark):
    t = Tables(spark, DATA)
    rows = {n: {r.customer_id: r for r in features_plans.PLANS[n][0](t).collect()} for n in ("risk_training_set_whole", "risk_model_features")}
    # No customer here has more rows than the defaults keep, so nothing may be left out.
    assert all(rows["risk_training_set_whole"][k].txn_count == r.txn_count and rows["risk_training_set_whole"][k].alert_count == r.alert_count for k, r in rows["risk_model_features"].items())
    assert max(r.txn_count for r in rows["risk_training_set_whole"].values()) > 50
