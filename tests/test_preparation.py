"""A preparation that is saved, loaded and applied to rows that it has not seen."""

import pytest

from ledgerlark.operators.preparation import Preparation, fit_preparation, impute_encode_scale

ROWS = [(1, 10.0, "b", "x", 5), (2, None, "a", None, 5), (3, 30.0, None, "x", 5), (4, 20.0, "b", "y", 5), (4, 20.0, "b", "y", 5)]
SCHEMA = "id long, pay double, land string, job string, code long"


def test_fit_save_load_transform(spark, tmp_path):
    fit = fit_preparation(spark.createDataFrame(ROWS, SCHEMA), ["pay"], ["land", "job"])
    assert [tuple(r) for r in fit.numbers.collect()] == [("pay", 20.0, 10.0, 30.0)]
    assert sorted(tuple(r) for r in fit.codes.collect()) == [("job", "x", 2, 0), ("job", "y", 2, 1), ("land", "a", 1, 0), ("land", "b", 3, 1)]
    fit.save(str(tmp_path / "v1"))
    with pytest.raises(Exception, match="already exists"):
        fit.save(str(tmp_path / "v1"))
    again = Preparation.load(spark, str(tmp_path / "v1"))
    unseen = spark.createDataFrame([(7, 99.0, "zz", "y", 1), (8, None, None, None, 1), (9, -5.0, "a", "q", 1), (None, 15.0, "", "x", 1)], SCHEMA)
    got = {tuple(r) for r in again.transform(unseen, "id", ["pay"], ["land", "job"]).collect()}
    assert got == {(7, 1.0, 2, 1), (8, 0.5, 1, 0), (9, 0.0, 0, 2), (None, 0.25, 2, 0)}
    with pytest.raises(ValueError):
        again.transform(unseen, "id", ["code"], [])


def test_empty_and_missing_columns(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    rows, fit = impute_encode_scale(df.limit(0), "id", ["pay"], ["land"])
    assert rows.count() == 0 and [tuple(r) for r in fit.numbers.collect()] == [("pay", None, None, None)]
    assert {(r.pay, r.land_code) for r in fit.transform(df, "id", ["pay"], ["land"]).collect()} == {(0.0, 0)}
    rows, _ = impute_encode_scale(df, "id", ["pay"], [])
    assert sorted(r.pay for r in rows.collect()) == [0.0, 0.5, 0.5, 0.5, 1.0]
