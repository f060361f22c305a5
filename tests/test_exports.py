"""Exports are read back as they were, in their order, and only when committed."""

import datetime as dt
import glob
import random

import pytest

from ledgerlark.operators.listing import enrich_transactions
from ledgerlark.sources.exports import exports, read_export, write_export

SCHEMA = "id long, text string, amount double, ok boolean, at timestamp, day date"


def rows():
    rng, at = random.Random(3), dt.datetime(2024, 2, 3, 4, 5, 6, 789012)
    texts = ["", None, " a ", 'say "hi", all', "two\nlines", '""', "\\", "ä,é", "null", "a\\\"b", "'"]
    return [(i, texts[i % len(texts)], rng.choice([None, rng.random() * 1e9, 0.1]), rng.choice([True, False, None]), at + dt.timedelta(microseconds=i) if i % 5 else None, at.date() if i % 3 else None) for i in range(300)]


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_round_trip_in_order(spark, tmp_path, fmt):
    data, path = rows(), str(tmp_path / "out")
    df = spark.createDataFrame(random.Random(1).sample(data, len(data)), SCHEMA).repartition(7)
    first = write_export(df, path, ["id"], fmt)
    back = read_export(spark, path)
    assert back.schema == df.schema and sorted(map(tuple, back.collect())) == data
    ids = []
    for f in sorted(glob.glob(f"{path}/{first}/data/part-*")):
        ids += [r.id for r in (spark.read.schema(SCHEMA).json(f) if fmt == "json" else spark.read.schema(SCHEMA).options(header=True, multiLine=True, escape='"').csv(f)).collect()]
    assert ids == list(range(300))
    write_export(df.limit(0), path, ["id"], fmt, "z-empty")
    assert exports(spark, path) == [first, "z-empty"] and read_export(spark, path).count() == 0 and read_export(spark, path, first).count() == 300
    odd = spark.createDataFrame([(1, "\\N")], "id long, text string")
    if fmt == "csv":
        with pytest.raises(ValueError, match="json"):
            write_export(odd, path, ["id"], fmt, "odd")
    else:
        write_export(odd, str(tmp_path / "odd"), ["id"], fmt)
        assert read_export(spark, str(tmp_path / "odd")).first().text == "\\N"
    with pytest.raises(FileExistsError):
        write_export(df, path, ["id"], fmt, "z-empty")


def test_half_an_export_is_not_there(spark, tmp_path):
    path = str(tmp_path / "out")
    assert exports(spark, path) == []
    bad = spark.range(50).selectExpr("id", "IF(id = 40, raise_error('lost'), 'x') AS text")
    with pytest.raises(Exception, match="lost"):
        write_export(bad, path, ["id"])
    assert exports(spark, path) == []
    with pytest.raises(FileNotFoundError):
        read_export(spark, path)
    write_export(spark.range(5), path, ["id"], attempt="one")
    (tmp_path / "out" / "one" / "manifest.json").rename(tmp_path / "out" / "one" / "gone")
    assert exports(spark, path) == []


def test_references_of_a_day_count_on(spark):
    at = dt.datetime(2024, 1, 1, 23, 59)
    raw = spark.createDataFrame([(i, 1 if i % 10 else 9, 2, "DE", "FR" if i % 2 else None, at + dt.timedelta(seconds=i // 3)) for i in range(300)], "id long, from_account_id long, to_account_id long, originating_country string, destination_country string, created_at timestamp")
    accounts = spark.createDataFrame([(1, 11), (2, 12)], "account_id long, customer_id long")
    landed, rejected = enrich_transactions(raw, accounts)
    assert rejected.count() == 30 and landed.count() == 270
    got = [r.reference for r in landed.orderBy("created_at", "id").collect()]
    first = sum(1 for i in range(180) if i % 10)
    assert got == [f"TXN-20240101-{k + 1:06d}" for k in range(first)] + [f"TXN-20240102-{k + 1:06d}" for k in range(270 - first)]
