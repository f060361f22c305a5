"""Running sums and medians against plain Python."""

import random
import statistics
from itertools import accumulate

import numpy as np
from pyspark.sql import functions as F

from ledgerlark.functions.order import median, quantiles, running


def test_running_sums_in_both_directions(spark):
    rng = random.Random(2)
    rows = [(x, rng.randrange(9)) for x in rng.sample(range(-5000, 5000), 3000)] + [(10**9, None)]
    df = spark.createDataFrame(rows, "x long, n long").repartition(7)
    for order, back in ((F.col("x"), False), (F.desc("x"), True)):
        got = sorted((r.x, r.upto) for r in running(df, order, upto="n").collect())
        want = sorted(rows, reverse=back)
        assert got == sorted(zip((x for x, _ in want), accumulate(n or 0 for _, n in want), strict=True))
    assert running(df.limit(0), F.col("x"), upto="n").count() == 0


def test_median(spark):
    rng = random.Random(3)
    for n in (1, 2, 3, 100, 777):
        xs = [rng.choice([rng.random(), 0.5, -2.0]) for _ in range(n)]
        df = spark.createDataFrame([(x,) for x in xs] + [(None,)] * 3, "x double")
        assert abs(median(df, "x").first()[0] - statistics.median(xs)) < 1e-12
    assert median(spark.createDataFrame([(None,)], "x double"), "x").first()[0] is None


def test_quantiles_of_groups(spark):
    rng = random.Random(5)
    groups = {1: [rng.random() for _ in range(3000)], 2: [4.0], 3: [rng.choice([1.0, 2.0, 7.5]) for _ in range(501)], None: [rng.gauss(0, 1) for _ in range(40)], 4: [1.0, 3.0]}
    rows = [(k, x, "x") for k, xs in groups.items() for x in xs] + [(1, None, "x"), (9, None, "x")]
    df = spark.createDataFrame(rows, "who long, x double, _v string").repartition(5)
    got = {r.who: (r.half, r.top, r.least, r.most) for r in quantiles(df, "who", "x", half=0.5, top=0.95, least=0.0, most=1.0).collect()}
    assert got.keys() == groups.keys()
    for k, xs in groups.items():
        assert np.allclose(got[k], np.quantile(xs, [0.5, 0.95, 0, 1]), rtol=1e-12) and got[k][0] == statistics.median(xs)
    assert quantiles(df.limit(0), "who", "x", half=0.5).count() == 0
