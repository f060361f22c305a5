import numpy as np
from pyspark.sql import functions as F

from ledgerlark.llm.topk import exact_top_k, integer_vectors, numbered, top_of_every_50th


def brute(rows, k):
    out = []
    for n, (q, a) in enumerate(rows):
        if q % 5:
            continue
        best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for m, (i, b) in enumerate(rows) if m != n and len(a) == len(b))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    for spread, dims in ((3, 4), (200, 12), (1, 2), (50, 3000)):
        vecs = [(i, [float(x) / 256 for x in rng.integers(-spread, spread + 1, dims)]) for i in range(160)]
        vecs += [(300 + i, [0.5] * dims) for i in range(40)] + [(300, [0.5] * dims), (400, [0.0] * dims), (401, [1.0] * (dims + 1)), (405, [1.0] * (dims + 1))]
        bad = [(405, None), (410, [float("nan")] * dims), (415, [float("inf")] * dims), (420, [None] * dims), (None, [0.1] * dims)]
        df = integer_vectors(spark.createDataFrame([(*r, 1) for r in vecs + bad], "vec_id long, embedding array<double>, row int"))
        df = numbered(df)
        got = exact_top_k(df, df.filter(F.col("vec_id") % 5 == 0), k=5, block_rows=50, query_rows=20, blocks=4)
        want = brute([(i, [int(np.floor(256 * x)) for x in v]) for i, v in vecs], 5)
        assert sorted(map(tuple, got.collect())) == want


def test_empty(spark):
    df = numbered(integer_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")))
    assert exact_top_k(df, df).count() == 0


def test_blocks_don_t_depend_on_the_order_of_rows(spark):
    df = numbered(integer_vectors(spark.createDataFrame([(i, [float(i)]) for i in range(9)], "vec_id long, embedding array<float>")))
    plan = exact_top_k(df, df)._jdf.queryExecution().analyzed().toString().lower()
    assert "hash" in plan and "monotonically_increasing_id" not in plan and "spark_partition_id" not in plan


def test_repeated_ids_and_rows(spark):
    """Every row but the query's own is a candidate: a copy of it, and a row with its id and another vector."""
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 2.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [-1.0, 0.5])]
    got = top_of_every_50th(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    want = brute([(i if i % 50 == 0 else i * 5 + 1, [int(256 * x) for x in v]) for i, v in rows], 5)
    assert sorted((q, r, i if i == 50 else (i - 1) // 5, s) for q, r, i, s in want) == sorted(map(tuple, got.collect()))
    assert got.count() == 15


def test_copies_spread_over_blocks(spark):
    """A third of all rows may be one vector: its copies meet in no single block."""
    df = numbered(integer_vectors(spark.createDataFrame([(1, [1.0])] * 3000, "vec_id long, embedding array<double>")))
    sizes = [r["count"] for r in df.groupBy(F.pmod(F.xxhash64("row"), F.lit(12))).count().collect()]
    assert len(sizes) == 12 and max(sizes) < 400
