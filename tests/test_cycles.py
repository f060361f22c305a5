"""Cycles against a search in plain Python, and around a hub."""

import random

from ledgerlark.operators.network import graph_cycles


def brute(pairs, most):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    found = set()

    def go(path):
        for n in out.get(path[-1], ()):
            if n == path[0] and len(path) > 1:
                found.add((len(path), ",".join(map(str, sorted(path)))))
            elif n > path[0] and n not in path and len(path) < most:
                go([*path, n])

    for a in out:
        go([a])
    return found


def cycles(spark, pairs, most=5):
    return {(r.length, r.nodes) for r in graph_cycles(spark.createDataFrame(pairs, "src long, dst long"), most).collect()}


def test_random_graphs_equal_brute_force(spark):
    rng = random.Random(8)
    for nodes, n, most in ((7, 20, 5), (25, 60, 4)):
        pairs = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)]
        clean = {(a, b) for a, b in pairs if a != b}
        assert cycles(spark, [*pairs, *pairs[:5], (None, 1), (1, None)], most) == brute(clean, most)
    assert graph_cycles(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_a_hub_is_not_passed_through(spark):
    """Every partner sends to and gets from the hub: 4 * 10^8 paths go through it, and only its own cycles close."""
    n = 20_000
    pairs = spark.range(1, n + 1).selectExpr("inline(array(struct(0L AS src, id AS dst), struct(id AS src, 0L AS dst)))")
    ring = spark.range(1, n, 1000).selectExpr("id AS src", "id + 1 AS dst")
    got = graph_cycles(pairs.unionByName(ring)).groupBy("length").count().collect()
    assert {r.length: r["count"] for r in got} == {2: n, 3: n // 1000}
