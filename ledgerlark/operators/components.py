"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.storage import discard, materialize

#: Tasks that the edges of one node spread over in a join.
SALTS = 8


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Number of edges and a checksum of them, in one row."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def _with_least(edges: DataFrame, key: str) -> DataFrame:
    """Adds ``m``: the smallest of the smaller neighbours of the node in ``key``, null where it has none. A node may be in
    any share of the edges, so its edges are dealt over ``SALTS`` tasks."""
    least = edges.groupBy(F.col("u").alias(key)).agg(F.min("v").alias("m")).withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("u", "v"), F.lit(SALTS)).cast("int"))
    return salted.join(least, [key, "salt"], "left").select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours; edges come with u > v."""
    return _with_least(edges, "v").select("u", F.coalesce("m", "v").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them; edges come with u > v."""
    both = _with_least(edges, "u")
    moved = both.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(both.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component`` of every node with an edge to another node; the component is its smallest node.

    Undirected; loops, null ends and repeated edges are left out. Each round contracts the graph by a large and a small
    star, so the number of rounds grows with the logarithm of the size, long chains included. Rounds are written to the
    shared folder; only a count and a checksum come to the driver."""
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter(F.col("a") != F.col("b"))
    now = materialize(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components")
    mark = _mark(now)
    while mark[0]:
        after = materialize(_small_star(_large_star(now).distinct()).distinct(), "components")
        last, mark = mark, _mark(after)
        discard(now)
        now = after
        if mark == last:
            break
    roots = now.select(F.col("v").alias("u")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select(F.col("u").alias("node"), F.col("u").alias("component")))
