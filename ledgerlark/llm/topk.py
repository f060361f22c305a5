"""Exact top-k search by the threshold algorithm over sorted per-dimension lists.

Candidates are dealt evenly into blocks and queries into blocks; each pair of blocks is one group of rows. In it, the
lists of the candidate block (one per dimension, sorted by component) are read for each query from the end that its sign
favours, step by step; candidates met for the first time are scored in full, and reading stops when the bound on all
unseen candidates cannot reach the k-th best score. The best k of each block are then ranked per query.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions.storage import materialize


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``vec_id`` and the components as floor(scale * x), x as double. Vectors that are null, or hold a null or a component
    that is not finite, take no part; nor do rows with a null id. Repeated rows stay."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(math.inf)))
    rows = df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long")).alias("vec"))


def numbered(vectors: DataFrame) -> DataFrame:
    """``integer_vectors`` with a number ``row`` that tells all rows apart, written: it stays the same however often it is read."""
    return materialize(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors")


def threshold_top(ids: np.ndarray, matrix: np.ndarray, order: np.ndarray, sorted_: np.ndarray, own: np.ndarray, query: np.ndarray, k: int, first: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, scores) for one query, without the rows that ``own`` marks: ``order`` and ``sorted_`` are the rows and values of each dimension's list in
    ascending order. Ties go to the smaller id, so reading stops only when the bound is below the k-th score."""
    n, dims = matrix.shape
    used = np.flatnonzero(query)
    up = query[used] > 0
    seen = np.zeros(n, bool)
    best_ids, best = np.empty(0, np.int64), np.empty(0)
    done, depth = 0, first
    while done < n:
        depth = min(depth, n)
        if len(used):
            rows = np.concatenate([order[n - depth : n - done][:, used[up]].ravel(), order[done:depth][:, used[~up]].ravel()])
        else:
            rows, depth = np.arange(n), n
        fresh = np.zeros(n, bool)
        fresh[rows] = True
        fresh &= ~seen
        seen |= fresh
        at = np.flatnonzero(fresh & ~own)
        if len(at):
            best_ids, best = np.r_[best_ids, ids[at]], np.r_[best, matrix[at] @ query]
            if len(best) > k:
                kth = np.partition(best, len(best) - k)[len(best) - k]
                keep = best >= kth
                best_ids, best = best_ids[keep], best[keep]
                rank = np.lexsort((best_ids, -best))[:k]
                best_ids, best = best_ids[rank], best[rank]
        if seen.all():
            break
        bound = (query[used] * np.where(up, sorted_[n - depth, used], sorted_[depth - 1, used])).sum()
        if len(best) >= k and bound < best.min():
            break
        done, depth = depth, depth * 4
    rank = np.lexsort((best_ids, -best))[:k]
    return best_ids[rank], best[rank]


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = 16384, query_rows: int = 8192, blocks: int | None = None) -> DataFrame:
    """Each query's ``k`` highest integer inner products over all other rows: ``query_id, rank, vec_id, score``.

    Both inputs are ``numbered`` frames (``row``, ``vec_id``, ``vec``). A query is compared with vectors of its own length
    and with every row but itself: rows that repeat it, or have its id and another vector, are candidates like others, and
    queries with one id each have their own ranks. Ties go to the smaller id; with fewer than k candidates, all are
    returned. Empty inputs give no rows. Blocks are even whatever the ids or labels, so no key or copy makes a task larger; a row is sent
    once to each block of queries, of which there is one for every ``query_rows`` queries. Scores are exact: components
    are integers, and sums stay below 2^53 for components under 2^20 and up to 2^13 dimensions.
    """
    n, n_queries = vectors.count(), queries.count()
    rows, cols = blocks or max(12, -(-n // block_rows)), max(1, -(-n_queries // query_rows))
    # Rows have numbers of their own, so copies spread too; and a row has the same block on every attempt of a task.
    even = lambda df, m: df.withColumn("b", F.pmod(F.xxhash64("row"), F.lit(m)).cast("int"))
    key = ["cb", "qb", "dims"]
    # Both sides may read one table; columns of the queries get names of their own, or a later projection loses them.
    left = even(vectors, rows).select(F.col("b").alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("qb"), F.size("vec").alias("dims"), "row", "vec_id", "vec")
    right = even(queries, cols).select(F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("cb"), F.col("b").alias("qb"), F.size("vec").alias("dims"), F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("vec").alias("asked"))

    def search(cands: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(cands) and len(asked):
            ids, rows = cands["vec_id"].to_numpy(), cands["row"].to_numpy()
            matrix = np.stack(cands["vec"].to_list()).astype(np.float64)
            order = np.argsort(matrix, axis=0, kind="stable")
            lists = np.take_along_axis(matrix, order, axis=0)
            for row, query_id, vec in zip(asked["query"], asked["query_id"], asked["asked"], strict=True):
                top, scores = threshold_top(ids, matrix, order, lists, rows == row, np.asarray(vec, np.float64), k)
                found.append(pd.DataFrame({"query": row, "query_id": query_id, "vec_id": top, "score": scores.astype(np.int64)}))
        return pd.concat(found) if found else pd.DataFrame({c: np.empty(0, np.int64) for c in ("query", "query_id", "vec_id", "score")})

    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search, "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_of_every_50th(embeddings: DataFrame) -> DataFrame:
    """The 5 best of every row whose id is divisible by 50; cases as in ``integer_vectors`` and ``exact_top_k``. Vectors
    are written once, as both counts and both sides read them."""
    vectors = numbered(integer_vectors(embeddings))
    return exact_top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


TOP_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.row AS query, q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_inner_product(CAST(q.vec AS DOUBLE[]), CAST(c.vec AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.row <> c.row AND len(q.vec) = len(c.vec)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
