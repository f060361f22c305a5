"""Models: gradient-boosted risk, a logistic classifier by exact full-batch descent, and per-customer isolation forests."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.columns import rounded
from ledgerlark.functions.order import quantiles, running
from ledgerlark.functions.storage import materialize
from ledgerlark.operators.features import RISK_FEATURES, classification_metrics
from ledgerlark.operators.risk import band, points

# Features of the forests and codes of transaction types and channels (others: 0).
FOREST_FEATURES = ["log_amount", "hour", "weekday", "is_international", "is_round", "type_code", "channel_code"]
TYPE_CODE = {"transfer": 1, "deposit": 2, "withdrawal": 3, "wire": 4, "payment": 5, "cash": 6}
CHANNEL_CODE = {"online": 1, "branch": 2, "atm": 3, "mobile": 4}


def train_risk_model(rows: DataFrame, features: list[str] = RISK_FEATURES, trees: int = 100, seed: int = 42) -> PipelineModel:
    """Scaler and gradient boosting over a frame with ``label``; at least 20 rows."""
    if rows.limit(20).count() < 20:
        raise ValueError("at least 20 rows are needed")
    steps = [VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True), GBTClassifier(featuresCol="_x", labelCol="label", maxIter=trees, stepSize=0.1, maxDepth=4, seed=seed)]
    return Pipeline(stages=steps).fit(rows)


def predict_risk(model: PipelineModel, rows: DataFrame, key: str = "customer_id", unseen: DataFrame | None = None) -> DataFrame:
    """``key, probability, band``; with ``unseen``, the keys that the fit left out, also ``held_out``."""
    p = vector_to_array("probability")[1]
    scores = model.transform(rows).select(key, rounded(p, 4).alias("probability")).withColumn("band", band(F.col("probability"), (0.75, 0.50, 0.25)))
    if unseen is None:
        return scores
    left_out = unseen.select(key).distinct().withColumn("held_out", F.lit(True))
    return scores.join(left_out, key, "left").withColumn("held_out", F.coalesce("held_out", F.lit(False)))


def top_importances(model: PipelineModel, features: list[str] = RISK_FEATURES, n: int = 5) -> list[tuple[str, float]]:
    weights = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, weights.tolist(), strict=True), key=lambda x: -x[1])[:n]


@dataclass
class Logistic:
    """Weights over min-max scaled features; scoring is a column expression."""

    features: list[str]
    low: list[float]
    span: list[float]
    weights: list[float]
    bias: float

    def probability(self) -> Column:
        terms = ((F.col(c) - lo) / sp * w for c, lo, sp, w in zip(self.features, self.low, self.span, self.weights, strict=True))
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(self.bias))))

    def importances(self) -> list[tuple[str, float]]:
        return sorted(zip(self.features, map(abs, self.weights), strict=True), key=lambda x: -x[1])


def train_sar_classifier(rows: DataFrame, features: list[str], rate: float = 0.01, epochs: int = 100) -> Logistic:
    """Logistic regression by full-batch descent from zero. An epoch is one aggregate of the gradient over a written
    frame; only as many sums as there are features come back. Weights come in as a frame of one row, so all epochs are
    the same plan and its code is compiled once. Gradients are summed as whole billionths: any order of rows gives the
    same model. A null feature counts as the least value; without rows, all weights are 0."""
    spark = rows.sparkSession
    fit = rows.agg(*(x for c in features for x in (F.min(c).cast("double").alias(f"{c}_lo"), F.max(c).cast("double").alias(f"{c}_hi")))).first()
    low = [fit[f"{c}_lo"] or 0.0 for c in features]
    span = [((fit[f"{c}_hi"] or 0.0) - lo) or 1.0 for c, lo in zip(features, low, strict=True)]
    places = range(len(features))
    values = [F.coalesce((F.col(c) - lo) / sp, F.lit(0.0)).alias(f"x{i}") for i, (c, lo, sp) in enumerate(zip(features, low, span, strict=True))]
    scaled = materialize(rows.select(*values, F.col("label").cast("double").alias("y")), "descent")
    n, weights, bias = max(1, scaled.count()), [0.0] * len(features), 0.0
    z = reduce(lambda a, b: a + b, (F.col(f"x{i}") * F.col(f"w{i}") for i in places), F.col("b"))
    error = (1 / (1 + F.exp(-z)) - F.col("y")).alias("e")
    parts = lambda v: F.sum(F.floor(v * 1e9 + 0.5).cast("decimal(20,0)"))
    gradient = [parts(F.col("e")).alias("b"), *(parts(F.col(f"x{i}") * F.col("e")).alias(f"g{i}") for i in places)]
    model = "b double, " + ", ".join(f"w{i} double" for i in places)
    for _ in range(epochs):
        now = spark.createDataFrame([(bias, *weights)], model)
        sums = scaled.crossJoin(F.broadcast(now)).select(*(f"x{i}" for i in places), error).agg(*gradient).first()
        weights = [w - rate * (float(sums[f"g{i}"] or 0) / 1e9) / n for i, w in enumerate(weights)]
        bias -= rate * (float(sums["b"] or 0) / 1e9) / n
    return Logistic(features, low, span, weights, bias)


def predict_sar(model: Logistic, rows: DataFrame, key: str = "alert_id") -> DataFrame:
    return rows.select(key, rounded(model.probability(), 4).alias("probability")).withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))


def stratified_folds(rows: DataFrame, key: str, k: int = 5, label: str = "label") -> DataFrame:
    """``rows`` with ``_fold`` from 0 to k - 1: rows of a class in the order of a hash of their key, dealt in turn, so folds
    of a class differ by one row at most. Rows are numbered by running counts over sorted ranges, never a class in one task.
    ``key`` has to tell rows apart; a null label is a class of its own."""
    places = [F.col(label), F.xxhash64(key), F.col(key)]
    placed = running(rows.withColumn("_one", F.lit(1).cast("long")), places, _k="_one")
    first = placed.groupBy(F.col(label).alias("_label")).agg(F.min("_k").alias("_first"))
    dealt = placed.join(first, F.col(label).eqNullSafe(F.col("_label")))
    return dealt.withColumn("_fold", ((F.col("_k") - F.col("_first")) % k).cast("int")).drop("_one", "_k", "_label", "_first")


def held_out(rows: DataFrame, key: str, share: int = 5, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(rows to fit on, rows to test with): every ``share``-th row of each class is left out of the fit."""
    dealt = materialize(stratified_folds(rows, key, share, label), "split")
    return dealt.filter(F.col("_fold") != 0).drop("_fold"), dealt.filter(F.col("_fold") == 0).drop("_fold")


def cross_validate(rows: DataFrame, fit, key: str, k: int = 5, threshold: float = 0.5) -> DataFrame:
    """Over stratified folds. ``fit(train)`` returns a function from rows to ``key, score``. Mean, population deviation,
    least and most of four metrics."""
    dealt = materialize(stratified_folds(rows, key, k), "folds")
    results = []
    for fold in range(k):
        score = fit(dealt.filter(F.col("_fold") != fold).drop("_fold"))
        test = dealt.filter(F.col("_fold") == fold)
        results.append(classification_metrics(test.select(key, "label").join(score(test), key), threshold))
    every = materialize(reduce(DataFrame.unionByName, results), "scores")
    metrics = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("accuracy", "precision", "recall", "f1")))).alias("x")
    return every.select(metrics).select("x.*").groupBy("metric").agg(rounded(F.avg("v"), 4).alias("mean"), rounded(F.stddev_pop("v"), 4).alias("std"), F.min("v").alias("least"), F.max("v").alias("most"))


def isolation_scores(x: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 42, pool: np.ndarray | None = None) -> np.ndarray:
    """2^(-mean depth / expected depth) of each row in ``trees`` random trees, grown level by level, all trees at once.
    Trees are fitted on ``pool``, or on the rows themselves."""
    pool = x if pool is None else pool
    rng, n, fitted = np.random.default_rng(seed), len(x), len(pool)
    size = min(sample, fitted)
    limit = int(np.ceil(np.log2(max(size, 2))))
    width = 2 ** (limit + 1)
    expected = lambda m: np.where(m > 2, 2 * (np.log(np.maximum(m - 1, 1)) + 0.5772156649) - 2 * (m - 1) / np.maximum(m, 1), np.where(m == 2, 1.0, 0.0))
    xs = pool[np.concatenate([rng.choice(fitted, size, replace=False) for _ in range(trees)])]
    base, node, live = np.repeat(np.arange(trees) * width, size), np.zeros(trees * size, np.int64), np.arange(trees * size)
    feature, cut, count = np.full(trees * width, -1), np.zeros(trees * width), np.zeros(trees * width)
    for level in range(limit + 1):
        if not len(live):
            break
        live = live[np.argsort(base[live] + node[live], kind="stable")]
        key = base[live] + node[live]
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        low, high = np.minimum.reduceat(xs[live], heads), np.maximum.reduceat(xs[live], heads)
        held = np.diff(np.r_[heads, len(live)])
        count[key[heads]] = held
        open_ = (high > low) & (level < limit)
        f = np.where(open_.any(axis=1), (rng.random(open_.shape) * open_).argmax(axis=1), -1)
        at = np.arange(len(heads))
        feature[key[heads]], cut[key[heads]] = f, low[at, f] + (high[at, f] - low[at, f]) * rng.random(len(heads))
        live, key = live[np.repeat(f >= 0, held)], key[np.repeat(f >= 0, held)]
        node[live] = 2 * node[live] + 1 + (xs[live, feature[key]] >= cut[key])
    place, depth = np.repeat(np.arange(trees)[:, None] * width, n, axis=1), np.zeros((trees, n))
    start, row = place.copy(), np.arange(n)[None, :]
    for _ in range(limit):
        f = feature[place]
        step = f >= 0
        right = x[row, np.maximum(f, 0)] >= cut[place]
        place = np.where(step, start + 2 * (place - start) + 1 + right, place)
        depth += step
    mean = (depth + expected(count[place])).mean(axis=0)
    return 2.0 ** (-mean / max(float(expected(np.array(float(size)))), 1e-9))


def anomaly_scores(txns: DataFrame, least: int = 10, contamination: float = 0.05, most: int = 25_600, key: str = "from_customer_id") -> DataFrame:
    """An isolation forest per sender with at least ``least`` transactions. Its trees are fitted on a seeded sample of
    about ``most`` of the sender's rows (all, where there are no more). Rows are scored in even parts, by a hash, each part
    with the same sample and so the same trees, and a task never holds more than about that many rows of each. Range,
    quantile, means and deviations are the sender's, whatever the number of parts."""
    a, c = F.col("amount"), F.col
    whole = (a > 0) & (a % 500 == 0)
    codes = points(F.lower("transaction_type"), TYPE_CODE, 0), points(F.lower("channel"), CHANNEL_CODE, 0) if "channel" in txns.columns else F.lit(0.0)
    values = [F.log1p(a), F.hour("created_at"), F.weekday("created_at"), c("is_international").cast("double"), whole.cast("double"), *codes]
    rows = txns.filter(F.col(key).isNotNull()).select(F.col(key).alias("customer_id"), F.col("id").alias("txn_id"), *(F.coalesce(v.cast("double"), F.lit(0.0)).alias(n) for v, n in zip(values, FOREST_FEATURES, strict=True)))
    sizes = rows.groupBy("customer_id").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    parts = F.ceil(F.col("_n") / most)
    dealt = rows.join(sizes, "customer_id").withColumn("part", F.pmod(F.xxhash64("txn_id"), parts))
    drawn = F.pmod(F.xxhash64(F.lit(42), "txn_id"), F.lit(1 << 30)) < F.lit(float(most << 30)) / F.col("_n")
    sample = dealt.filter((F.col("_n") > most) & drawn).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    sample = sample.select(*(F.col(n).alias(f"_{n}") for n in ("customer_id", "part", "txn_id", *FOREST_FEATURES)))

    def forest(group: pd.DataFrame, pool: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("txn_id")
        x = group[FOREST_FEATURES].to_numpy(float)
        fitted = pool.sort_values("_txn_id")[[f"_{n}" for n in FOREST_FEATURES]].to_numpy(float) if len(pool) else x
        return group[["txn_id", "customer_id", *FOREST_FEATURES]].assign(raw=isolation_scores(x, pool=fitted) if len(x) else np.empty(0))

    by = ["customer_id", "part"]
    schema = ", ".join(["txn_id long", "customer_id long", *(f"{n} double" for n in FOREST_FEATURES), "raw double"])
    scored = materialize(dealt.groupBy(*by).cogroup(sample.groupBy("_customer_id", "_part")).applyInPandas(forest, schema), "forests")
    fit = scored.groupBy("customer_id").agg(F.count("*").alias("_n"), F.min("raw").alias("_lo"), F.max("raw").alias("_hi"), *(x for n in FOREST_FEATURES for x in (F.avg(n).alias(f"_m_{n}"), F.stddev_pop(n).alias(f"_s_{n}"))))
    fit = fit.join(quantiles(scored, "customer_id", "raw", _cut=1 - contamination), "customer_id")
    span = c("_hi") - c("_lo")
    far = [F.abs(c(n) - c(f"_m_{n}")) / F.when(c(f"_s_{n}") > 0, c(f"_s_{n}")).otherwise(1.0) for n in FOREST_FEATURES]
    reason = F.element_at(F.array(*map(F.lit, FOREST_FEATURES)), F.array_position(F.array(*far), F.greatest(*far)).cast("int"))
    return scored.join(fit, "customer_id").select(
        "txn_id", "customer_id", F.when(span > 0, rounded((c("raw") - c("_lo")) / span * 100)).otherwise(0.0).alias("score"), ((c("raw") > c("_cut")) & (span > 0)).alias("is_anomaly"),
        F.when(c("_n") >= 30, 100).otherwise(30).cast("long").alias("confidence"), reason.alias("reason"),
    )
