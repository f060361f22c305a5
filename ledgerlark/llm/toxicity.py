"""Toxicity grades by cumulative-link ordinal regression over sparse word features.

P(grade > k) = sigmoid(w.x - t_k) with one weight vector for all ordered thresholds t_0 < t_1 < ...; the expected
severity is the sum of these probabilities. Fitted on a bounded sample of labelled rows; every text is scored whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.storage import materialize
from ledgerlark.llm.texts import slices, whole_text

WORD = re.compile(r"[^\W\d_]+")

#: Labels say toxic or not. The fit makes grades 1 to this number of the toxic ones, by their rank in held-out scores.
GRADES = 3
#: Letters of the longest word that can be a feature.
LONGEST = 64


@dataclass
class OrdinalModel:
    words: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, counts: list[dict[int, int]]) -> np.ndarray:
        """P(grade > k) for each text and k, from the counts of known words."""
        score = np.array([sum(self.weights[j] * (1 + np.log(c)) for j, c in found.items()) for found in counts])
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))

    def count(self, text: str) -> dict[int, int]:
        found: dict[int, int] = {}
        for j in filter(None.__ne__, map(self.words.get, WORD.findall(text.lower()))):
            found[j] = found.get(j, 0) + 1
        return found


def fit_ordinal(rows: list[list[tuple[int, float]]], grades: np.ndarray, n_features: int, n_grades: int, decay: float = 1e-4, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of least mean negative log likelihood plus ``decay`` times the squared weights. Full-batch
    Adam from zero, so fits are the same each time. Thresholds stay ordered: they are a start and exponential steps."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cols = np.array([j for r in rows for j, _ in r], np.int64)
    vals = np.array([v for r in rows for _, v in r])
    free = np.zeros(n_features + n_grades - 1)
    shares = np.array([(grades > k).mean() for k in range(n_grades - 1)]).clip(1e-4, 1 - 1e-4)
    start = np.log((1 - shares) / shares)
    free[n_features] = start[0]
    free[n_features + 1 :] = np.log(np.maximum(np.diff(start), 0.05))
    m, v = np.zeros_like(free), np.zeros_like(free)
    sigmoid = lambda z: 1 / (1 + np.exp(np.clip(-z, -60, 60)))
    for step in range(1, steps + 1):
        w, gaps = free[:n_features], np.exp(free[n_features + 1 :])
        cuts = free[n_features] + np.r_[0, np.cumsum(gaps)]
        score = np.bincount(at, w[cols] * vals, len(rows))
        edges = np.r_[-np.inf, cuts, np.inf]
        low, high = sigmoid(edges[grades] - score), sigmoid(edges[grades + 1] - score)
        dl, dh = low * (1 - low), high * (1 - high)
        p = np.maximum(high - low, 1e-12)
        d_score = (dh - dl) / p / len(rows)  # of the negative log likelihood
        d_cut = np.zeros(n_grades + 1)
        np.add.at(d_cut, grades + 1, -dh / p / len(rows))
        np.add.at(d_cut, grades, dl / p / len(rows))
        d_cut = d_cut[1:-1]
        tail = np.cumsum(d_cut[::-1])[::-1]
        grad = np.r_[np.bincount(cols, d_score[at] * vals, n_features) + 2 * decay * w, tail[0], tail[1:] * gaps]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        free = free - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return free[:n_features], free[n_features] + np.r_[0, np.cumsum(np.exp(free[n_features + 1 :]))]


def held_out_grades(features: list[list[tuple[int, float]]], toxic: np.ndarray, n_features: int) -> np.ndarray:
    """0 for rows that are not toxic; toxic ones get 1 to ``GRADES`` by the rank of a score from a fit on the other half of
    the rows, which has not seen their own labels. Rows are halved in turn, ties go by their order."""
    half = np.arange(len(toxic)) % 2
    score = np.zeros(len(toxic))
    for mine in (0, 1):
        other = np.flatnonzero(half != mine)
        if len(set(toxic[other].tolist())) == 2:
            weights, _ = fit_ordinal([features[i] for i in other], toxic[other].astype(np.int64), n_features, 2)
            for i in np.flatnonzero(half == mine):
                score[i] = sum(weights[j] * v for j, v in features[i])
    grades = np.zeros(len(toxic), np.int64)
    bad = np.flatnonzero(toxic)
    rank = np.empty(len(bad), np.int64)
    rank[np.argsort(score[bad], kind="stable")] = np.arange(len(bad))
    grades[bad] = 1 + rank * GRADES // max(1, len(bad))
    return grades


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, toxic, words`` (each word with its count) of a bounded sample, with near copies once. An id counts as toxic
    if any of its labels says so; of texts with one id the least is taken."""
    chosen = labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id"))
    chosen = chosen.agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # The sample is bounded by its parameter, so it can be sent to every task.
    rows = whole_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("w", pa.string()), ("c", pa.int32())]))]
        for whole in batches:
            for batch in slices(whole, "text"):
                out = []
                for doc_id, toxic, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "toxic", "text")), strict=True):
                    words = WORD.findall(text.lower())
                    grams = sorted({zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(len(words) - 2)})[:4]
                    # Near copies count once, or one mislabelled text's copies would make its rare words look toxic.
                    key = ",".join(map(str, grams)) if len(grams) == 4 else f"row {doc_id}"
                    out.append((doc_id, toxic, key, [{"w": w, "c": c} for w, c in sorted(Counter(words).items()) if len(w) <= LONGEST]))
                columns = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "toxic", "sketch", "words"])

    told = rows.mapInArrow(run, "doc_id long, toxic int, sketch string, words array<struct<w:string,c:int>>")
    first = told.groupBy("sketch").agg(F.min_by(F.struct("doc_id", "toxic", "words"), "doc_id").alias("x")).select("x.*")
    return materialize(first, "labelled")


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, min_docs: int = 4, odds: float = 8.0, max_words: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fits on at most ``sample_rows`` labelled documents, those with the smallest hashes of their ids (the one bounded
    sample here). Features are the sample's words whose odds in toxic documents are ``odds`` times higher or lower, at
    most ``max_words`` of them, of at most ``LONGEST`` letters. The labels say toxic or not; which toxic documents are the
    worse ones is told by ``held_out_grades``.

    Null labels and ids are left out; null texts are empty; repeated ids and labels count once, as in
    ``labelled_sample``. Without any toxic label, or without any other, the model has no words and finds nothing toxic.
    Words are counted in Spark; only the features of the sample come to the driver, and the fit is the same each time."""
    sample = labelled_sample(docs, labels, sample_rows, id_col, text_col)
    toxic = F.col("toxic") > 0
    n1, n0 = sample.agg(F.count(F.when(toxic, 1)), F.count(F.when(~toxic, 1))).first()
    nothing = OrdinalModel({}, np.zeros(0), np.arange(60.0, 60.0 + GRADES))
    if not n1 or not n0:
        return nothing
    a1, a0 = F.col("a1"), F.col("a0")
    ratio = (a1 + 0.5) * (n0 - a0 + 0.5) / ((n1 - a1 + 0.5) * (a0 + 0.5))
    counts = sample.select(toxic.cast("long").alias("y"), F.explode("words.w").alias("w")).groupBy("w").agg(F.sum("y").alias("a1"), F.sum(1 - F.col("y")).alias("a0"))
    telling = (F.col("r") <= 1 / odds) | ((F.col("r") >= odds) & (a1 >= 0.02 * n1))
    best = counts.filter(a1 + a0 >= min_docs).withColumn("r", ratio).filter(telling).orderBy((F.abs(F.log("r")) * F.sqrt(a1 + a0)).desc(), "w").limit(max_words)
    words = {r.w: j for j, r in enumerate(best.select("w").collect())}
    if not words:
        return nothing
    # At most sample_rows rows of max_words short words.
    known = best.select("w", F.lit(True).alias("known"))
    some = sample.select("doc_id", F.explode("words").alias("x")).select("doc_id", "x.w", "x.c").join(F.broadcast(known), "w")
    bags = some.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("w", "c"))).alias("bag"))
    rows = sample.select("doc_id", "toxic").join(bags, "doc_id", "left").orderBy("doc_id").collect()
    features = [[(words[x.w], float(1 + np.log(x.c))) for x in r.bag or ()] for r in rows]
    grades = held_out_grades(features, np.array([r.toxic > 0 for r in rows]), len(words))
    weights, cuts = fit_ordinal(features, grades, len(words), GRADES + 1)
    return OrdinalModel(words, weights, cuts)


def score_toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``severity`` (expected grade), ``grade`` (the most likely one) and ``toxic``
    (grade above 0 more likely than not). A null text is an empty one; a null id stays null; repeated rows are scored
    each; an empty table gives no rows. The model has at most ``max_words`` words, so shipping it is bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                above = model.above([model.count(t) for t in batch.column("text").to_pylist()])
                steps = np.c_[np.ones(len(above)), above, np.zeros(len(above))]
                grade = np.argmax(steps[:, :-1] - steps[:, 1:], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.round(above.sum(axis=1), 6)), pa.array(grade.astype(np.int32)), pa.array(above[:, 0] > 0.5)],
                    names=["doc_id", "severity", "grade", "toxic"],
                )

    return whole_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, severity double, grade int, toxic boolean")


def grade_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document scored by a model fitted on the labels; cases as in ``fit_toxicity`` and ``score_toxicity``."""
    return score_toxicity(docs, fit_toxicity(docs, labels))
