"""Imputing, encoding and scaling: fitted once, saved, and applied to any rows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions.columns import rounded
from ledgerlark.functions.order import median, running
from ledgerlark.functions.storage import materialize


@dataclass
class Preparation:
    """What was fitted, as two tables. ``numbers``: ``column, median, low, high``, one row for each number column.
    ``codes``: ``column, value, n, code``, a row for each word of each word column, codes from 0 in sorted order."""

    numbers: DataFrame
    codes: DataFrame

    def save(self, path: str) -> None:
        """Writes both tables under ``path``, which must not exist: a version is never changed."""
        self.numbers.write.parquet(f"{path}/numbers")
        self.codes.write.parquet(f"{path}/codes")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Preparation:
        return Preparation(spark.read.parquet(f"{path}/numbers"), spark.read.parquet(f"{path}/codes"))

    def modes(self) -> DataFrame:
        """``column, mode, known``: each word column's most frequent word, the first of equally frequent ones, and how many
        words it has."""
        return self.codes.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("mode"), F.count("*").alias("known"))

    def transform(self, df: DataFrame, key: str, numbers: list[str], words: list[str]) -> DataFrame:
        """``key``, each number in [0, 1] of the fitted range (missing: the median; outside: the nearer end; a range of one
        value or none: 0), and ``<word>_code`` (missing: the most frequent word's; not seen in the fit: the number of words
        seen, also where none was). One projection over ``df`` but for the look-up of codes, a join that Spark broadcasts
        where the table of codes is small. Other columns stay behind; repeated rows stay."""
        fit = {r["column"]: r for r in self.numbers.filter(F.col("column").isin(numbers)).collect()}
        modes = {r["column"]: r for r in self.modes().filter(F.col("column").isin(words)).collect()}
        if absent := [c for c in numbers if c not in fit]:
            raise ValueError(f"not fitted: {absent}")

        def scaled(c: str):
            low, high = fit[c]["low"], fit[c]["high"]
            if low is None or not high > low:
                return F.lit(0.0).alias(c)
            x = F.coalesce(F.col(c).cast("double"), F.lit(fit[c]["median"]))
            return rounded(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - low) / (high - low))), 6).alias(c)

        known = {w: (modes[w]["mode"], modes[w]["known"]) if w in modes else (None, 0) for w in words}
        rows = df.select(F.col(key).alias("_key"), *(scaled(c) for c in numbers), *(F.coalesce(F.col(w), F.lit(known[w][0])).alias(f"_w_{w}") for w in words))
        for w in words:
            mine = self.codes.filter(F.col("column") == w).select(F.col("value").alias(f"_w_{w}"), F.col("code").alias(f"{w}_code"))
            rows = rows.join(mine, f"_w_{w}", "left").withColumn(f"{w}_code", F.coalesce(f"{w}_code", F.lit(known[w][1])).cast("long"))
        return rows.select(F.col("_key").alias(key), *numbers, *(f"{w}_code" for w in words))


def fit_preparation(df: DataFrame, numbers: list[str], words: list[str]) -> Preparation:
    """Medians and ranges of ``numbers`` (ranges after missing ones took the median, which never widens them), and codes of
    ``words``. Values are ordered in ranges, words numbered by running counts: neither meets in one task."""
    spark = df.sparkSession
    each = [median(df.select(F.col(c).cast("double").alias("x")), "x").crossJoin(df.agg(F.min(F.col(c).cast("double")).alias("low"), F.max(F.col(c).cast("double")).alias("high"))).select(F.lit(c).alias("column"), "median", "low", "high") for c in numbers]
    # One row for each number column.
    fitted = materialize(reduce(DataFrame.unionByName, each) if each else spark.createDataFrame([], "column string, median double, low double, high double"), "prepared-numbers")
    if not words:
        return Preparation(fitted, spark.createDataFrame([], "column string, value string, n long, code long"))
    pairs = F.inline(F.array(*(F.struct(F.lit(w).alias("column"), F.col(w).cast("string").alias("value")) for w in words)))
    seen = df.select(pairs).filter("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n")).withColumn("_one", F.lit(1).cast("long"))
    placed = running(seen, [F.col("column"), F.col("value")], _k="_one")
    first = placed.groupBy("column").agg(F.min("_k").alias("_first"))
    codes = placed.join(first, "column").select("column", "value", "n", (F.col("_k") - F.col("_first")).alias("code"))
    return Preparation(fitted, materialize(codes, "prepared-codes"))


def impute_encode_scale(df: DataFrame, key: str, numbers: list[str], words: list[str]) -> tuple[DataFrame, Preparation]:
    """(rows, what was fitted): a fit on all rows, applied to them."""
    fit = fit_preparation(df, numbers, words)
    return fit.transform(df, key, numbers, words), fit
