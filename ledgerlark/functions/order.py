"""Running sums, medians and quantiles over a whole table or each of its groups, without ordering one of them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions.storage import materialize


def running(df: DataFrame, order: Column | list[Column], **sums: str) -> DataFrame:
    """``summed_ranges`` without the columns that tell of the ranges."""
    return summed_ranges(df, order if isinstance(order, list) else [order], **sums)[0].select(*df.columns, *sums)


def summed_ranges(df: DataFrame, order: list[Column], merge: bool = False, **sums: str) -> tuple[DataFrame, DataFrame]:
    """``df`` with a column for each of ``sums``: the sum of the named column over all rows up to and with this one.

    ``order``, of one or several columns, has to tell all rows apart (group by it first). Rows are sorted into ranges and written; each range is
    summed by itself, and takes on the sums of the ranges before it, of which there are as many as shuffle partitions.
    Null values count as none; an empty frame stays empty. ``_range`` is a row's range, ``_edge`` whether its range may share the
    first column of ``order`` with another one. With ``merge``, rows of one place, which have no columns but those of ``order``
    and the summed ones, are first summed, in their range. The second frame is the written table."""
    placed = df.repartitionByRange(*order)
    if merge:
        placed = placed.groupBy(*order).agg(*(F.sum(x).alias(x) for x in dict.fromkeys(sums.values())))
    placed = materialize(placed.withColumn("_range", F.spark_partition_id()), "ordered")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = placed.groupBy("_range").agg(*(F.sum(x).alias(name) for name, x in sums.items()), F.min(order[0]).alias("_least"), F.max(order[0]).alias("_most"))
    starts = whole.select("_range", "_least", "_most", *(F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"_before_{name}") for name in sums))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.join(F.broadcast(starts), "_range")
    edge = ~F.coalesce((order[0] != F.col("_least")) & (order[0] != F.col("_most")), F.lit(False))
    return rows.select(*placed.columns, edge.alias("_edge"), *((F.coalesce(F.sum(x).over(inside), F.lit(0)) + F.col(f"_before_{name}")).alias(name) for name, x in sums.items())), placed


def placed_values(df: DataFrame, column: str) -> DataFrame:
    """``column, _k, _upto``: each value that is not null, its rows, and the rows with values up to it."""
    values = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_k"))
    return running(values, F.col(column), _upto="_k")


def median(df: DataFrame, column: str, name: str = "median") -> DataFrame:
    """One row with the exact median, the mean of the two middle values where their number is even; null for none."""
    values = placed_values(df, column)
    row = values.crossJoin(F.broadcast(values.agg(F.sum("_k").alias("_n")))).agg(
        F.min(F.when(F.col("_upto") > F.floor((F.col("_n") - 1) / 2), F.col(column))).alias("_a"),
        F.min(F.when(F.col("_upto") > F.floor(F.col("_n") / 2), F.col(column))).alias("_b"),
    )
    return row.select((F.col("_a") * 0.5 + F.col("_b") * 0.5).alias(name))


def quantiles(df: DataFrame, key: str, column: str, **shares: float) -> DataFrame:
    """``key`` and a column for each of ``shares``: that quantile of the key's values, between two of them in proportion
    (``half=0.5`` is the median). Exact, and no task holds a key's values: equal ones are counted first, the distinct ones
    are sorted into ranges by key and value, counts of a key's ranges say in which one a place lies, and only there are the
    values counted one by one. Null values count as none; a key without any is left out; a null key is a key like others."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(column).alias("_v")).agg(F.count("*").alias("_k"))
    placed = materialize(counted.repartitionByRange("_key", "_v").withColumn("_range", F.spark_partition_id()), "quantiles")
    per = Window.partitionBy("_key")
    cells = placed.groupBy("_key", "_range").agg(F.sum("_k").alias("_in"))
    cells = cells.withColumn("_n", F.sum("_in").over(per)).withColumn("_upto", F.sum("_in").over(per.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)))
    wants = []
    for name, share in shares.items():
        place = (F.col("_n") - 1) * F.lit(share)
        wants += [F.struct(F.lit(name).alias("_name"), place.alias("_place"), end(place).cast("long").alias("_at")) for end in (F.floor, F.ceil)]
    wanted = cells.withColumn("_w", F.explode(F.array_distinct(F.array(*wants)))).select("_key", "_range", "_w.*", (F.col("_upto") - F.col("_in")).alias("_before"), "_upto")
    wanted = wanted.filter((F.col("_at") >= F.col("_before")) & (F.col("_at") < F.col("_upto")))
    # A range without a place of its key is not read on; one that has any is of bounded size.
    cut = placed.join(wanted.select(F.col("_key").alias("_mine"), F.col("_range").alias("_there"), "_name", "_place", "_at", "_before"), F.col("_key").eqNullSafe(F.col("_mine")) & (F.col("_range") == F.col("_there")))
    inside = Window.partitionBy("_key", "_range", "_name", "_at").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("_before") + F.sum("_k").over(inside)
    hits = cut.select("_key", "_name", "_place", "_at", "_v", "_k", last.alias("_last")).filter((F.col("_at") < F.col("_last")) & (F.col("_at") >= F.col("_last") - F.col("_k")))
    ends = hits.groupBy("_key", "_name").agg(F.min(F.struct("_at", "_v")).alias("_a"), F.max(F.struct("_at", "_v")).alias("_b"), F.first("_place").alias("_place"))
    low, high = F.col("_a._v"), F.col("_b._v")
    value = F.when((F.col("_a._at") == F.col("_b._at")) | (low == high), low.cast("double")).otherwise((F.col("_b._at") - F.col("_place")) * low + (F.col("_place") - F.col("_a._at")) * high)
    return ends.withColumn("_value", value).groupBy(F.col("_key").alias(key)).agg(*(F.max(F.when(F.col("_name") == name, F.col("_value"))).alias(name) for name in shares))
