"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket; each source's budget falls into one bucket, everything below it is taken and
everything above is not, and only that boundary bucket is cut finer at the next level. The thresholds that remain filter
the table without sorting it. Thresholds are nested: a larger budget takes a superset. Equal rows have one hash; where the
budget ends among them, the same histogram goes on over their places in a written table. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions.storage import materialize
from ledgerlark.llm.texts import column, spare

#: Hashes have 60 bits; each level of the histogram looks at 12 more of them.
BITS, STEP = 60, 12


def words_in(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def hash60(key: Column, text: Column) -> Column:
    """The first 15 hexadecimal digits of the MD5 of a row's id and text: the same in any engine and on any run."""
    known = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(known), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """``source, source_size, target`` from a frame of one row per source (``source, source_size``).

    Sources by code point, null last, weigh ``weights`` in turn. Targets share all sizes by weight; none is above ``cap``
    times its source's size, and the excess is shared again by weight until none is above. Solved at once: with sources
    in the order of cap to weight, a share of ``x`` for each unit of weight caps a prefix of them, and the first source
    for which the rest's share stays below its own cap fixes ``x``. The frame has a row per source, not per document.
    """
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = sizes.select("source", "source_size", pick.cast("double").alias("weight")).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    share = (F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    fits = weighed.withColumn("share", share).withColumn("x", F.when(F.col("share") <= F.col("most") / F.col("weight"), F.col("share")))
    # The first source, in the order of ratios, whose own cap leaves room for the rest's share.
    x = F.coalesce(F.first("x", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(float("inf")))
    return fits.select("source", "source_size", F.least(F.col("most"), x * F.col("weight")).alias("target"))


def _narrowed(items: DataFrame, budgets: DataFrame, bits: int) -> tuple[DataFrame, int]:
    """``source, low, rest, n, items`` and a shift: of each source the bucket ``low`` (of values shifted by that) in which its
    budget ends, what is left of the budget there, and the size and number of items in it. ``items`` has ``source, size, v``
    (source not null, v of ``bits`` bits); ``budgets`` has ``source, rest``. A histogram is a partial sum by source and bucket,
    at most 2^12 rows a source; levels end when each bucket holds one item."""
    state = budgets.select("source", F.lit(0).cast("long").alias("low"), F.col("rest").cast("double").alias("rest"))
    for shift in range((bits - 1) // STEP * STEP, -1, -STEP):
        inside = items.join(state, "source")
        if shift + STEP < bits:
            inside = inside.filter(F.shiftright("v", shift + STEP) == F.col("low"))
        sums = inside.groupBy("source", F.shiftright("v", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.count("*").alias("items"))
        cum = F.sum("n").over(Window.partitionBy("source").orderBy("bucket"))
        placed = sums.withColumn("upto", cum).join(state.select("source", "rest"), "source").filter(F.col("upto") > F.col("rest"))
        cut = placed.groupBy("source").agg(F.min(F.struct("bucket", "n", "upto", "items", "rest")).alias("c"))
        # Without a bucket beyond the budget, all that is left is taken: the boundary is the end of the range.
        state = materialize(
            state.select("source", "low").join(cut, "source", "left").select(
                "source",
                F.coalesce(F.col("c.bucket"), F.shiftleft(F.col("low") + 1, STEP)).alias("low"),
                F.when(F.col("c").isNull(), F.lit(0.0)).otherwise(F.col("c.rest") - (F.col("c.upto") - F.col("c.n"))).alias("rest"),
                F.coalesce(F.col("c.n"), F.lit(0)).alias("n"),
                F.coalesce(F.col("c.items"), F.lit(0)).alias("items"),
            ),
            "thresholds",
        )
        if (state.agg(F.max("items")).first()[0] or 0) <= 1:
            break
    return state, shift


def _takes() -> Column:
    """The boundary item goes in when that comes nearer to the budget than leaving it out."""
    return ((F.col("n") > 0) & (F.col("n") - F.col("rest") < F.col("rest"))).cast("long")


def thresholds(items: DataFrame, budgets: DataFrame) -> DataFrame:
    """``source, below, rest``: of each source, items with ``h < below``, and of those with ``h = below`` as many as come
    nearest to ``rest`` (0 but for items of one hash), come nearest to ``budget`` in size, exactly so for the hash order.
    ``items`` has ``source, size, h``; ``budgets`` has ``source, budget``."""
    state, shift = _narrowed(items.withColumnRenamed("h", "v"), budgets.withColumnRenamed("budget", "rest"), BITS)
    tied = F.col("items") > 1
    below = F.when(tied, F.shiftleft("low", shift)).otherwise(F.shiftleft(F.col("low") + _takes(), shift))
    return state.select("source", below.alias("below"), F.when(tied, F.col("rest")).otherwise(F.lit(0.0)).alias("rest"))


def _tie_cuts(tied: DataFrame, budgets: DataFrame) -> DataFrame:
    """``source, place``: of each source's equal items (``source, size, v``: v unique), those with ``v < place`` come
    nearest to ``rest``."""
    state, shift = _narrowed(tied, budgets, 63)
    return state.select("source", F.shiftleft(F.col("low") + _takes(), shift).alias("place"))


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def _items(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"), hash60(F.col(id_col).cast("long"), F.col(text_col)).alias("h"))
    return materialize(sized.select("*", _source_key(F.col("source")).alias("k"), F.monotonically_increasing_id().alias("u")), "sizes")


def _plan(items: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """``k, source_size, target, whole, below, rest``: a row per source, in a written table. Its documents are taken
    ``whole`` times, and once more where their hash lies below ``below``, or among those at it for ``rest`` words."""
    targets = source_targets(items.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap).select(_source_key(F.col("source")).alias("k"), "source_size", "target")
    q = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = materialize(targets.withColumn("whole", F.floor(q).cast("long")).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    cuts = thresholds(items.select(F.col("k").alias("source"), "size", "h"), plan.select(F.col("k").alias("source"), "budget"))
    return materialize(plan.drop("budget").join(cuts.withColumnRenamed("source", "k"), "k"), "plan")


def _once_more(items: DataFrame, plan: DataFrame, k: str, h: str, u: str, size: str, below: str, rest: str, more: str, place: str) -> DataFrame:
    """``items`` joined with their source's ``plan``, with ``more``: whether they lie before the boundary."""
    rows = items.join(plan, k)
    before = F.col(h) < F.col(below)
    if plan.filter(F.col(rest) > 0).isEmpty():
        return rows.withColumn(more, before)
    at = (F.col(h) == F.col(below)) & (F.col(rest) > 0)
    tied = rows.filter(at).select(F.col(k).alias("source"), F.col(size).alias("size"), F.col(u).alias("v"))
    cuts = materialize(_tie_cuts(tied, plan.filter(F.col(rest) > 0).select(F.col(k).alias("source"), F.col(rest).alias("rest"))), "places")
    placed = rows.join(cuts.select(F.col("source").alias(k), F.col("place").alias(place)), k, "left")
    return placed.withColumn(more, before | F.coalesce(at & (F.col(u) < F.col(place)), F.lit(False)))


def _repeats(whole: Column, more: Column, cap: int) -> Column:
    return F.least(whole + more.cast("long"), F.lit(cap).cast("long"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, taken``, and ``repeats`` (whole times it is taken).

    A document's size is its number of words. A target of q times the source's size takes every document floor(q) times
    and once more those whose hash lies below the source's threshold, so taken words miss the target by less than the
    document at the boundary, and no document is taken more than ``cap`` times. Null texts have size 0, null sources form
    one source, which comes last, and empty tables give no rows. Hashes depend on ids and texts, so reruns agree; rows with
    one id and one text are documents of their own all the same: of those at the boundary as many are taken as come
    nearest, and they are alike, so it makes no difference which. Texts are read once; later passes see ids, sources, sizes.
    """
    items = _items(docs, id_col, text_col, source_col)
    return (
        _once_more(items, _plan(items, weights, cap), "k", "h", "u", "size", "below", "rest", "more", "place")
        .withColumn("repeats", _repeats(F.col("whole"), F.col("more"), cap))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats")
    )


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as ``mix_sources`` takes it, with all their columns, whatever their names. How
    often is worked out beside the row, from its own source, id and text, so null and repeated ids don't multiply; only
    equal rows at a boundary are written once more, to be told apart. The plan has one row for each source; being a written
    table, its size is known, and the planner ships it only where it is small."""
    plan = _plan(_items(docs, id_col, text_col, source_col), weights, cap)
    k, h, whole, below, rest, u, size, more, place, n = spare(docs, "k", "h", "whole", "below", "rest", "u", "size", "more", "place", "n")
    named = plan.select(F.col("k").alias(k), F.col("whole").alias(whole), F.col("below").alias(below), F.col("rest").alias(rest))
    rows = docs.withColumn(k, _source_key(F.col(source_col))).withColumn(h, hash60(F.col(id_col).cast("long"), F.col(text_col)))
    joined = rows.join(named, k)
    plain, parts = joined.withColumn(more, F.col(h) < F.col(below)), []
    if not named.filter(F.col(rest) > 0).isEmpty():
        at = (F.col(h) == F.col(below)) & (F.col(rest) > 0)
        tied = materialize(rows.join(named, k).filter(at).select(*map(column, rows.columns), words_in(F.col(text_col)).alias(size), F.monotonically_increasing_id().alias(u)), "tied")
        parts.append(_once_more(tied, named, k, h, u, size, below, rest, more, place))
        plain = plain.filter(~at)
    parts.append(plain)
    out = [p.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), _repeats(F.col(whole), F.col(more), cap)))) for p in (q.filter(_repeats(F.col(whole), F.col(more), cap) > 0) for q in parts)]
    out = [p.select(*map(column, docs.columns)) for p in out]
    return out[0].unionAll(out[1]) if len(out) > 1 else out[0]


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST(concat('0x', substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15)) AS BIGINT) AS h, row_number() OVER () AS place
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, CAST(source_size AS DOUBLE) * 3E0 AS most,
    CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM s
), r AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
      - coalesce(sum(most) OVER (ORDER BY most / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0E0))
      / sum(weight) OVER (ORDER BY most / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM w
), x AS (
  SELECT (SELECT share FROM r WHERE share <= most / weight ORDER BY most / weight, encode(source) NULLS LAST LIMIT 1) AS x
), t AS (
  SELECT source, source_size, least(most, coalesce(x, CAST('inf' AS DOUBLE)) * weight) AS target FROM r, x
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.place) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), b AS (
  SELECT *, target - whole * source_size AS budget FROM p
)
SELECT doc_id, size, source_size, target, CAST(size * least(r, 3) AS BIGINT) AS taken, CAST(least(r, 3) AS BIGINT) AS repeats
FROM (
  SELECT *, whole + CASE WHEN upto <= budget OR (upto - size <= budget AND upto - budget < budget - (upto - size)) THEN 1 ELSE 0 END AS r FROM b
)
"""
