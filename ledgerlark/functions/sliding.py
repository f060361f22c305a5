"""Exact sliding windows in time by differences of running sums.

A window's sum is the running sum at its end less that before its start, in the order of key and time over the whole
table. Starts and ends are rows of their own among the data, so one pass over sorted ranges answers them all: work grows
with the rows, not with rows times window, and a key of any size spreads over as many ranges as it fills. Only rows of keys
that may stand in several ranges are brought together once more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.order import summed_ranges
from ledgerlark.functions.storage import discard, materialize, release

BEFORE, DATA, AFTER = 0, 1, 2


@dataclass(frozen=True)
class Span:
    """The sum of ``measure`` from ``low`` to ``high`` units of time around a row, both included, for rows with ``where``."""

    measure: str
    low: int
    high: int = 0
    where: Column | None = None


def sliding(rows: DataFrame, key: str, at: str, measures: dict[str, Column], spans: dict[str, Span], firsts: dict[str, str] | None = None) -> DataFrame:
    """``key, at``, each of ``measures`` and each of ``spans``: one row for each key and time.

    ``at`` is a whole number. ``measures`` are numbers to be summed (null: none), first over the rows of one key and time.
    Where no row of that key and time has a span's ``where``, the span may be null. ``firsts`` names, for spans over a measure of
    counts, a column with the time of the first counted row in it. A null key is a key like any other; rows without a time
    give no row, and an empty table none."""
    firsts = firsts or {}
    wants = {name: F.lit(True) if s.where is None else F.coalesce(s.where, F.lit(False)) for name, s in spans.items()}
    # Each distinct end of spans is looked up once; a span that ends with the row itself has its sum there.
    ends: dict[tuple[int, int], list[str]] = {}
    for name, s in spans.items():
        ends.setdefault((s.low, BEFORE), []).append(name)
        if s.high != 0:
            ends.setdefault((s.high, AFTER), []).append(name)
    number = {end: i for i, end in enumerate(ends)}
    # A mark is its place, and one number for its side of the rows there and the end that it stands for (0: the row itself).
    width = len(ends) + 1
    marks = [F.struct(F.col(at).alias("_t"), F.lit(DATA * width).alias("_mark"))]
    for (offset, side), names in ends.items():
        some = F.lit(False)
        for name in names:
            some = some | wants[name]
        marks.append(F.when(some, F.struct((F.col(at) + F.lit(offset)).alias("_t"), F.lit(side * width + number[offset, side] + 1).alias("_mark"))))
    legs = rows.filter(F.col(at).isNotNull()).select(F.col(key), F.array_compact(F.array(*marks)).alias("_marks"), *(F.coalesce(value, F.lit(0)).alias(f"_m_{m}") for m, value in measures.items()))
    events = legs.select(key, *(f"_m_{m}" for m in measures), F.inline("_marks"))
    own = F.col("_mark") == DATA * width
    events = events.select(key, "_t", "_mark", *(F.when(own, F.col(f"_m_{m}")).alias(f"_m_{m}") for m in measures))
    # Looked up rows of one place add nothing, so their order among themselves is free.
    summed, ordered = summed_ranges(events, [F.col(key), F.col("_t"), F.col("_mark")], merge=True, **{f"_p_{m}": f"_m_{m}" for m in measures})
    release(rows.sparkSession)
    end = F.col("_mark") % width
    back_by = F.coalesce(*(F.when(end == number[e] + 1, F.lit(e[0])) for e in ends), F.lit(0)).cast("long")
    looked = sorted({(s.measure, number[s.low, BEFORE] + 1) for s in spans.values()} | {(s.measure, number[s.high, AFTER] + 1 if s.high else 0) for s in spans.values()})
    # Rows and marks of one range meet in it, without a shuffle.
    met = summed.withColumn(at, F.col("_t") - back_by).groupBy("_range", key, at).agg(
        F.first("_edge").alias("_edge"), *(F.max(F.when(own, F.col(f"_m_{m}"))).alias(m) for m in measures), *(F.max(F.when(end == e, F.col(f"_p_{m}"))).alias(f"_{m}_{e}") for m, e in looked)
    )
    low = lambda s: F.col(f"_{s.measure}_{number[s.low, BEFORE] + 1}")
    high = lambda s: F.col(f"_{s.measure}_{number[s.high, AFTER] + 1 if s.high else 0}")
    sums = [(high(s) - low(s)).alias(name) for name, s in spans.items()]
    # Of keys within one range the spans are known now; running sums are kept where they are still asked for.
    counted = {spans[span].measure for span in firsts.values()}
    done = met.select("_edge", key, at, *measures, *(F.when(~F.col("_edge"), high(s) - low(s)).alias(name) for name, s in spans.items()), *((F.col(c) if m in counted else F.when(F.col("_edge"), F.col(c))).alias(c) for m, e in looked for c in [f"_{m}_{e}"]))
    done = materialize(done, "spans")
    discard(ordered)
    release(rows.sparkSession)
    kept = [f"_{m}_{e}" for m, e in looked]
    across = done.filter("_edge").groupBy(key, at).agg(*(F.max(c).alias(c) for c in [*measures, *kept])).select(key, at, *measures, *sums, *kept)
    back = done.filter(~F.col("_edge")).select(key, at, *measures, *spans, *kept).unionByName(across)
    out = back
    for name, span in firsts.items():
        # The first row counted in a span is the one before which the running count is what it is before the span.
        s = spans[span]
        held = back.filter(F.col(s.measure) > 0).select((F.col(f"_{s.measure}_0") - F.col(s.measure)).alias("_start"), F.col(at).alias(name))
        out = out.join(held, F.when(F.col(span) > 0, low(s)) == held["_start"], "left").drop("_start")
    return out.select(key, at, *measures, *spans, *firsts)
