"""Column helpers that all jobs share."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 2) -> Column:
    """floor(x * 10^n + 0.5) / 10^n as double: the same in any engine, unlike ``round`` on doubles."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def money(x: Column) -> Column:
    """Amounts are summed as decimals, so that sums don't depend on the order of rows."""
    return x.cast("decimal(18,2)")


def cents(x: Column) -> Column:
    """An amount as a whole number of hundredths; all amounts of a table may sum up to 92 million billions."""
    return (money(x) * 100).cast("long")


def dollars_of(n: Column) -> Column:
    """A sum of ``cents`` as a double."""
    return (n.cast("decimal(20,0)") * F.lit(0.01).cast("decimal(3,2)")).cast("double")


def total(x: Column, when: Column | None = None) -> Column:
    return F.coalesce(F.sum(money(x) if when is None else F.when(when, money(x))), F.lit(0)).cast("double")


def count_if(test: Column) -> Column:
    return F.count(F.when(test, F.lit(1)))


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, rounded; 0 where there is nothing."""
    return F.when(whole > 0, rounded(part * F.lit(100.0) / whole, digits)).otherwise(F.lit(0.0))


def stamp(as_of: dt.datetime | str) -> Column:
    return F.lit(str(as_of)).cast("timestamp")


def ago(as_of: dt.datetime | str, **span: int) -> Column:
    """``ago(t, days=30)``, ``ago(t, hours=24)``"""
    (unit, n), = span.items()
    return F.expr(f"TIMESTAMP '{as_of}' - INTERVAL '{n}' {unit[:-1].upper()}")


def padded(n: Column, width: int) -> Column:
    """A number with leading zeros up to ``width`` digits; longer ones stay whole."""
    text = n.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(3.6e9)


def fixed_values(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """One row for each of a fixed set of values, in ``column``."""
    return df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
