"""Pieces of the oracle statements."""

from __future__ import annotations

from ledgerlark.sources.fixtures import AS_OF

PLANS: dict = {}
NOW = AS_OF
AT = AS_OF.split("'")[1]


def r(x: str, n: int = 2) -> str:
    return f"(floor(({x}) * {10**n}E0 + 0.5E0) / {10**n}E0)"


def pct(a: str, b: str, n: int = 2) -> str:
    return f"(CASE WHEN {b} > 0 THEN {r(f'{a} * 100E0 / {b}', n)} ELSE 0E0 END)"


def total(x: str, when: str | None = None) -> str:
    tail = f" FILTER (WHERE {when})" if when else ""
    return f"coalesce(CAST(sum(CAST({x} AS DECIMAL(18,2))){tail} AS DOUBLE), 0E0)"


def cnt(when: str) -> str:
    return f"count(*) FILTER (WHERE {when})"


def padded(x: str, width: int) -> str:
    return f"(CASE WHEN ({x}) < {10 ** (width - 1)} THEN lpad(CAST({x} AS VARCHAR), {width}, '0') ELSE CAST({x} AS VARCHAR) END)"


def big(x: str) -> str:
    return f"coalesce(CAST({x} AS BIGINT), 0)"


def last(days: int, column: str = "created_at") -> str:
    return f"{column} >= {NOW} - INTERVAL {days} DAY AND {column} <= {NOW}"


def hours(a: str, b: str) -> str:
    return f"((epoch_us({b}) - epoch_us({a})) / 3.6E9)"


def values(column: str, items: list[str]) -> str:
    return "(" + " UNION ALL ".join(f"SELECT '{v}' AS {column}" for v in items) + ")"
