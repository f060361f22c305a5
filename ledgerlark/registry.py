"""Names of all queries, with the SQL that states the same rows."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlark import plans
from ledgerlark.sources.fixtures import Tables, with_views

Query = Callable[[SparkSession, str], DataFrame]


def _plans() -> dict[str, tuple[Callable[[Tables], DataFrame], str | None]]:
    found: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}
    for module in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
        found |= importlib.import_module(f"{plans.__name__}.{module}").PLANS
    return found


def queries() -> dict[str, Query]:
    def over(plan: Callable[[Tables], DataFrame]) -> Query:
        return lambda spark, sf_dir: plan(Tables(spark, sf_dir))

    return {name: over(plan) for name, (plan, _) in _plans().items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, (_, sql) in _plans().items() if sql}
