"""Named queries over the test tables, each with its SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``fn(spark, folder)`` under ``name`` together with its SQL twin."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def load_all() -> tuple[dict[str, Query], dict[str, str]]:
    """Import every plan module and return the filled registries."""
    import importlib
    import pkgutil

    from webfacts import plans

    for mod in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
        importlib.import_module(f"webfacts.plans.{mod}")
    return QUERIES, ORACLES
