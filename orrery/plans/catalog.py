"""All registered queries over the reference's operators, with the SQL that must give the same rows.

"""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "a1_metric_aggregates"


def add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated function as a query; ``sql`` is its oracle."""

    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def _load() -> None:
    import orrery.plans as here

    for m in sorted(x.name for x in pkgutil.iter_modules(here.__path__) if x.name.startswith("catalog_")):
        importlib.import_module(f"orrery.plans.{m}")


_load()
