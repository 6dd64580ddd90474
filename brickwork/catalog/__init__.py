"""Registered queries: every operator applied to the benchmark tables.

Each module fills a :class:`Registry`; an entry is a function of
(spark, directory) and, where plain SQL can say the same, the SQL text.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = (
    "retrofit",
    "ensembles",
    "sampling",
    "distributions",
    "hourly",
    "spatial",
    "tables",
    "files",
    "training",
    "exploration",
)

Query = Callable[[SparkSession, str], DataFrame]


def _collect() -> tuple[dict[str, Query], dict[str, str]]:
    found: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for name in MODULES:
        module = importlib.import_module(f"brickwork.catalog.{name}")
        found.update(module.REGISTRY.queries)
        sql.update(module.REGISTRY.sql)
    return found, sql


def queries() -> dict[str, Query]:
    return _collect()[0]


def oracle_sql() -> dict[str, str]:
    return _collect()[1]
