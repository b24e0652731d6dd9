"""All named queries and their SQL oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its DuckDB SQL where there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


for _name in ("vectors", "ranking", "texts", "evaluation", "recommendations", "catalogue", "histories", "evidence", "cards", "files", "labels"):
    importlib.import_module(f"matchforge.plans.{_name}")
