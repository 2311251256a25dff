"""All queries of the core library and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of this folder that hold QUERIES and SQL.
MODULES = ("views", "scalars", "segmenting", "pdf", "models", "exchange")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        found |= import_module(f"folio.plans.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= import_module(f"folio.plans.{name}").SQL
    return found
