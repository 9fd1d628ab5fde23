"""All queries of the core by name, each with the SQL it is compared with where SQL can state it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("corpus_queries", "scan_queries", "token_queries", "metric_queries", "further_queries", "pipeline_queries")


def _every(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(importlib.import_module(f"foliant.plans.{module}"), name)
    return out


def queries() -> dict[str, Query]:
    return _every("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _every("SQL")
