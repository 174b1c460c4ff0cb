"""Name → query and name → oracle SQL. The query modules fill both when they are imported."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = ("search_queries", "rollup_queries", "rule_queries", "ingest_queries", "extract_queries", "stream_queries")


def load() -> None:
    for name in MODULES:
        import_module(f"tamarack.plans.{name}")
