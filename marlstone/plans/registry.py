"""Queries over the driver's tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import core_queries, format_queries, lint_queries, record_queries, search_queries, source_queries, workflow_queries

MODULES = (core_queries, format_queries, workflow_queries, lint_queries, record_queries, source_queries, search_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
