"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewake.plans import fact_queries, graph_queries, link_queries, ops_queries, report_queries, search_queries, stream_queries

_MODULES = (graph_queries, report_queries, link_queries, fact_queries, search_queries, stream_queries, ops_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
