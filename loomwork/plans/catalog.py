"""All queries of the library, with the SQL that each is compared against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import graph_queries, market_queries, operation_queries, quality_queries, store_queries, trade_queries

PARTS = (market_queries, quality_queries, graph_queries, operation_queries, trade_queries, store_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for part in PARTS for name, query in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.oracle_sql().items()}
