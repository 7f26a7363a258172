"""The market project's own graph, lineage and reports, and a small project's artifacts, against texts written by hand."""

import duckdb
import pytest

from loomwork.plans import graph_queries, operation_queries, quality_queries

from .conftest import SF
from .test_queries import rows

ORACLES = graph_queries.market_oracles()
BY_HAND = [*[(q, ORACLES[q.__name__]) for q in graph_queries.MARKET], *operation_queries.SHOP, (quality_queries.schema_diff, quality_queries.DIFF_SQL)]


@pytest.mark.parametrize("query, sql", BY_HAND, ids=lambda q: getattr(q, "__name__", ""))
def test_by_hand(query, sql, spark):
    assert rows(query(spark, SF).toPandas()) == rows(duckdb.sql(sql).df())
