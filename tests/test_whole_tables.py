"""Queries that compute a row per part return one for every part."""

import duckdb
import pytest

from loomwork.plans import catalog

from .test_queries import rows

LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["keys_and_names", "executions", "risk_scores"])
def test_query_covers_all_parts(name, spark):
    con = duckdb.connect()
    con.execute(f"create view part as select * from read_parquet('{LARGER}/part.parquet')")
    ours, theirs = catalog.queries()[name](spark, LARGER).toPandas(), con.sql(catalog.oracle_sql()[name]).df()
    assert len(ours) == con.execute("select count(*) from part").fetchall()[0][0]
    assert rows(ours) == rows(theirs)
