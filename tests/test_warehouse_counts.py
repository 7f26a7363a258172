"""Counts along the warehouse's columns read what the answer needs, each model over all its rows."""

from loomwork.operators import profile
from loomwork.plans import registry
from loomwork.plans import trade_queries as t

from .conftest import SF


def test_filled_counts_are_those_of_the_profile_at_less_work(spark):
    df = spark.createDataFrame([("a", None, "x"), ("b", 1.5, None), (None, float("nan"), None)], "a string, `b c` double, _extracted_at string")
    name = "stg_coingecko__exchanges"
    filled = t._filled({name: df})
    profiled = profile.profile(df, t.project.node_id(name)).selectExpr("table_name", "column_name", "row_count - null_count")
    assert sorted(filled.select("node", "column_name", "n_filled").collect()) == sorted(profiled.collect())
    assert "stddev" not in filled._jdf.queryExecution().analyzed().toString()


def built(spark, monkeypatch, query):
    """The models that a query writes, and the plan of its result."""
    written = []
    write = registry.materialized
    monkeypatch.setattr(registry, "materialized", lambda df, label: written.append(label) or write(df, label))
    return written, query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_price_lineage_counts_models_on_the_trails(spark, monkeypatch):
    written, plan = built(spark, monkeypatch, t.price_lineage)
    assert written == ["int_token_profiles"] and "apyBase" not in plan


def test_price_origin_writes_no_model(spark, monkeypatch):
    written, plan = built(spark, monkeypatch, t.price_origin)
    assert not written and "gasUsed" not in plan and "o_orderkey" not in plan


def test_lineage_edges_computes_the_newest_rows_once(spark, monkeypatch):
    written, plan = built(spark, monkeypatch, t.lineage_edges)
    assert {"stg_etherscan__transactions", "stg_etherscan__token_transfers", "int_token_profiles", "int_whale_activity"} <= set(written) and "stddev" not in plan
