"""No side of a join that grows with the graph is broadcast, however small its files look to Spark."""

import pytest

from loomwork.operators import graph, impact
from loomwork.plans import trade_queries as t

from .conftest import SF


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that operators write meanwhile."""
    seen = []
    for module in (graph, impact):
        write = module.materialized
        monkeypatch.setattr(module, "materialized", lambda df, label, write=write: seen.append(plan(df)) or write(df, label))
    return seen


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blast_radius_broadcasts_nothing(spark, plans):
    plans.append(plan(t.blast_radius(spark, SF)))
    assert len(plans) > 8 and not [p for p in plans if "BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p]


def test_blast_scores_broadcast_exposures_at_most(spark, plans):
    plans.append(plan(t.blast_scores(spark, SF)))
    assert max(p.count("BroadcastHashJoin") for p in plans) <= 1 and not [p for p in plans if "BroadcastHashJoin [origin" in p]


@pytest.mark.parametrize("n_roots", [1, 3])
def test_exposures_are_the_same_from_either_end(spark, n_roots):
    node = lambda i, label: (i, i, label, None, None, None, None, "high", None, None)
    nodes = spark.createDataFrame([node("a", "Model"), node("b", "Model"), node("e", "Exposure"), node("f", "Exposure")], graph.NODES)
    edges = spark.createDataFrame([("a", "b", "ref"), ("a", "e", "consumes"), ("b", "e", "consumes"), ("b", "f", "consumes"), ("f", "e", "consumes"), ("b", "a", "ref")], graph.EDGES)
    roots = spark.createDataFrame([("a",), ("b",), ("f",)][:n_roots], "id string")
    found = {(r.origin, r.node, r.depth) for r in graph.reached_exposures({"graph_nodes": nodes, "graph_edges": edges}, roots).collect()}
    assert found == {(o, n, d) for o, n, d in {("a", "e", 1), ("a", "f", 2), ("b", "e", 1), ("b", "f", 1), ("f", "e", 1)} if o in "abf"[:n_roots]}


def test_impact_reports_score_once_and_broadcast_exposures_at_most(spark, plans):
    plans.append(plan(t.impact_reports(spark, SF)))
    assert max(p.count("BroadcastHashJoin") for p in plans) <= 1 and "BroadcastHashJoin" not in plans[-1]
    assert sum(" AS score#" in p for p in plans) == 1


def test_drafts_read_written_reports(spark, plans):
    out = plan(t.drafted_fixes(spark, SF))
    assert "BroadcastHashJoin [event_id" not in out and "Aggregate" not in out and any("max_score" in p for p in plans)
