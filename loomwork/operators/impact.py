"""From an anomaly to its blast radius: traverse, prune, cover, score, plan - for many events at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.session import materialized, shuffled

from . import graph as g
from . import risk
from .events import SCHEMA_CHANGES


def affected(spark: SparkSession, graph: dict[str, DataFrame], lineage: DataFrame, events: DataFrame) -> DataFrame:
    """Nodes that each event (event_id, node_id, column_name, event_type) touches: origin, node, hops, confidence, and whether it was pruned.

    A column event follows column lineage (the best confidence and the fewest hops of
    all ways, found without listing them) and prunes other downstream models; if its column leads nowhere, all downstream models are affected and also
    listed as pruned. Other events reach all downstream models, one hop away. A test's event starts at the tested model.
    """
    tests = graph["graph_tests"].select("test_id", "target_id")
    known = graph["graph_nodes"].select(F.col("unique_id").alias("origin"))
    started = events.join(shuffled(tests), events["node_id"] == tests["test_id"], "left").withColumn("origin", F.coalesce("target_id", "node_id"))
    fine = materialized(started.join(shuffled(known), "origin", "left_semi").select("event_id", "origin", "column_name"), "started")
    models = g.dependent_models(graph, fine.select(F.col("origin").alias("id")))
    columns = fine.filter("column_name is not null").select("event_id", "origin", F.concat_ws(".", "origin", "column_name").alias("id"))
    ways = materialized(g.column_flow(lineage, columns), "column-flow").select(F.col("origin").alias("id"), F.col("node").alias("column_id"), "confidence", "hops")
    start = ways.groupBy("id").agg(F.max("confidence").alias("confidence")).select("id", F.col("id").alias("column_id"), "confidence", F.lit(0).alias("hops"))
    owner = graph["graph_columns"].select("column_id", F.col("node_id").alias("node"))
    flow = columns.join(shuffled(ways.unionByName(start)), "id").join(shuffled(owner), "column_id")
    flow = materialized(flow.groupBy("event_id", "origin", "node").agg(F.max("confidence").alias("confidence"), F.min("hops").alias("hops")), "flow")
    followed = flow.select("event_id").distinct().withColumn("followed", F.lit(True))
    told = fine.join(shuffled(followed), "event_id", "left")
    rest = told.join(shuffled(models), "origin").join(shuffled(flow.select("event_id", "node")), ["event_id", "node"], "left_anti")
    yes, no = F.lit(True), F.lit(False)
    listed = F.when(F.col("followed"), F.array(yes)).when(F.col("column_name").isNull(), F.array(no)).otherwise(F.array(no, yes))
    wide = rest.select("event_id", "origin", "node", "column_name", F.explode(listed).alias("pruned")).select(
        "event_id", "origin", "node", F.when(~F.col("pruned"), 1.0).alias("confidence"), F.when(~F.col("pruned") & F.col("column_name").isNull(), 1).alias("hops"), "pruned")
    own = told.filter("followed is null").select("event_id", "origin", F.col("origin").alias("node"), F.lit(1.0).alias("confidence"), F.lit(0).alias("hops"), no.alias("pruned"))
    return flow.withColumn("pruned", no).unionByName(own).unionByName(wide)


def unknown(graph: dict[str, DataFrame], events: DataFrame) -> DataFrame:
    """Events at a node that the graph does not have: an error row, no score."""
    ids = graph["graph_nodes"].select(F.col("unique_id").alias("node_id")).unionByName(graph["graph_tests"].select(F.col("test_id").alias("node_id")))
    return events.join(ids, "node_id", "left_anti").select("event_id", "node_id", F.lit("node not found").alias("error"), F.lit("low").alias("risk_level"))


def reached_by(graph: dict[str, DataFrame], nodes: DataFrame) -> DataFrame:
    """The exposures that the affected nodes and the origins of ``nodes`` reach, from one traversal."""
    return g.reached_exposures(graph, nodes.select(F.col("node").alias("id")).union(nodes.select("origin")))


def _edges_written(graph: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The graph with its edges written once, for all that walk or count them."""
    return graph | {"graph_edges": materialized(graph["graph_edges"], "edges")}


def scored(spark: SparkSession, graph: dict[str, DataFrame], lineage: DataFrame, events: DataFrame) -> DataFrame:
    """Every affected node of every event with its base and final score, in one join."""
    graph = _edges_written(graph)
    nodes = materialized(affected(spark, graph, lineage, events).filter("not pruned"), "affected")
    return scores(graph, events, nodes, reached_by(graph, nodes))


def scores(graph: dict[str, DataFrame], events: DataFrame, nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """Scores of the affected ``nodes``, given the exposures ``reached`` from them and their origins.

    What a node has, and what an event and its origin have, is put together first, so the pairs are joined twice.
    """
    urgent = reached.groupBy("origin").agg(F.bool_or(F.col("priority") == "high").alias("high_priority"))
    facts = (g.test_coverage(graph).select("node", "coverage").join(shuffled(g.fan_out(graph)), "node", "left").join(shuffled(g.nearest_exposure(reached).withColumnRenamed("origin", "node")), "node", "left")
             .join(shuffled(graph["graph_nodes"].select(F.col("unique_id").alias("node"), "materialized")), "node", "left"))
    facts = materialized(facts, "facts")
    about = nodes.select("event_id", "origin").distinct().join(shuffled(urgent), "origin", "left").join(shuffled(events.select("event_id", "event_type", "severity")), "event_id")
    rows = nodes.join(shuffled(facts), "node", "left").join(shuffled(about), ["event_id", "origin"])
    base = risk.base_score(F.coalesce("coverage", F.lit(0.0)), F.coalesce("fan_out", F.lit(0)), F.col("distance"), F.col("materialized"), F.col("event_type"))
    final = risk.in_context(base, F.col("severity"), F.col("confidence"), F.coalesce("hops", F.lit(0)), F.coalesce("high_priority", F.lit(False)))
    return rows.select("event_id", "event_type", "origin", "node", "coverage", F.coalesce("fan_out", F.lit(0)).alias("fan_out"), "distance", "hops", "confidence",
                       base.alias("base_score"), final.alias("score"))


def report(spark: SparkSession, graph: dict[str, DataFrame], lineage: DataFrame, events: DataFrame) -> DataFrame:
    """One row per event: level, counts, coverage gaps (below a half), the five worst nodes, exposures and planned actions.

    Each graph is walked once: what is affected, what it reaches, and the scores are written and read for all parts of the report.
    """
    graph = _edges_written(graph)
    everything = materialized(affected(spark, graph, lineage, events), "affected")
    nodes = everything.filter("not pruned")
    reached = materialized(reached_by(graph, nodes), "reached")
    rows = materialized(scores(graph, events, nodes, reached), "scores")
    worst = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), F.col("node"), F.col("score")))), 1, 5)
    gaps = F.array_sort(F.collect_set(F.when(F.col("coverage") < 0.5, F.struct("node", F.round("coverage", 2).alias("coverage")))))
    per = rows.groupBy("event_id", "event_type", "origin").agg(
        F.max("score").alias("max_score"), F.count("*").alias("n_affected"), F.count_if(F.col("coverage") < 0.5).alias("n_gaps"), gaps.alias("gaps"),
        F.transform(worst, lambda s: s["node"]).alias("top_nodes"), F.transform(worst, lambda s: F.struct(s["node"].alias("node"), F.round(s["score"], 3).alias("score"))).alias("top_scores"))
    shown = F.struct("exposure", "priority", "maturity", "exposure_type", "depth")
    asked = reached.join(shuffled(nodes.select("origin").distinct()), "origin", "left_semi")
    exposures = asked.groupBy("origin").agg(F.array_sort(F.collect_set("exposure")).alias("exposures"), F.array_sort(F.collect_set(shown)).alias("exposure_details"))
    cut = everything.filter("pruned").groupBy("event_id").agg(F.countDistinct("node").alias("n_pruned"))
    level = risk.level(F.col("max_score"))
    return (per.join(shuffled(exposures), "origin", "left").join(shuffled(cut), "event_id", "left").join(shuffled(staging_to_fix(graph, rows)), "event_id", "left")
            .withColumns({"risk_level": level, "n_pruned": F.coalesce("n_pruned", F.lit(0)), "actions": risk.actions(level, F.col("event_type"))})
            .withColumn("fix_eligible", F.exists("actions", lambda a: a["type"] == "github_pr") & F.col("event_type").isin(*SCHEMA_CHANGES)))


def payload(reports: DataFrame, events: DataFrame) -> DataFrame:
    """``event_id`` and ``payload``: a report's summary as JSON, with its event, for whoever writes the message."""
    about = events.select("event_id", F.struct(*[c for c in ("event_type", "severity", "node_id", "column_name") if c in events.columns]).alias("event"))
    body = F.struct("event", F.col("n_affected").alias("affected"), F.col("n_pruned").alias("pruned"), F.col("gaps").alias("coverage_gaps"), "risk_level",
                    F.col("top_scores").alias("top_risk_nodes"), F.col("exposure_details").alias("exposures"), F.transform("actions", lambda a: a["type"]).alias("actions"))
    return reports.join(about, "event_id").select("event_id", F.to_json(body).alias("payload"))


def with_fixes(spark: SparkSession, reports: DataFrame, drafts: DataFrame) -> DataFrame:
    """Reports with ``fix_sql`` from ``drafts(event_id, fix_sql)``; a pull request whose draft is missing or does not parse is taken from the actions. The reports are written once.

    Spark's parser is the driver's, so distinct drafts stream through it one
    partition at a time; it keeps the digests of those that do not parse.
    """
    reports = materialized(reports, "reports")
    asked = reports.filter("fix_eligible").join(shuffled(drafts), "event_id").select("event_id", "fix_sql")
    bad = [(r.digest,) for r in asked.select("fix_sql", F.sha2("fix_sql", 256).alias("digest")).distinct().toLocalIterator() if not valid_sql(spark, r.fix_sql)]
    fine = asked.filter("fix_sql is not null").join(spark.createDataFrame(bad, "digest string"), F.sha2("fix_sql", 256) == F.col("digest"), "left_anti")
    rows = reports.join(shuffled(fine), "event_id", "left")
    return rows.withColumn("actions", F.when(F.col("fix_sql").isNull(), F.filter("actions", lambda a: a["type"] != "github_pr")).otherwise(F.col("actions")))


def lanes(graph: dict[str, DataFrame], broken: DataFrame) -> DataFrame:
    """Status of every node for one event's ``broken(node, is_root)``: root, broken or healthy."""
    nodes = graph["graph_nodes"].select(F.col("unique_id").alias("node"), "name", "label", "layer")
    status = F.when(F.col("is_root"), "root").when(F.col("is_root").isNotNull(), "broken").otherwise("healthy")
    return nodes.join(broken, "node", "left").select("node", "name", "label", "layer", status.alias("status"))


def staging_to_fix(graph: dict[str, DataFrame], scored_nodes: DataFrame) -> DataFrame:
    """The first affected staging model of each event that has SQL to fix (fewest hops, then id).

    Graph tables without a column ``sql`` are of models written in code, any of which can be fixed.
    """
    nodes = graph["graph_nodes"].filter("layer = 'staging'")
    staging = (nodes.filter("sql <> ''") if "sql" in nodes.columns else nodes).select(F.col("unique_id").alias("node"))
    return scored_nodes.join(shuffled(staging), "node").groupBy("event_id").agg(F.min_by("node", F.struct(F.coalesce("hops", F.lit(0)), F.col("node"))).alias("model_id"))


def valid_sql(spark: SparkSession, sql: str | None) -> bool:
    """Whether a drafted fix parses; nothing is run."""
    try:
        spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception:  # noqa: BLE001 - any parser complaint means no
        return False
    return True
