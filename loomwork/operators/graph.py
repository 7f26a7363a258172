"""The property graph as tables, and its traversals as recursive queries.

Nodes and edges are built from the registry, or from a project's artifacts.
What is reachable is found by a frontier that leaves out what was seen. Where
the paths themselves are asked for, each hop is a join that carries the path, so that no trail meets a node
twice, at most ``DEPTH`` of them. Every hop is written. Edges with an end that is no node are dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.plans.registry import Project
from loomwork.session import materialized, shuffled
from loomwork.sources.versions import Versions

DEPTH = 15
NODES = "unique_id string, name string, label string, layer string, materialized string, description string, row_count long, priority string, maturity string, exposure_type string"
EDGES = "source_id string, target_id string, edge_type string"
TESTS = "test_id string, target_id string, column_name string, test_type string"
COLUMNS = "column_id string, node_id string, column_name string, data_type string"


def node_rows(project: Project) -> list[tuple]:
    """Source, model and exposure nodes; seeds and snapshots would be models too."""
    rows = [(project.node_id(s), s, "Source", None, None, None, None, None, None, None) for s in project.sources]
    rows += [(project.node_id(m.name), m.name, "Model", m.layer, m.materialized, m.description, None, None, None, None) for m in project.models.values()]
    rows += [(project.node_id(e.name), e.name, "Exposure", None, None, None, None, e.priority, e.maturity, e.kind) for e in project.exposures.values()]
    return rows


def edge_rows(project: Project) -> list[tuple[str, str, str]]:
    """(upstream, downstream, kind): ref, source, consumes."""
    rows = []
    for model in project.models.values():
        rows += [(project.node_id(i), project.node_id(model.name), "source" if i in project.sources else "ref") for i in model.inputs]
    for exposure in project.exposures.values():
        rows += [(project.node_id(i), project.node_id(exposure.name), "consumes") for i in exposure.inputs]
    return rows


def test_rows(project: Project) -> list[tuple[str, str, str, str]]:
    """Custom tests belong to their model, the others to a column of it."""
    return [(f"test.{project.name}.{t.name}", project.node_id(t.model), None if t.kind == "custom" else t.column, t.kind) for t in project.tests]


def column_rows(project: Project, frames: dict[str, DataFrame]) -> list[tuple[str, str, str, str]]:
    """A row per column, typed by the built frame's schema."""
    return [(f"{project.node_id(n)}.{f.name}", project.node_id(n), f.name, f.dataType.simpleString()) for n, df in frames.items() for f in df.schema.fields]


def frames_of(spark: SparkSession, nodes: list[tuple], edges: list[tuple], tests: list[tuple], columns: list[tuple]) -> dict[str, DataFrame]:
    """The four tables, one row per id; edges only between known nodes."""
    n = spark.createDataFrame(nodes, NODES).dropDuplicates(["unique_id"])
    ids = n.select("unique_id")
    e = spark.createDataFrame(edges, EDGES).distinct()
    e = e.join(ids, e["source_id"] == ids["unique_id"], "left_semi").join(ids, e["target_id"] == ids["unique_id"], "left_semi")
    return {"graph_nodes": n, "graph_edges": e, "graph_tests": spark.createDataFrame(tests, TESTS).dropDuplicates(["test_id"]),
            "graph_columns": spark.createDataFrame(columns, COLUMNS).dropDuplicates(["column_id"])}


def write_graph(graph: dict[str, DataFrame], lineage: DataFrame, folder: str) -> dict[str, int]:
    """Replace the stored graph under ``folder`` (nodes, edges, tests, columns, lineage), a row per id; the number of rows of each.

    All five are committed together as a version; a failure leaves the old one. Column edges need both columns. The numbers come from the files written.
    """
    keys = {"graph_nodes": ["unique_id"], "graph_edges": ["source_id", "target_id", "edge_type"], "graph_tests": ["test_id"], "graph_columns": ["column_id"]}
    ids = graph["graph_columns"].select("column_id")
    ends = [F.concat_ws(".", f"{side}_node", f"{side}_column") for side in ("up", "down")]
    known = lineage.join(ids.toDF("up_id"), ends[0] == F.col("up_id"), "left_semi").join(ids.toDF("down_id"), ends[1] == F.col("down_id"), "left_semi")
    parts = {n: df.dropDuplicates(keys[n]) for n, df in graph.items()} | {"graph_lineage": known.distinct()}
    store = Versions(lineage.sparkSession, folder)
    version = store.replace(parts)
    return {name: store.read(name, version.number).count() for name in parts}


def read_graph(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, DataFrame]:
    """The graph tables that :func:`write_graph` stored (in a version)."""
    store = Versions(spark, folder)
    number = store.latest().number if version is None else version
    return {n: store.read(n, number) for n in ("graph_nodes", "graph_edges", "graph_tests", "graph_columns", "graph_lineage")}


def traverse(edges: DataFrame, roots: DataFrame, upstream: bool = False) -> DataFrame:
    """All trails of 1 to ``DEPTH`` hops from ``roots(id)``: origin, node, depth, path. Every prefix of a trail is a trail."""
    start, goal = ("target_id", "source_id") if upstream else ("source_id", "target_id")
    return _trails(edges.select(F.col(start).alias("node"), F.col(goal).alias("next"), F.lit(1.0).alias("edge")), roots).drop("confidence")


def _trails(steps: DataFrame, roots: DataFrame) -> DataFrame:
    """The trails along ``steps(node, next, edge)``, a written table for each hop, with the least edge on the way as ``confidence``."""
    steps = materialized(steps, "steps")
    frontier = roots.select(F.col("id").alias("origin"), F.col("id").alias("node"), F.lit(0).alias("depth"), F.array("id").alias("path"), F.lit(float("inf")).alias("confidence")).distinct()
    parts = [frontier]
    for _ in range(DEPTH):
        longer = frontier.join(steps, "node").filter(~F.array_contains("path", F.col("next")))
        frontier = materialized(longer.select("origin", F.col("next").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("next")).alias("path"), F.least("confidence", "edge").alias("confidence")), "trails")
        if frontier.isEmpty():
            break
        parts.append(frontier)
    return reduce(DataFrame.unionByName, parts[1:] or parts).filter("depth > 0")


def reachable(edges: DataFrame, roots: DataFrame, upstream: bool = False) -> DataFrame:
    """Every node within ``DEPTH`` hops of ``roots(id)``: origin, node, and the fewest hops.

    With a column ``origin`` the roots that share one are walked from together. A frontier moves hop by hop and leaves out what was seen, so the work is at
    most the edges that each root reaches, however many trails lead there. A
    root is not reached from itself.
    """
    start, goal = ("target_id", "source_id") if upstream else ("source_id", "target_id")
    steps = materialized(edges.select(F.col(start).alias("node"), F.col(goal).alias("next")).distinct(), "steps")
    frontier = roots.select(F.col("origin" if "origin" in roots.columns else "id").alias("origin"), F.col("id").alias("node")).distinct()
    parts = [frontier.withColumn("depth", F.lit(0))]
    for depth in range(1, DEPTH + 1):
        seen = reduce(DataFrame.unionByName, parts)
        fresh = frontier.join(shuffled(steps), "node").select("origin", F.col("next").alias("node")).distinct().join(shuffled(seen), ["origin", "node"], "left_anti")
        frontier = materialized(fresh, "frontier")
        if frontier.isEmpty():
            break
        parts.append(frontier.withColumn("depth", F.lit(depth)))
        if len(parts) > 4:  # what was seen is one table again
            parts = [materialized(reduce(DataFrame.unionByName, parts), "seen")]
    return reduce(DataFrame.unionByName, parts).filter("depth > 0")


def column_flow(lineage: DataFrame, roots: DataFrame, backward: bool = False) -> DataFrame:
    """How each column that ``roots(id)`` reach over column edges is reached: origin, node (column id), confidence and hops.

    ``confidence`` is the largest, over all ways of at most ``DEPTH`` hops, of the
    least on the way, ``hops`` the fewest. No way is listed: a frontier holds the columns whose
    confidence has risen in the last hop, so the work is at most ``DEPTH``
    times the edges that each root reaches, however many ways lead there. A root does not reach itself.
    """
    up, down = (F.concat_ws(".", f"{side}_node", f"{side}_column") for side in ("up", "down"))
    steps = lineage.select((down if backward else up).alias("node"), (up if backward else down).alias("next"), F.col("confidence").alias("edge"))
    return widest(steps.groupBy("node", "next").agg(F.max("edge").alias("edge")), roots)


def widest(steps: DataFrame, roots: DataFrame, compact: int = 4) -> DataFrame:
    """:func:`column_flow` over ``steps(node, next, edge)``, an edge a row. What was seen is one table again every ``compact`` hops."""
    steps = materialized(steps, "steps")
    frontier = roots.select(F.col("id").alias("origin"), F.col("id").alias("node")).distinct().withColumn("confidence", F.lit(float("inf")))
    parts: list[DataFrame] = []
    for depth in range(1, DEPTH + 1):
        found = frontier.join(shuffled(steps), "node").filter(F.col("next") != F.col("origin"))
        found = found.groupBy("origin", F.col("next").alias("node")).agg(F.max(F.least("confidence", "edge")).alias("confidence"))
        if parts:
            known = _merged(parts).select("origin", "node", F.col("confidence").alias("_known"))
            found = found.join(shuffled(known), ["origin", "node"], "left").filter("_known is null or confidence > _known").drop("_known")
        frontier = materialized(found.withColumn("hops", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        parts.append(frontier)
        if len(parts) > compact:
            parts = [materialized(_merged(parts), "flow")]
    return _merged(parts) if parts else frontier


def _merged(parts: list[DataFrame]) -> DataFrame:
    """The best confidence and the fewest hops of each (origin, node)."""
    if len(parts) == 1:
        return parts[0]
    return reduce(DataFrame.unionByName, parts).groupBy("origin", "node").agg(F.max("confidence").alias("confidence"), F.min("hops").alias("hops"))


def dependent_models(graph: dict[str, DataFrame], roots: DataFrame, upstream: bool = False) -> DataFrame:
    """Distinct models and sources reached from each root, with the fewest hops."""
    return reachable(graph["graph_edges"].filter("edge_type in ('ref', 'source')"), roots, upstream)


def paths_to_exposures(graph: dict[str, DataFrame], roots: DataFrame) -> DataFrame:
    """All trails that end in an exposure, with its properties."""
    found = graph["graph_nodes"].filter("label = 'Exposure'").select("unique_id", F.col("name").alias("exposure"), "priority", "maturity", "exposure_type")
    trails = traverse(graph["graph_edges"], roots)
    return trails.join(found, trails["node"] == found["unique_id"]).drop("unique_id")


def reached_exposures(graph: dict[str, DataFrame], roots: DataFrame) -> DataFrame:
    """The exposures that each root reaches, with the fewest hops (``depth``) and their properties. The walk begins at whichever are fewer, roots or exposures."""
    found = graph["graph_nodes"].filter("label = 'Exposure'").select(F.col("unique_id").alias("node"), F.col("name").alias("exposure"), "priority", "maturity", "exposure_type")
    ids = materialized(roots.select("id").distinct(), "roots")
    ends = found.select(F.col("node").alias("id"))
    if ends.count() < ids.count():
        back = reachable(graph["graph_edges"], ends, upstream=True).select(F.col("node").alias("origin"), F.col("origin").alias("node"), "depth")
        return back.join(shuffled(ids.select(F.col("id").alias("origin"))), "origin", "left_semi").join(found, "node")
    return reachable(graph["graph_edges"], ids).join(found, "node")


def nearest_exposure(reached: DataFrame) -> DataFrame:
    """Hops to the nearest exposure of each origin; origins without one have no row."""
    return reached.groupBy("origin").agg(F.min("depth").alias("distance"))


def exposure_distances(graph: dict[str, DataFrame]) -> DataFrame:
    """Hops from every node to the nearest exposure, by one walk upstream from all exposures together; nodes that reach none have no row."""
    exposures = graph["graph_nodes"].filter("label = 'Exposure'").select(F.col("unique_id").alias("id"), F.lit("exposure").alias("origin"))
    return reachable(graph["graph_edges"], exposures, upstream=True).select("node", F.col("depth").alias("distance"))


def fan_out(graph: dict[str, DataFrame]) -> DataFrame:
    """Distinct direct dependents of each node, exposures not counted."""
    return (graph["graph_edges"].filter("edge_type in ('ref', 'source')").groupBy(F.col("source_id").alias("node"))
            .agg(F.countDistinct("target_id").alias("fan_out")))


def test_coverage(graph: dict[str, DataFrame]) -> DataFrame:
    """Tested columns over columns, and the tests, for every node; 0 where it has no columns."""
    tests = graph["graph_tests"].groupBy("target_id", "column_name").agg(F.collect_set(F.struct("test_id", "test_type")).alias("own"))
    columns = graph["graph_columns"]
    both = columns.join(shuffled(tests), (columns["node_id"] == tests["target_id"]) & (columns["column_name"] == tests["column_name"]), "left")
    per = both.groupBy("node_id").agg(F.count("*").alias("n_columns"), F.count("own").alias("n_tested"), F.array_sort(F.flatten(F.collect_list("own"))).alias("tests"))
    nodes = graph["graph_nodes"].select(F.col("unique_id").alias("node"))
    share = F.when(F.col("n_columns") > 0, F.col("n_tested") / F.col("n_columns")).otherwise(0.0)
    return nodes.join(shuffled(per), nodes["node"] == per["node_id"], "left").select(
        "node", F.coalesce("n_columns", F.lit(0)).alias("n_columns"), F.coalesce("n_tested", F.lit(0)).alias("n_tested"), F.coalesce(share, F.lit(0.0)).alias("coverage"), "tests")


def tested_model(graph: dict[str, DataFrame], test_id: str) -> DataFrame:
    """The node that a test is attached to."""
    return graph["graph_tests"].filter(F.col("test_id") == test_id).select("test_id", F.col("target_id").alias("model_id"))


def node_metadata(graph: dict[str, DataFrame], unique_id: str) -> DataFrame:
    """One node's properties as a map without nulls and empty texts; no row if there is no such node."""
    rows = graph["graph_nodes"].filter(F.col("unique_id") == unique_id)
    entries = F.map_from_entries(F.array(*[F.struct(F.lit(c), F.col(c).cast("string")) for c in rows.columns]))
    return rows.select("unique_id", F.map_filter(entries, lambda _, v: v.isNotNull() & (v != "")).alias("properties"))


def column_trails(lineage: DataFrame, roots: DataFrame, backward: bool = False) -> DataFrame:
    """Trails over column edges from ``roots(id)``, where ids are node.column: origin, node, depth, path, and the least confidence on the way.

    For whoever asks for the ways themselves; how a column is reached is :func:`column_flow`.
    """
    up, down = (F.concat_ws(".", f"{side}_node", f"{side}_column") for side in ("up", "down"))
    return _trails(lineage.select((down if backward else up).alias("node"), (up if backward else down).alias("next"), F.col("confidence").alias("edge")), roots)
