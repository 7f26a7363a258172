"""The artifacts of an existing project (manifest, catalog, run results) as graph tables.

An artifact is one JSON document whose maps are keyed by id. It is read as text
from any store that Spark reads, parsed with a schema that names only what is
used, and its maps become rows by ``explode``; what follows is joins and
aggregates. Unknown fields are ignored, missing ones are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.columns import test_kind
from loomwork.operators.events import event

_COLUMNS = "map<string, struct<description string, data_type string>>"
_DEPENDS = "depends_on struct<nodes array<string>>"
MANIFEST = f"""nodes map<string, struct<resource_type string, name string, schema string, database string, fqn array<string>, tags array<string>, description string,
    compiled_code string, config struct<materialized string, meta struct<owner string>>, columns {_COLUMNS}, {_DEPENDS},
    attached_node string, column_name string, test_metadata struct<kwargs struct<column_name string>>>>,
  sources map<string, struct<name string, schema string, database string, tags array<string>, description string, meta struct<owner string>, columns {_COLUMNS}>>,
  exposures map<string, struct<name string, type string, maturity string, tags array<string>, description string, owner string, meta struct<priority string>, {_DEPENDS}>>"""
_STAT = "struct<include boolean, value string>"
_CATALOG_NODE = f"map<string, struct<columns map<string, struct<type string>>, stats struct<row_count {_STAT}, num_rows {_STAT}>>>"
CATALOG = f"nodes {_CATALOG_NODE}, sources {_CATALOG_NODE}"
RESULTS = "results array<struct<unique_id string, status string, failures long>>"

SOURCES = "results array<struct<unique_id string, status string, max_loaded_at string, snapshotted_at string, criteria string>>"

#: What counts as a model, and the directories that are layers.
MODEL_KINDS, LAYERS = ("model", "seed", "snapshot"), ("staging", "intermediate", "marts")
PREFIXES = {"stg_": "staging", "int_": "intermediate", "fct_": "marts", "dim_": "marts"}


def document(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file as one row with its text."""
    return spark.read.text(path, wholetext=True)


def _parsed(text: DataFrame, schema: str) -> DataFrame:
    return text.select(F.from_json("value", schema).alias("j")).select("j.*")


def _each(parsed: DataFrame, field: str) -> DataFrame:
    """A row per entry of a map: ``unique_id``, ``position`` and the entry's fields."""
    return parsed.select(F.posexplode(field).alias("position", "unique_id", "e")).select("unique_id", "position", "e.*")


def label_of(kind: Column) -> Column:
    """Seeds and snapshots are models in the graph."""
    return F.when(kind.isin(*MODEL_KINDS), "Model").when(kind == "source", "Source").when(kind == "exposure", "Exposure")


def layer_in(path: Column, name: Column) -> Column:
    """The first directory of ``path`` that is a layer, else what the name's prefix says, else null."""
    found = F.get(F.filter(path, lambda p: p.isin(*LAYERS)), F.lit(0))
    return F.coalesce(found, *[F.when(name.startswith(p), F.lit(layer)) for p, layer in PREFIXES.items()])


def row_count(stats: Column) -> Column:
    """The row count of a catalog entry, from either name; null if it is not included or no whole number."""
    stat = F.coalesce(stats["row_count"], stats["num_rows"])
    whole = F.regexp_extract(stat["value"], r"^\s*([+-]?\d+)(\.0*)?\s*$", 1)
    return F.when(stat["include"], whole.try_cast("bigint"))


def merged_columns(entries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Columns of ``entries(unique_id, columns)``: those of the manifest in order, then those only the catalog has; the catalog's type wins."""
    ours = entries.select("unique_id", F.posexplode_outer("columns").alias("ours", "column_name", "c")).filter("column_name is not null")
    ours = ours.select("unique_id", "column_name", "ours", F.col("c.data_type").alias("declared"), F.col("c.description").alias("description"))
    theirs = catalog.select("unique_id", F.posexplode_outer("columns").alias("theirs", "column_name", "c")).filter("column_name is not null")
    theirs = theirs.select("unique_id", "column_name", "theirs", F.col("c.type").alias("built")).join(entries.select("unique_id"), "unique_id", "left_semi")
    both = ours.join(theirs, ["unique_id", "column_name"], "full_outer")
    kind = F.coalesce(F.when(F.col("built") != "", F.col("built")), F.col("declared"))
    return both.select("unique_id", "column_name", kind.alias("data_type"), F.coalesce("description", F.lit("")).alias("description"),
                       F.struct(F.col("ours").isNull(), F.coalesce("ours", "theirs")).alias("place"))


def graph_tables(manifest: DataFrame, catalog: DataFrame) -> dict[str, DataFrame]:
    """The four graph tables of a manifest and a catalog, each a row with the document's text.

    ``graph_nodes`` also has owner, tags, schema, database and SQL. A test
    belongs to the node that it is attached to, else to the first that it
    depends on; without either it is left out. Edges point downstream; those
    with an end that is no node are left out.
    """
    parsed, built = _parsed(manifest, MANIFEST), _parsed(catalog, CATALOG)
    entries, given, shown = (_each(parsed, f) for f in ("nodes", "sources", "exposures"))
    stats = _each(built, "nodes").unionByName(_each(built, "sources")).select("unique_id", "columns", row_count(F.col("stats")).alias("row_count"))
    none = F.lit(None).cast("string")
    models = entries.filter(F.col("resource_type").isin(*MODEL_KINDS))
    owner = F.coalesce(F.get_json_object("owner", "$.name"), F.when(~F.col("owner").startswith("{"), F.col("owner")))
    nodes = models.select("unique_id", "resource_type", "name", layer_in(F.col("fqn"), F.col("name")).alias("layer"), F.col("config.materialized").alias("materialized"), "description",
                          F.col("config.meta.owner").alias("owner"), "tags", "schema", "database", F.col("compiled_code").alias("sql"), none.alias("priority"), none.alias("maturity"), none.alias("exposure_type"))
    nodes = nodes.unionByName(given.select("unique_id", F.lit("source").alias("resource_type"), "name", "description", F.col("meta.owner").alias("owner"), "tags", "schema", "database"), allowMissingColumns=True)
    nodes = nodes.unionByName(shown.select("unique_id", F.lit("exposure").alias("resource_type"), "name", "description", owner.alias("owner"), "tags", F.col("meta.priority").alias("priority"),
                                           "maturity", F.col("type").alias("exposure_type")), allowMissingColumns=True)
    nodes = nodes.withColumns({"label": label_of(F.col("resource_type")), "description": F.coalesce("description", F.lit(""))}).join(stats.drop("columns"), "unique_id", "left")
    up = lambda df, kind: df.select(F.explode("depends_on.nodes").alias("source_id"), F.col("unique_id").alias("target_id"), kind.alias("edge_type"))
    kind = F.when(F.col("source_id").startswith("source."), "source").otherwise("ref")
    edges = up(models, F.lit("")).withColumn("edge_type", kind).unionByName(up(shown, F.lit("consumes"))).distinct()
    ids = nodes.select("unique_id")
    edges = edges.join(ids, edges["source_id"] == ids["unique_id"], "left_semi").join(ids, edges["target_id"] == ids["unique_id"], "left_semi")
    target = F.coalesce(F.when(F.col("attached_node") != "", F.col("attached_node")), F.get(F.col("depends_on.nodes"), F.lit(0)))
    column = F.coalesce(F.when(F.col("column_name") != "", F.col("column_name")), F.col("test_metadata.kwargs.column_name"))
    tests = entries.filter("resource_type = 'test'").select(F.col("unique_id").alias("test_id"), target.alias("target_id"), column.alias("column_name"), test_kind("unique_id").alias("test_type"))
    owned = models.select("unique_id", "columns").unionByName(given.select("unique_id", "columns"))
    columns = merged_columns(owned, stats).select(F.concat_ws(".", "unique_id", "column_name").alias("column_id"), F.col("unique_id").alias("node_id"), "column_name", "data_type", "description", "place")
    return {"graph_nodes": nodes, "graph_edges": edges, "graph_tests": tests.filter("target_id is not null"), "graph_columns": columns}


def run_results(results: DataFrame) -> DataFrame:
    """``kind``, ``unique_id``, ``status``, ``failures`` of each entry of a run-results document."""
    rows = _parsed(results, RESULTS).select(F.inline("results"))
    return rows.select(F.split("unique_id", r"\.")[0].alias("kind"), "unique_id", "status", "failures")


def source_results(sources: DataFrame) -> DataFrame:
    """``unique_id``, ``status`` (lower case), ``max_loaded_at``, ``snapshotted_at`` and ``criteria`` (JSON) of each entry of a source-freshness document."""
    rows = _parsed(sources, SOURCES).select(F.inline("results"))
    return rows.withColumn("status", F.lower("status"))


def freshness_events(sources: DataFrame) -> DataFrame:
    """Events of the sources that a freshness document reports as late, failed or never loaded; entries of other statuses give none."""
    status = F.col("status")
    severity = F.when(status == "warn", "warning").when(status.isin("error", "runtime error"), "error")
    rows = source_results(sources).withColumn("unique_id", F.coalesce("unique_id", F.lit("")))
    message = F.concat(F.lit("Source "), F.col("unique_id"), F.lit(" freshness "), status, F.lit(": last loaded "), F.coalesce("max_loaded_at", F.lit("never")))
    return event(rows.filter(severity.isNotNull()), "freshness_violation", severity, "unique_id", None, None, F.col("max_loaded_at"), message,
                 snapshotted_at=F.col("snapshotted_at"), criteria=F.col("criteria"), status=status)
