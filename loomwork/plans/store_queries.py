"""Queries and oracle SQL of artifacts, schemas and stored state, over documents and tables derived from the given ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.operators import events, inject, profile, schema
from loomwork.operators.incidents import suppress
from loomwork.session import shared_path, table
from loomwork.sources import artifacts, records
from loomwork.sources.memory import IncidentMemory

from . import graph_queries as q
from . import quality_queries as quality


def _ids(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A manifest and a catalog for each nation: its suppliers as models with a test each, the nation as their source, an exposure that shows them all."""
    key = F.col("s_suppkey")
    items = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    s = table(spark, sf_dir, "supplier").join(items, key == F.col("l_suppkey"), "left")
    name = F.concat(F.when(key % 3 == 0, "stg_s").when(key % 3 == 1, "fct_s").otherwise("raw_s"), key.cast("string"))
    path = F.array_compact(F.array(F.lit("shop"), F.when(key % 5 == 0, "intermediate"), name))
    column = F.create_map(F.lit("balance"), F.struct(F.lit("owed").alias("description"), F.lit("double").alias("data_type")), F.lit("note"), F.struct(F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("data_type")))
    none = F.lit(None).cast("string")
    model = F.struct(
        F.lit("model").alias("resource_type"), name.alias("name"), path.alias("fqn"), F.array(F.lit("daily")).alias("tags"), F.col("s_name").alias("description"), F.lit("select 1").alias("compiled_code"),
        F.struct(F.when(F.col("s_acctbal") > 0, "view").otherwise("table").alias("materialized"), F.struct(F.when(key % 7 > 0, _ids("o", "s_nationkey")).alias("owner")).alias("meta")).alias("config"), column.alias("columns"),
        F.struct(F.array(_ids("source.shop.n", "s_nationkey"), F.concat(F.lit("model.shop.s"), (key - 1).cast("string")), F.lit("model.shop.gone")).alias("nodes")).alias("depends_on"), none.alias("attached_node"), none.alias("column_name"))
    test = F.struct(
        F.lit("test").alias("resource_type"), F.lit("t").alias("name"), F.array(F.lit("shop")).alias("fqn"), F.array(F.lit("daily")).alias("tags"), none.alias("description"), none.alias("compiled_code"),
        F.struct(none.alias("materialized"), F.struct(none.alias("owner")).alias("meta")).alias("config"), F.lit(None).cast("map<string, struct<description: string, data_type: string>>").alias("columns"),
        F.struct(F.array(_ids("model.shop.s", "s_suppkey")).alias("nodes")).alias("depends_on"), F.when(key % 2 == 0, _ids("model.shop.s", "s_suppkey")).alias("attached_node"), F.when(key % 4 > 0, "balance").alias("column_name"))
    test_id = F.concat(F.lit("test.shop."), F.when(key % 4 > 0, "unique_s").otherwise("assert_s"), key.cast("string"))
    entries = F.flatten(F.collect_list(F.array(F.struct(_ids("model.shop.s", "s_suppkey").alias("k"), model.alias("v")), F.struct(test_id.alias("k"), test.alias("v")))))
    built = F.struct(F.create_map(F.lit("balance"), F.struct(F.lit("DECIMAL").alias("type")), F.lit("extra"), F.struct(F.lit("INT").alias("type"))).alias("columns"),
                     F.struct(F.struct(F.lit(True).alias("include"), F.col("n").cast("string").alias("value")).alias("row_count")).alias("stats"))
    own = s.groupBy("s_nationkey").agg(F.map_from_entries(entries).alias("nodes"), F.array_sort(F.collect_list(_ids("model.shop.s", "s_suppkey"))).alias("all"),
                                       F.map_from_entries(F.collect_list(F.struct(_ids("model.shop.s", "s_suppkey"), built))).alias("built"))
    own = own.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    given = F.create_map(_ids("source.shop.n", "n_nationkey"), F.struct(F.col("n_name").alias("name"), F.lit("raw").alias("schema")))
    shown = F.create_map(_ids("exposure.shop.n", "n_nationkey"), F.struct(
        F.concat(F.lit("board of "), "n_name").alias("name"), F.lit("dashboard").alias("type"), F.struct(F.when(F.col("n_regionkey") > 1, "high").otherwise("low").alias("priority")).alias("meta"), F.struct(F.col("all").alias("nodes")).alias("depends_on")))
    manifest = own.select(F.to_json(F.struct("nodes", given.alias("sources"), shown.alias("exposures"))).alias("value"))
    return manifest, own.select(F.to_json(F.struct(F.col("built").alias("nodes"))).alias("value"))


def _shop(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return artifacts.graph_tables(*documents(spark, sf_dir))


def artifact_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shop(spark, sf_dir)["graph_nodes"].select("unique_id", "name", "label", "layer", "materialized", "owner", "row_count", "priority", "exposure_type", "description", F.array_join("tags", ",").alias("tags"))


def artifact_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shop(spark, sf_dir)["graph_edges"]


def artifact_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of all nodes, numbered in the order in which the manifest, then the catalog, lists them."""
    nth = F.row_number().over(Window.partitionBy("node_id").orderBy("place"))
    return _shop(spark, sf_dir)["graph_columns"].select("column_id", "data_type", "description", nth.alias("nth"))


def artifact_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shop(spark, sf_dir)["graph_tests"]


_SUPPLIERS = "s as (select *, 'model.shop.s' || s_suppkey as id from supplier), used as (select distinct n.* from nation n join supplier on s_nationkey = n_nationkey)"
ARTIFACT_SQL = {
    "artifact_nodes": f"""with {_SUPPLIERS} select id as unique_id, case s_suppkey % 3 when 0 then 'stg_s' when 1 then 'fct_s' else 'raw_s' end || s_suppkey as name, 'Model' as label,
            case when s_suppkey % 5 = 0 then 'intermediate' when s_suppkey % 3 = 0 then 'staging' when s_suppkey % 3 = 1 then 'marts' end as layer, case when s_acctbal > 0 then 'view' else 'table' end as materialized,
            case when s_suppkey % 7 > 0 then 'o' || s_nationkey end as owner, (select nullif(count(*), 0) from lineitem where l_suppkey = s_suppkey) as row_count, null as priority, null as exposure_type, s_name as description, 'daily' as tags from s
        union all select 'source.shop.n' || n_nationkey, n_name, 'Source', null, null, null, null, null, null, '', null from used
        union all select 'exposure.shop.n' || n_nationkey, 'board of ' || n_name, 'Exposure', null, null, null, null, case when n_regionkey > 1 then 'high' else 'low' end, 'dashboard', '', null from used""",
    "artifact_edges": f"""with {_SUPPLIERS} select 'source.shop.n' || s_nationkey as source_id, id as target_id, 'source' as edge_type from s
        union all select a.id, b.id, 'ref' from s a join s b on a.s_suppkey = b.s_suppkey - 1 union all select id, 'exposure.shop.n' || s_nationkey, 'consumes' from s""",
    "artifact_columns": f"""with {_SUPPLIERS} select id || '.' || c as column_id, t as data_type, d as description, n as nth from s,
        (values ('balance', 'DECIMAL', 'owed', 1), ('note', null, '', 2), ('extra', 'INT', '', 3)) v(c, t, d, n)""",
    "artifact_tests": f"""with {_SUPPLIERS} select 'test.shop.' || case when s_suppkey % 4 > 0 then 'unique_s' else 'assert_s' end || s_suppkey as test_id, id as target_id, case when s_suppkey % 4 > 0 then 'balance' end as column_name,
        case when s_suppkey % 4 > 0 then 'unique' else 'custom' end as test_type from s"""}


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and failures of run-results documents, one for each day of orders."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    model = key % 2 == 0
    entry = F.struct(F.concat(F.when(model, "model").otherwise("test"), F.lit(".shop.o"), key.cast("string")).alias("unique_id"),
                     F.when(status == "F", F.when(model, "success").otherwise("pass")).when(status == "O", "fail").otherwise("error").alias("status"), (key % 3).alias("failures"))
    texts = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.to_json(F.struct(F.collect_list(entry).alias("results"))).alias("value"))
    found = schema.run_summary(artifacts.run_results(texts.select("value")))
    return found.select("models_success", "tests_passed", "n_failed", F.md5(F.array_join("failed", ",")).alias("failed"))


RUN_SQL = """with r as (select case when o_orderkey % 2 = 0 then 'model' else 'test' end as kind, case when o_orderkey % 2 = 0 then 'model' else 'test' end || '.shop.o' || o_orderkey as id, o_orderstatus as st from orders)
select count(*) filter (where kind = 'model' and st = 'F') as models_success, count(*) filter (where kind = 'test' and st = 'F') as tests_passed, count(*) filter (where st <> 'F') as n_failed,
    md5(string_agg(id, ',' order by id) filter (where st <> 'F')) as failed from r"""


def freshness_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of source-freshness documents, one for each customer segment, a source a customer."""
    status = F.element_at(F.array(*map(F.lit, ("pass", "warn", "Error", "runtime error"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    entry = F.struct(_ids("source.shop.c", "c_custkey").alias("unique_id"), status.alias("status"), F.when(F.col("c_custkey") % 4 < 3, F.col("c_acctbal").cast("string")).alias("max_loaded_at"), F.struct(F.lit(6).alias("warn_after")).alias("criteria"))
    texts = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.to_json(F.struct(F.collect_list(entry).alias("results"))).alias("value"))
    rows = artifacts.freshness_events(texts.select("value"))
    return rows.select("event_type", "severity", "node_id", F.col("new_value").cast("double").alias("loaded"), F.col("metadata")["status"].alias("status"), F.col("metadata")["criteria"].alias("criteria"))


FRESHNESS_SQL = """select 'freshness_violation' as event_type, case c_custkey % 4 when 1 then 'warning' else 'error' end as severity, 'source.shop.c' || c_custkey as node_id, case when c_custkey % 4 < 3 then c_acctbal end as loaded,
    case c_custkey % 4 when 1 then 'warn' when 2 then 'error' else 'runtime error' end as status, '{"warn_after":6}' as criteria from customer where c_custkey % 4 > 0"""

#: The columns of five tables, in order.
COLUMNS = {"region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"), "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
           "events": ("event_id", "ts", "user_id", "event_type", "value", "props"), "conversations": ("conv_id", "turn", "role", "text")}


def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of five tables by name and place, and how many values each holds."""
    frames = {n: table(spark, sf_dir, n) for n in COLUMNS}
    filled = reduce(DataFrame.unionByName, [profile.profile(df, n) for n, df in frames.items()]).select("table_name", "column_name", (F.col("row_count") - F.col("null_count")).alias("n_filled"))
    return schema.snapshot(spark, frames).select("table_name", "column_name", "ordinal").join(filled, ["table_name", "column_name"])


CATALOG_SQL = " union all ".join(f"select '{t}' as table_name, '{c}' as column_name, {i} as ordinal, (select count({c}) from {t}) as n_filled" for t, own in COLUMNS.items() for i, c in enumerate(own, 1))


def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events between the schemas of the given tables and those of changed copies, with the rows that each change concerns."""
    old = {n: table(spark, sf_dir, n) for n in ("region", "orders", "part", "customer")}
    new = {"orders": old["orders"].drop("o_orderpriority").withColumn("o_note", F.lit("x")), "part": old["part"].withColumn("p_size", F.col("p_size").cast("string")),
           "customer": old["customer"].withColumn("c_acctbal", F.coalesce("c_acctbal", F.lit(0.0))), "nation": table(spark, sf_dir, "nation").select("n_name")}
    counts = reduce(DataFrame.unionByName, [df.agg(F.lit(n).alias("node_id"), F.count("*").alias("n_rows")) for n, df in ({"nation": new["nation"]} | old).items()])
    found = schema.schema_changes(schema.snapshot(spark, old), schema.snapshot(spark, new))
    return found.select("event_type", "severity", "node_id", "column_name", "old_value", "new_value").join(counts, "node_id")


DIFF_SQL = """select 'column_removed' as event_type, 'critical' as severity, 'region' as node_id, c as column_name, t as old_value, null as new_value, (select count(*) from region) as n_rows from (values ('r_regionkey', 'int'), ('r_name', 'string')) v(c, t)
    union all select 'column_removed', 'critical', 'orders', 'o_orderpriority', 'string', null, (select count(*) from orders) union all select 'column_added', 'info', 'orders', 'o_note', null, 'string', (select count(*) from orders)
    union all select 'nullability_changed', 'warning', 'orders', 'o_note', null, null, 0 where false
    union all select 'type_changed', 'error', 'part', 'p_size', 'int', 'string', (select count(*) from part) union all select 'nullability_changed', 'warning', 'customer', 'c_acctbal', 'true', 'false', (select count(*) from customer)
    union all select 'column_added', 'info', 'nation', 'n_name', null, 'string', (select count(*) from nation)"""


def all_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the events of all detectors together."""
    parts = [f(spark, sf_dir).select("event_type", "severity") for f in (quality.profile_drift, schema_diff, quality.source_freshness, freshness_documents, quality.test_failures)]
    return events.union(*parts).groupBy("event_type", "severity").agg(F.count("*").alias("n"))


def _chain(source: str, steps: list[tuple[str, str]]) -> str:
    for name, expression in steps:
        source = f"select *, {expression} as {name} from ({source})"
    return source


def _murmur(source: str, key: str) -> str:
    """``source`` with ``pick``: the absolute 32-bit Murmur3 of a 64-bit key with seed 42, modulo 100."""
    steps = [("lo", f"({key} & 4294967295)::ubigint"), ("hi", f"(({key} >> 32) & 4294967295)::ubigint"), ("h0", "42::ubigint")]
    for i, word in enumerate(("lo", "hi")):
        steps += [(f"k{i}", f"{word} * 3432918353 % 4294967296"), (f"r{i}", f"((k{i} << 15) | (k{i} >> 17)) % 4294967296 * 461845907 % 4294967296"),
                  (f"x{i}", f"xor(h{i}, r{i})"), (f"h{i + 1}", f"(((x{i} << 13) | (x{i} >> 19)) % 4294967296 * 5 + 3864292196) % 4294967296")]
    steps += [("f0", "xor(h2, 8::ubigint)"), ("f1", "xor(f0, f0 >> 16) * 2246822507 % 4294967296"), ("f2", "xor(f1, f1 >> 13) * 3266489909 % 4294967296"), ("f3", "xor(f2, f2 >> 16)"),
              ("pick", "abs(case when f3 >= 2147483648 then f3::bigint - 4294967296 else f3::bigint end) % 100")]
    return _chain(source, steps)


_HASHED = _murmur("select * from orders", "o_orderkey")
INJECTED_SQL = f"""with h as ({_HASHED}) select 'drop_column' as injection, count(*) as n_rows, 0::bigint as n_null, 0::bigint as n_negative, 5 as n_columns from h
    union all select 'blank', count(*), count(*) filter (where pick < 30), 0, 6 from h union all select 'drop_rows', count(*) filter (where pick >= 40), 0, 0, 6 from h
    union all select 'negate', count(*), 0, count(*) filter (where pick < 5), 6 from h"""


def injected_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stored, damaged in place twice, and set back; what each version holds."""
    path = shared_path(spark, "raw-orders")
    records.write_raw(records.stringified(table(spark, sf_dir, "orders").withColumn("o_orderkey", F.col("o_orderkey") * 1)).withColumn("o_orderkey", F.col("o_orderkey").cast("long")), path)
    first = inject.in_place(spark, path, lambda df: inject.blank(df, "o_totalprice", 0.3))
    inject.in_place(spark, path, lambda df: inject.drop_rows(df, 0.1))
    inject.undo(spark, path, first)
    parts = [records.read_raw(spark, path, v).agg(F.lit(v).alias("version"), F.count("*").alias("n_rows"), F.count("o_totalprice").alias("n_priced")) for v in (1, 2, 3, 4)]
    return reduce(DataFrame.unionByName, parts)


VERSIONS_SQL = f"""with h as ({_HASHED}) select 1 as version, count(*) as n_rows, count(*) as n_priced from h union all select 2, count(*), count(*) filter (where pick >= 30) from h
    union all select 3, count(*) filter (where pick >= 10), count(*) filter (where pick >= 30) from h union all select 4, count(*), count(*) from h"""


def memory_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incident memory after two batches, the first of which came twice."""
    rows = q._incident_events(spark, sf_dir)
    held = IncidentMemory(spark, shared_path(spark, "memory"))
    early = F.col("detected_at") < F.lit("2024-01-15").cast("timestamp_ntz")
    for number, batch in ((1, rows.filter(early)), (1, rows.filter(early)), (2, rows.filter(~early))):
        held.record(number, batch)
    out = held.read()
    return out.select("incident", "n", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"), F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"), "last_risk", "node_id", "event_type")


MONTHLY = ("o_totalprice", "o_orderpriority", "o_custkey")


def monthly_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of orders from those of its months, the later ones added to what was stored of the earlier."""
    orders = table(spark, sf_dir, "orders")
    month = F.date_format("o_orderdate", "yyyy-MM")
    stored = profile.partials(orders.filter(month < "1996-01"), "orders", month, list(MONTHLY))
    path = shared_path(spark, "monthly")
    stored.write.parquet(path)
    df = profile.merged(profile.extended(spark.read.parquet(path), orders, "orders", month, list(MONTHLY)))
    return df.withColumns({c: F.round(c, 4) for c in ("null_ratio", "min_value", "max_value", "mean", "stddev")})


def hot_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one incident, scanned in ranges of time: which of them are duplicates."""
    rows = table(spark, sf_dir, "events").select("event_id", F.lit("one").alias("node_id"), F.lit("type_changed").alias("event_type"), F.lit(None).cast("string").alias("column_name"), F.col("ts").alias("detected_at"))
    return suppress(rows, minutes=3).select("event_id", "duplicate")


HOT_SQL = "select event_id, coalesce(ts - lag(ts) over (order by ts, event_id) < interval 3 minute, false) as duplicate from events"


def queries() -> dict:
    return {f.__name__: f for f in (
        artifact_nodes, artifact_edges, artifact_columns, artifact_tests, run_summary, freshness_documents, catalog_columns, schema_diff, all_detectors, injected_versions, memory_in_batches, monthly_profile, hot_suppression)}


def oracle_sql() -> dict[str, str]:
    together = " union all ".join(f"select event_type, severity from ({sql})" for sql in (quality.DRIFT_SQL, DIFF_SQL, quality.FRESH_SQL, FRESHNESS_SQL, quality.failures_sql()))
    return ARTIFACT_SQL | {
        "all_detectors": f"select event_type, severity, count(*) as n from ({together}) group by 1, 2",
        "run_summary": RUN_SQL, "freshness_documents": FRESHNESS_SQL, "catalog_columns": CATALOG_SQL, "schema_diff": DIFF_SQL, "injected": INJECTED_SQL, "injected_versions": VERSIONS_SQL, "memory_in_batches": q.MEMORY_SQL,
        "monthly_profile": quality._round_profile(quality._profile_sql("select * from orders", "orders", MONTHLY)), "hot_suppression": HOT_SQL}
