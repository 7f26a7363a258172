"""Queries and oracle SQL of artifacts, stores, data tests of the warehouse, and the handling of incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.functions.columns import short_number, source_name
from loomwork.operators import checks, graph, impact, incidents, schema
from loomwork.session import shared_path, table
from loomwork.sources import artifacts, stores
from loomwork.sources.star import raw_tables

from . import graph_queries as q
from .cycle import from_records, to_records
from .market import project
from .market_queries import oracle

#: A small manifest and catalog with every case that the graph distinguishes.
MANIFEST = """{"metadata": {"tool": "x"}, "nodes": {
 "model.shop.stg_orders": {"resource_type": "model", "name": "stg_orders", "schema": "s", "database": "d", "fqn": ["shop", "staging", "stg_orders"], "tags": ["daily"], "description": "Typed orders",
   "compiled_code": "select 1", "config": {"materialized": "view", "meta": {"owner": "ana"}}, "depends_on": {"nodes": ["source.shop.raw.orders", "seed.shop.codes"]},
   "columns": {"order_id": {"description": "key", "data_type": "string"}, "note": {"description": ""}}},
 "model.shop.fct_sales": {"resource_type": "model", "name": "fct_sales", "fqn": ["shop", "fct_sales"], "config": {"materialized": "table"}, "depends_on": {"nodes": ["model.shop.stg_orders", "model.shop.gone"]}, "columns": {"amount": {"data_type": "decimal"}}},
 "seed.shop.codes": {"resource_type": "seed", "name": "codes", "fqn": ["shop", "codes"], "config": {"materialized": "seed", "meta": null}, "depends_on": {"nodes": []}, "columns": {}},
 "snapshot.shop.old_orders": {"resource_type": "snapshot", "name": "old_orders", "fqn": ["shop", "marts", "staging"], "config": {}, "depends_on": {"nodes": ["model.shop.stg_orders"]}},
 "test.shop.unique_stg_orders_order_id.1": {"resource_type": "test", "name": "u", "attached_node": "model.shop.stg_orders", "column_name": "order_id", "depends_on": {"nodes": ["model.shop.fct_sales"]}},
 "test.shop.not_null_fct_sales_amount.2": {"resource_type": "test", "name": "n", "attached_node": null, "test_metadata": {"kwargs": {"column_name": "amount"}}, "depends_on": {"nodes": ["model.shop.fct_sales"]}},
 "test.shop.assert_sales.3": {"resource_type": "test", "name": "a", "depends_on": {"nodes": ["model.shop.fct_sales"]}},
 "test.shop.adrift.4": {"resource_type": "test", "name": "b", "depends_on": {"nodes": []}},
 "analysis.shop.x": {"resource_type": "analysis", "name": "x"}},
"sources": {"source.shop.raw.orders": {"name": "orders", "schema": "raw", "database": "d", "tags": [], "description": null, "meta": {"owner": "bo"}, "columns": {"id": {"data_type": "int"}}}},
"exposures": {"exposure.shop.board": {"name": "board", "type": "dashboard", "maturity": "high", "owner": {"name": "cy", "email": "c@x"}, "meta": {"priority": "high"}, "depends_on": {"nodes": ["model.shop.fct_sales"]}},
 "exposure.shop.bot": {"name": "bot", "type": "application", "owner": "dee", "depends_on": {"nodes": ["model.shop.fct_sales", "seed.shop.codes"]}}}}"""
CATALOG = """{"nodes": {
 "model.shop.stg_orders": {"columns": {"extra": {"type": "DATE", "index": 3}, "order_id": {"type": "BIGINT", "index": 1}}, "stats": {"row_count": {"include": true, "value": 12.0}}},
 "model.shop.fct_sales": {"columns": {"amount": {"type": ""}}, "stats": {"num_rows": {"include": true, "value": "7"}}},
 "seed.shop.codes": {"columns": {"code": {"type": "STRING"}}, "stats": {"row_count": {"include": false, "value": 5}}},
 "model.shop.unknown": {"columns": {"z": {"type": "INT"}}}},
"sources": {"source.shop.raw.orders": {"columns": {"id": {"type": "LONG"}, "at": {"type": "TIMESTAMP"}}, "stats": {"row_count": {"include": true, "value": "many"}}}}}"""
RESULTS = """{"results": [{"unique_id": "model.shop.stg_orders", "status": "success"}, {"unique_id": "model.shop.fct_sales", "status": "error"},
 {"unique_id": "test.shop.a.1", "status": "pass", "failures": 0}, {"unique_id": "test.shop.b.2", "status": "fail", "failures": 3}, {"unique_id": "test.shop.c.3", "status": "pass"}]}"""


def _text(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(text,)], "value string")


def shop(spark: SparkSession) -> dict[str, DataFrame]:
    return artifacts.graph_tables(_text(spark, MANIFEST), _text(spark, CATALOG))


def artifact_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shop(spark)["graph_nodes"].select("unique_id", "name", "label", "layer", "materialized", "owner", "row_count", "priority", "maturity", "exposure_type", "description", F.array_join("tags", ",").alias("tags"))


NODES_SQL = """select * from (values
    ('model.shop.stg_orders', 'stg_orders', 'Model', 'staging', 'view', 'ana', 12::bigint, null, null, null, 'Typed orders', 'daily'),
    ('model.shop.fct_sales', 'fct_sales', 'Model', 'marts', 'table', null, 7, null, null, null, '', null),
    ('seed.shop.codes', 'codes', 'Model', null, 'seed', null, null, null, null, null, '', null),
    ('snapshot.shop.old_orders', 'old_orders', 'Model', 'marts', null, null, null, null, null, null, '', null),
    ('source.shop.raw.orders', 'orders', 'Source', null, null, 'bo', null, null, null, null, '', ''),
    ('exposure.shop.board', 'board', 'Exposure', null, null, 'cy', null, 'high', 'high', 'dashboard', '', null),
    ('exposure.shop.bot', 'bot', 'Exposure', null, null, 'dee', null, null, null, 'application', '', null))
    t(unique_id, name, label, layer, materialized, owner, row_count, priority, maturity, exposure_type, description, tags)"""


def artifact_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shop(spark)["graph_edges"]


EDGES_SQL = """select * from (values ('source.shop.raw.orders', 'model.shop.stg_orders', 'source'), ('seed.shop.codes', 'model.shop.stg_orders', 'ref'), ('model.shop.stg_orders', 'model.shop.fct_sales', 'ref'),
    ('model.shop.stg_orders', 'snapshot.shop.old_orders', 'ref'), ('model.shop.fct_sales', 'exposure.shop.board', 'consumes'), ('model.shop.fct_sales', 'exposure.shop.bot', 'consumes'),
    ('seed.shop.codes', 'exposure.shop.bot', 'consumes')) t(source_id, target_id, edge_type)"""


def artifact_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of all nodes, numbered in the order in which the manifest, then the catalog, lists them."""
    rows = shop(spark)["graph_columns"]
    nth = F.row_number().over(Window.partitionBy("node_id").orderBy("place"))
    return rows.select("column_id", "data_type", "description", nth.alias("nth"))


COLUMNS_SQL = """select * from (values ('model.shop.stg_orders.order_id', 'BIGINT', 'key', 1), ('model.shop.stg_orders.note', null, '', 2), ('model.shop.stg_orders.extra', 'DATE', '', 3),
    ('model.shop.fct_sales.amount', 'decimal', '', 1), ('seed.shop.codes.code', 'STRING', '', 1), ('source.shop.raw.orders.id', 'LONG', '', 1), ('source.shop.raw.orders.at', 'TIMESTAMP', '', 2))
    t(column_id, data_type, description, nth)"""


def artifact_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shop(spark)["graph_tests"]


TESTS_SQL = """select * from (values ('test.shop.unique_stg_orders_order_id.1', 'model.shop.stg_orders', 'order_id', 'unique'), ('test.shop.not_null_fct_sales_amount.2', 'model.shop.fct_sales', 'amount', 'not_null'),
    ('test.shop.assert_sales.3', 'model.shop.fct_sales', null, 'custom')) t(test_id, target_id, column_name, test_type)"""


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and failures of a run-results artifact."""
    found = schema.run_summary(artifacts.run_results(_text(spark, RESULTS)))
    return found.withColumn("failed", F.array_join("failed", ","))


RUN_SQL = "select 1::bigint as models_success, 2::bigint as tests_passed, 2::bigint as n_failed, 'model.shop.fct_sales,test.shop.b.2' as failed"


def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each stored table of a graph whose rows were given twice; a column edge without its column is left out."""
    tables = shop(spark)
    twice = {n: df.union(df) for n, df in tables.items()}
    lineage = spark.createDataFrame([("source.shop.raw.orders", "id", "model.shop.stg_orders", "order_id", 1.0), ("source.shop.raw.orders", "no", "model.shop.stg_orders", "order_id", 1.0)],
                                    "up_node string, up_column string, down_node string, down_column string, confidence double")
    counts = graph.write_graph(twice, lineage, shared_path(spark, "graph"))
    return spark.createDataFrame(sorted(counts.items()), "name string, n long")


COUNTS_SQL = "select * from (values ('graph_nodes', 7::bigint), ('graph_edges', 7), ('graph_tests', 3), ('graph_columns', 7), ('graph_lineage', 1)) t(name, n)"


def stored_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three captures of parts: the newest, the one before, and the newest row of each part."""
    p, path = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand"), shared_path(spark, "captures")
    for at, rows in (("2024-01-01", p), ("2024-01-03", p.filter("p_size > 25")), ("2024-01-02", p.filter("p_size % 2 = 0"))):
        stores.save_snapshot(rows, path, at)
    everything = stores.newest_rows(spark.read.parquet(path), "p_partkey").groupBy(F.col("captured_at").cast("string").alias("what")).agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))
    out = everything
    for what, rows in (("newest", stores.latest_snapshot(spark, path)), ("before", stores.latest_snapshot(spark, path, 1)), ("none", stores.latest_snapshot(spark, path, 3))):
        out = out.unionByName(rows.agg(F.lit(what).alias("what"), F.count("*").alias("n"), F.sum("p_size").alias("size")))
    return out


CAPTURES_SQL = """select '2024-01-03' as what, count(*) as n, sum(p_size)::bigint as size from part where p_size > 25
    union all select '2024-01-02', count(*), sum(p_size)::bigint from part where p_size <= 25 and p_size % 2 = 0
    union all select '2024-01-01', count(*), sum(p_size)::bigint from part where p_size <= 25 and p_size % 2 = 1
    union all select 'newest', count(*), sum(p_size)::bigint from part where p_size > 25 union all select 'before', count(*), sum(p_size)::bigint from part where p_size % 2 = 0
    union all select 'none', 0, null"""


def market_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 53 data tests of the warehouse with the number of violations."""
    return checks.run_tests(project, project.build(spark, raw_tables(spark, sf_dir), share=True))


def _market_tests_sql() -> str:
    parts = []
    for t in project.tests:
        if t.kind == "unique":
            bad = f"select {t.column} from {t.model} where {t.column} is not null group by 1 having count(*) > 1"
        elif t.kind == "relationships":
            bad = f"select 1 from {t.model} c where {t.column} is not null and not exists (select 1 from {t.parent} p where p.{t.parent_column} = c.{t.column})"
        else:
            bad = f"select 1 from {t.model} where {t.failing or t.column + ' is null'}"
        parts.append(f"select 'test.market.{t.name}' as test_id, case when count(*) > 0 then 'fail' else 'pass' end as status, count(*) as failures from ({bad})")
    return oracle(" union all ".join(parts), *project.models)


def correlated_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's primary event with the others attached to it."""
    rows = incidents.attached(q._incident_events(spark, sf_dir))
    others = F.transform("correlated", lambda c: F.concat(c["event_id"].cast("string"), F.lit(":"), c["event_type"], F.lit(":"), c["severity"]))
    return rows.select("node_id", "session", "event_id", "severity", F.array_join(others, ",").alias("others"))


CORRELATED_SQL = f"""
with {q._INCIDENTS}, f as (select *, case when detected_at - lag(detected_at) over w <= interval 15 minute then 0 else 1 end as st from e window w as (partition by node_id order by detected_at, event_id)),
n as (select *, sum(st) over (partition by node_id order by detected_at, event_id rows unbounded preceding)::bigint as session from f),
r as (select *, row_number() over (partition by node_id, session order by sev desc, detected_at desc, event_id desc) as nth from n)
select node_id, session, max(event_id) filter (where nth = 1) as event_id, max(severity) filter (where nth = 1) as severity,
    coalesce(string_agg(event_id || ':' || event_type || ':' || severity, ',' order by detected_at, event_id) filter (where nth > 1), '') as others from r group by 1, 2"""


def calibration_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = incidents.memory(q._incident_events(spark, sf_dir))
    return incidents.calibration_total(stored, q._outcomes(stored)).withColumn("actionable_rate", F.round("actionable_rate", 6))


TOTAL_SQL = f"""
with {q._INCIDENTS}, m as (select incident, count(*) as n from k group by 1), o as (select case when substr(incident, 1, 1) between '0' and '7' then 1 else 0 end as good from m where substr(incident, 2, 1) < 'a')
select count(*) as n_incidents, sum(n)::bigint as n_events, (select round(avg(good), 6) from o) as actionable_rate, coalesce((select avg(good) from o) < 0.5, false) as warn from m"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents with all outcomes recorded for them; one outcome is of no known incident."""
    stored = incidents.memory(q._incident_events(spark, sf_dir))
    first = q._outcomes(stored)
    again = first.filter("outcome = 'noise'").withColumns({"outcome": F.lit("actionable"), "at": F.col("at") + F.expr("interval 1 day")})
    unknown = first.limit(1).withColumn("incident", F.lit("no such incident"))
    rows = incidents.with_feedback(stored, first.unionByName(again).unionByName(unknown))
    return rows.select("incident", F.array_join("outcomes", ",").alias("outcomes"))


FEEDBACK_SQL = f"""
with {q._INCIDENTS} select incident, case when substr(incident, 2, 1) < 'a' then case when substr(incident, 1, 1) between '0' and '7' then 'actionable' else 'noise,actionable' end end as outcomes
from k group by incident"""


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as JSON texts and read back."""
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", F.when(F.col("event_id") % 3 > 0, F.col("props")).alias("props"), F.array("event_type", F.lit("\"é\n")).alias("tags"))
    return from_records(to_records(rows), rows.schema).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "event_type", "props", F.array_join("tags", "|").alias("tags"))


RECORDS_SQL = """select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as at, event_type, case when event_id % 3 > 0 then props end as props, event_type || '|"é' || chr(10) as tags from events"""


def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of many magnitudes as short texts, and the group of each table name."""
    p = table(spark, sf_dir, "part")
    value = F.when(F.col("p_partkey") % 50 > 0, F.col("p_retailprice").cast("double") * F.pow(F.lit(10.0), F.col("p_partkey") % 17 - 9))
    raw = F.concat(F.element_at(F.array(*map(F.lit, ("coingecko", "defi_llama", "etherscan", "raw"))), (F.col("p_size") % 4 + 1).cast("int")), F.when(F.col("p_size") % 3 > 0, "_x_y").otherwise("x_y"))
    return p.select("p_partkey", short_number(value).alias("short"), source_name(raw, ("coingecko", "defi_llama", "etherscan")).alias("source"))


NUMBERS_SQL = f"""select p_partkey, case when p_partkey % 50 > 0 then format('{{:,.4g}}', p_retailprice::double * pow(10.0, p_partkey % 17 - 9)) else 'None' end as short,
    case when raw like 'coingecko\\_%' escape '\\' then 'coingecko' when raw like 'defi\\_llama\\_%' escape '\\' then 'defi_llama' when raw like 'etherscan\\_%' escape '\\' then 'etherscan' else split_part(raw, '_', 1) end as source
    from (select *, {q._pick(('coingecko', 'defi_llama', 'etherscan', 'raw'), 'p_size % 4')} || case when p_size % 3 > 0 then '_x_y' else 'x_y' end as raw from part)"""


def drafted_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports after drafts came in: one that parses, one that does not, one for an event that no pull request answers."""
    drafts = spark.createDataFrame([(1, "select id as coin_id from coingecko_coins_markets"), (2, "select 1"), (5, "selekt from")], "event_id int, fix_sql string")
    rows = impact.with_fixes(spark, q.reports(spark, sf_dir), drafts)
    return rows.select("event_id", "model_id", "fix_eligible", "fix_sql", F.array_join(F.transform("actions", lambda a: a["type"]), ",").alias("actions"))


FIXES_SQL = f"""select event_id, model_id, actions like '%github_pr%' as fix_eligible, case event_id when 1 then 'select id as coin_id from coingecko_coins_markets' end as fix_sql, actions from ({q.REPORT_SQL})"""


#: A small project by hand, held by tests; the registered queries of these names read documents derived from the given tables.
SHOP = ((artifact_nodes, NODES_SQL), (artifact_edges, EDGES_SQL), (artifact_columns, COLUMNS_SQL), (artifact_tests, TESTS_SQL), (run_summary, RUN_SQL), (graph_counts, COUNTS_SQL), (drafted_fixes, FIXES_SQL))


def queries() -> dict:
    return {f.__name__: f for f in (
        stored_captures, market_tests, correlated_batch, calibration_total,
        feedback, event_records, number_texts)}


def oracle_sql() -> dict[str, str]:
    return {
        "stored_captures": CAPTURES_SQL, "market_tests": _market_tests_sql(), "correlated_batch": CORRELATED_SQL, "calibration_total": TOTAL_SQL,
        "feedback": FEEDBACK_SQL, "event_records": RECORDS_SQL, "number_texts": NUMBERS_SQL,
    }
