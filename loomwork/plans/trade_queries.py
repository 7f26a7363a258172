"""Queries and oracle SQL of graph, lineage, impact and report operators on the graph of the star schema.

The oracles walk the given tables level by level (supplier or part, order,
customer, nation, region) by joins; only the operators walk a graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.columns import col
from loomwork.operators import graph as g
from loomwork.operators import impact, lineage, profile, risk
from loomwork.session import shared_path, table
from loomwork.sources import trade
from loomwork.sources.star import raw_tables

from . import graph_queries as q
from .market import project
from .market_queries import oracle


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade.nodes(spark, sf_dir).select("unique_id", "name", "label", "layer", "materialized", "priority")


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade.edges(spark, sf_dir)


def _ids(graph: dict[str, DataFrame], condition: str) -> DataFrame:
    return graph["graph_nodes"].filter(condition).select(F.col("unique_id").alias("id"))


def downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All models below each supplier and part, with the fewest hops."""
    graph = trade.graph(spark, sf_dir)
    return g.dependent_models(graph, _ids(graph, "label = 'Source'"))


def upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that each nation depends on."""
    graph = trade.graph(spark, sf_dir)
    return g.dependent_models(graph, _ids(graph, "layer = 'marts'"), upstream=True)


def exposure_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trail from a supplier to a region."""
    graph = trade.graph(spark, sf_dir)
    suppliers = table(spark, sf_dir, "supplier").select(trade.named(trade.SUPPLIER, "s_suppkey").alias("id"))
    return g.paths_to_exposures(graph, suppliers).select("origin", "exposure", "priority", "depth", F.array_join("path", ">").alias("path"))


def exposure_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.exposure_distances(trade.graph(spark, sf_dir))


def fan_outs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.fan_out(trade.graph(spark, sf_dir))


def column_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of every node."""
    return g.test_coverage(trade.graph(spark, sf_dir)).select("node", "n_columns", "n_tested", F.round("coverage", 6).alias("coverage"), F.coalesce(F.size("tests"), F.lit(0)).alias("n_tests"))


def node_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The properties of one exposure."""
    return g.node_metadata(trade.graph(spark, sf_dir), "exposure.trade.r1").select("unique_id", F.explode("properties").alias("property", "value"))


def test_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.tested_model(trade.graph(spark, sf_dir), "test.trade.assert_n3")


def column_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best confidence and fewest hops from the columns of all suppliers and parts to every column that they flow into."""
    owned = trade.columns(spark, sf_dir).filter("node_id like 'source.%'")
    return g.column_flow(trade.lineage(spark, sf_dir), owned.select(F.col("column_id").alias("id"))).withColumn("confidence", F.round("confidence", 6))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade.events(spark, sf_dir, tuple(risk.ANOMALY), tuple(risk.SEVERITY))


def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an anomaly at each supplier touches."""
    rows = impact.affected(spark, trade.graph(spark, sf_dir), trade.lineage(spark, sf_dir), _events(spark, sf_dir))
    return rows.withColumn("confidence", F.round("confidence", 6))


def blast_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = impact.scored(spark, trade.graph(spark, sf_dir), trade.lineage(spark, sf_dir), _events(spark, sf_dir))
    return rows.select("event_id", "origin", "node", F.round("coverage", 6).alias("coverage"), "fan_out", "distance", "hops", F.round("base_score", 10).alias("base_score"), F.round("score", 10).alias("score"))


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.report(spark, trade.graph(spark, sf_dir), trade.lineage(spark, sf_dir), _events(spark, sf_dir))


def _names(actions: str) -> F.Column:
    return F.array_join(F.transform(actions, lambda a: a["type"]), ",")


def impact_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reports(spark, sf_dir).select(
        "event_id", "origin", "risk_level", F.round("max_score", 6).alias("max_score"), "n_affected", "n_gaps", "n_pruned", F.array_join("exposures", ",").alias("exposures"), _names("actions").alias("actions"), "model_id")


def drafted_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports after drafts came in for three of four events, one in three of which does not parse."""
    key = F.col("s_suppkey")
    draft = F.when(key % 4 == 1, "selekt from").when(key % 4 > 1, F.concat(F.lit("select "), key.cast("string"), F.lit(" as fixed")))
    drafts = table(spark, sf_dir, "supplier").select(key.alias("event_id"), draft.alias("fix_sql")).filter("fix_sql is not null")
    rows = impact.with_fixes(spark, _reports(spark, sf_dir), drafts)
    return rows.select("event_id", "model_id", "fix_eligible", "fix_sql", _names("actions").alias("actions"))


def unknown_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.unknown(trade.graph(spark, sf_dir), _events(spark, sf_dir))


def node_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every node when supplier 1 breaks."""
    graph = trade.graph(spark, sf_dir)
    root = _ids(graph, f"unique_id = '{trade.SUPPLIER}1'")
    below = g.dependent_models(graph, root).select("node", F.lit(False).alias("is_root"))
    return impact.lanes(graph, below.unionByName(root.select(F.col("id").alias("node"), F.lit(True).alias("is_root"))))


def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each stored table of the graph, whose rows were given twice."""
    graph = {n: df.unionByName(df) for n, df in trade.graph(spark, sf_dir).items()}
    counts = g.write_graph(graph, trade.lineage(spark, sf_dir), shared_path(spark, "graph"))
    return spark.createDataFrame(sorted(counts.items()), "name string, n long")


def _filled(frames: dict[str, DataFrame], wanted: dict[str, list[str]] | None = None) -> DataFrame:
    """Filled values of every column of the built frames, or of those ``wanted`` of each: node, column_name, n_filled. Nothing but the values is counted."""
    def counted(name: str, columns: list[str]) -> DataFrame:
        counts = frames[name].agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(columns)])
        rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n_filled")) for i, c in enumerate(columns)]))
        return counts.select(F.lit(project.node_id(name)).alias("node"), rows.alias("r")).select("node", "r.column_name", "r.n_filled")

    kept = {n: [c for c in (df.columns if wanted is None else wanted.get(n, ())) if c not in profile.IGNORED] for n, df in frames.items()}
    return g.reduce(DataFrame.unionByName, [counted(n, columns) for n, columns in kept.items() if columns])


def _built(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The frames whose plans hold the lineage, and the same with shared models computed once, to count in."""
    raw = raw_tables(spark, sf_dir)
    plans = project.build(spark, raw)
    edges_only = {n: plans[n] for n in (*project.sources, *project.models)}
    return edges_only, {n: df for n, df in project.build(spark, raw, share=True).items() if n in edges_only}


def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column edges that the analyzed plans of the 17 models give, with how many values each end holds. Staging and intermediate models that others read are computed once."""
    raw = raw_tables(spark, sf_dir)
    edges = lineage.column_lineage(spark, project, project.build(spark, raw))
    filled = _filled(project.build(spark, raw, share=True, reads=list(project.models), layers=("staging", "intermediate")))
    for side in ("up", "down"):
        own = filled.select(F.col("node").alias(f"{side}_node"), F.col("column_name").alias(f"{side}_column"), F.col("n_filled").alias(f"{side}_filled"))
        edges = edges.join(own, [f"{side}_node", f"{side}_column"], "left")
    return edges


def lineage_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many columns of each model have a source, and how many rows the model has."""
    plans, frames = _built(spark, sf_dir)
    found = spark.createDataFrame(lineage.resolution(project, plans), "model string, n_columns int, n_resolved int")
    counts = g.reduce(DataFrame.unionByName, [frames[m].agg(F.lit(m).alias("model"), F.count("*").alias("n_rows")) for m in project.models])
    return found.join(counts, "model")


def _price(spark: SparkSession, sf_dir: str, start: str, backward: bool) -> DataFrame:
    """The trails from one column, with the filled values of each column on them; only models on the trails are counted, each over all its rows."""
    raw = raw_tables(spark, sf_dir)
    plans = project.build(spark, raw)
    trails = g.column_trails(lineage.column_lineage(spark, project, plans), spark.createDataFrame([(start,)], "id string"), backward)
    met = {r.node for r in trails.select("node").distinct().collect()}  # as many as the warehouse has columns, at most
    wanted = {n: found for n, df in plans.items() if (found := [c for c in df.columns if f"{project.node_id(n)}.{c}" in met])}
    frames = project.build(spark, raw, only=set(wanted), share=True, reads=list(wanted))
    filled = _filled(frames, wanted).select(F.concat_ws(".", "node", "column_name").alias("node"), "n_filled")
    return trails.join(filled, "node").select("node", "depth", "confidence", F.array_join("path", ">").alias("path"), "n_filled")


def price_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where one raw price column flows, and how many values arrive."""
    return _price(spark, sf_dir, f"{q.START}.current_price", False)


def price_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a mart's price comes from."""
    return _price(spark, sf_dir, f"{project.node_id('fct_protocol_health')}.governance_token_price_usd", True)


def queries() -> dict:
    return {f.__name__: f for f in (
        graph_nodes, graph_edges, downstream, upstream, exposure_paths, exposure_distance, fan_outs, column_tests, node_properties, test_owner, column_flow, blast_radius, blast_scores, impact_reports,
        drafted_fixes, unknown_nodes, node_lanes, graph_counts, lineage_edges, lineage_resolution, price_lineage, price_origin)}


NODES_SQL = """select 'source.trade.s' || s_suppkey as unique_id, s_name as name, 'Source' as label, null as layer, null as materialized, null as priority from supplier
    union all select 'source.trade.p' || p_partkey, p_name, 'Source', null, null, null from part
    union all select 'model.trade.o' || o_orderkey, 'order ' || o_orderkey, 'Model', 'staging', case o_orderstatus when 'F' then 'view' when 'O' then 'table' else 'incremental' end, null from orders
    union all select 'model.trade.c' || c_custkey, c_name, 'Model', 'intermediate', case when c_acctbal > 0 then 'table' else 'view' end, null from customer
    union all select 'model.trade.n' || n_nationkey, n_name, 'Model', 'marts', 'table', null from nation
    union all select 'exposure.trade.r' || r_regionkey, r_name, 'Exposure', null, null, case when r_regionkey % 2 = 0 then 'high' else 'medium' end from region"""
#: Every step of a walk: up, down, their levels (0 to 4), and each node's own facts.
WALK_SQL = """so as (select distinct 'source.trade.s' || l_suppkey as s, 'model.trade.o' || l_orderkey as o from lineitem union select 'source.trade.p' || l_partkey, 'model.trade.o' || l_orderkey from lineitem),
oc as (select 'model.trade.o' || o_orderkey as o, 'model.trade.c' || o_custkey as c from orders), cn as (select 'model.trade.c' || c_custkey as c, 'model.trade.n' || c_nationkey as n from customer),
nr as (select 'model.trade.n' || n_nationkey as n, 'exposure.trade.r' || n_regionkey as r from nation),
sc as (select distinct s, c from so join oc using (o)), sn as (select distinct s, n from sc join cn using (c))"""
EDGES_SQL = f"""with {WALK_SQL} select s as source_id, o as target_id, 'source' as edge_type from so union all select o, c, 'ref' from oc union all select c, n, 'ref' from cn union all select n, r, 'consumes' from nr"""
EVENTS_SQL = f"""ev as (select s_suppkey as event_id, case when s_suppkey % 10 = 9 then 'source.trade.gone' || s_suppkey when s_suppkey % 10 = 8 then 'test.trade.assert_n' || (s_suppkey % 25) else 'source.trade.s' || s_suppkey end as node_id,
    case when s_suppkey % 10 < 8 then case s_suppkey % 3 when 0 then 'balance' when 1 then 'no_such' end end as column_name,
    {q._pick(tuple(risk.ANOMALY), f's_suppkey % {len(risk.ANOMALY)}')} as event_type, {q._pick(tuple(risk.SEVERITY), f's_suppkey % {len(risk.SEVERITY)}')} as severity from supplier)"""
#: What each event touches, level by level: the flow of its column where it has one, else all below.
BLAST_SQL = f"""{WALK_SQL}, {EVENTS_SQL},
fine as (select event_id, column_name, event_type, severity, case when node_id like 'test.%' then 'model.trade.n' || (event_id % 25) else node_id end as origin from ev where node_id not like '%gone%'),
fo as (select event_id, l_orderkey, max(1 - l_discount) as conf from fine join lineitem on origin = 'source.trade.s' || l_suppkey where column_name = 'balance' and l_returnflag <> 'A' group by 1, 2),
fc as (select event_id, o_custkey, max(least(conf, 1 - substr(o_orderpriority, 1, 1)::int / 20::double)) as conf from fo join orders on o_orderkey = l_orderkey where o_orderstatus <> 'P' group by 1, 2),
fn as (select event_id, c_nationkey, max(least(conf, case when c_acctbal > 0 then 0.9::double else 0.6::double end)) as conf from fc join customer on c_custkey = o_custkey where c_acctbal > -500 group by 1, 2),
flow as (select event_id, 'model.trade.o' || l_orderkey as node, conf, 1 as hops from fo union all select event_id, 'model.trade.c' || o_custkey, conf, 2 from fc
    union all select event_id, 'model.trade.n' || c_nationkey, conf, 3 from fn
    union all select event_id, 'source.trade.s' || event_id, max(conf), 0 from fo group by event_id),
below as (select event_id, column_name, o as node from fine join so on s = origin union all select event_id, column_name, c from fine join sc on s = origin union all select event_id, column_name, n from fine join sn on s = origin),
rest as (select *, event_id in (select event_id from flow) as followed from below where (event_id, node) not in (select event_id, node from flow)),
touched as (select event_id, node, hops, conf as confidence, false as pruned from flow
    union all select event_id, node, case when column_name is null then 1 end, 1.0::double, false from rest where not followed
    union all select event_id, origin, 0, 1.0::double, false from fine where event_id not in (select event_id from flow)
    union all select event_id, node, null, null, true from rest where followed or column_name is not null),
tested as (select 'model.trade.o' || o_orderkey as node, 1 / 3::double as coverage from orders where o_orderpriority = '1-URGENT' union all select 'model.trade.c' || c_custkey, 0.5::double from customer where c_mktsegment = 'BUILDING'),
fans as (select s as node, count(*) as fan_out from so group by 1 union all select o, 1 from oc union all select c, 1 from cn),
built as (select unique_id as node, materialized from ({NODES_SQL})),
sr as (select distinct s, r from sn join nr using (n) union select n, r from nr),
facts as (select t.*, f.origin, f.event_type, f.severity, coalesce(d.coverage, 0) as coverage, coalesce(a.fan_out, 0) as fan_out, b.materialized,
        case when t.node like 'source.%' then case when a.fan_out > 0 then 4 end when t.node like 'model.trade.o%' then 3 when t.node like 'model.trade.c%' then 2 else 1 end as distance,
        f.origin in (select s from sr where r in (select 'exposure.trade.r' || r_regionkey from region where r_regionkey % 2 = 0)) as urgent
    from touched t join fine f using (event_id) left join tested d using (node) left join fans a using (node) left join built b using (node) where not pruned),
based as (select *, least(((1.0 - coverage)::double * 0.30::double + least(fan_out / 10.0::double, 1.0::double) * 0.25::double + coalesce(1.0::double / (distance + 1), 0) * 0.25::double
        + {q._case('materialized', risk.MATERIALIZED, 0.5)}::double * 0.20::double) * {q._case('event_type', risk.ANOMALY, 1.0)}::double, 1.0::double) as base from facts),
final as (select *, least(base * {q._case('severity', risk.SEVERITY, 1.0)}::double * (0.7::double + 0.3::double * confidence) / (1.0::double + 0.05::double * coalesce(hops, 0))
        * case when urgent then 1.15::double else 1.0::double end, 1.0::double) as score from based),
per as (select event_id, any_value(event_type) as event_type, any_value(origin) as origin, max(score) as top, count(*) as n_affected, count(*) filter (where coverage < 0.5) as n_gaps,
    arg_min(node, (coalesce(hops, 0), node)) filter (where node like 'model.trade.o%' and try_cast(substr(node, 14) as bigint) % 3 > 0) as model_id from final group by 1),
leveled as (select *, case when top >= 0.85 then 'critical' when top >= 0.60 then 'high' when top >= 0.30 then 'medium' else 'low' end as risk_level,
    event_type in ('column_added', 'column_removed', 'type_changed', 'nullability_changed') as changed from per),
reported as (select event_id, origin, risk_level, round(top, 6) as max_score, n_affected, n_gaps, (select count(distinct node) from touched t where t.event_id = l.event_id and pruned) as n_pruned,
    (select string_agg(r_name, ',' order by r_name) from sr join region on r = 'exposure.trade.r' || r_regionkey where s = origin) as exposures, model_id, risk_level in ('high', 'critical') and changed as eligible,
    'log' || case when risk_level <> 'low' then ',slack_alert' else '' end as planned from leveled l)"""


def oracle_sql() -> dict[str, str]:
    models = " union all ".join(f"select '{m}' as model, count(*) as n_rows from {m}" for m in project.models)
    filled = " union all ".join(f"select '{project.node_id(n)}.{c}' as node, count({c}) as n_filled from {n}" for n, c in {x for a, b, c, d, _ in q.PRICE_EDGES for x in ((a, b), (c, d))})
    market = q.market_oracles()
    names = [*project.models]
    below = "select s as origin, o as node, 1 as depth from so union all select s, c, 2 from sc union all select s, n, 3 from sn"
    return {
        "graph_nodes": NODES_SQL, "graph_edges": EDGES_SQL, "downstream": f"with {WALK_SQL} {below}",
        "upstream": f"""with {WALK_SQL} select n as origin, c as node, 1 as depth from cn union all select distinct n, o, 2 from cn join oc using (c) union all select n, s, 3 from sn""",
        "exposure_paths": f"""with {WALK_SQL} select s as origin, r_name as exposure, case when r_regionkey % 2 = 0 then 'high' else 'medium' end as priority, 4 as depth, s || '>' || o || '>' || c || '>' || n || '>' || r as path
            from so join oc using (o) join cn using (c) join nr using (n) join region on r = 'exposure.trade.r' || r_regionkey where s like 'source.trade.s%'""",
        "exposure_distance": f"with {WALK_SQL} select distinct s as node, 4 as distance from so join oc using (o) union all select o, 3 from oc union all select c, 2 from cn union all select n, 1 from nr",
        "fan_outs": f"with {WALK_SQL} select s as node, count(*) as fan_out from so group by 1 union all select o, 1 from oc union all select c, 1 from cn",
        "column_tests": """select 'source.trade.s' || s_suppkey as node, 2 as n_columns, 0 as n_tested, 0.0::double as coverage, 0 as n_tests from supplier union all select 'source.trade.p' || p_partkey, 2, 0, 0, 0 from part
            union all select 'model.trade.o' || o_orderkey, 3, urgent, round(urgent / 3, 6), urgent from (select *, (o_orderpriority = '1-URGENT')::int as urgent from orders)
            union all select 'model.trade.c' || c_custkey, 2, own, own / 2, 2 * own from (select *, (c_mktsegment = 'BUILDING')::int as own from customer)
            union all select 'model.trade.n' || n_nationkey, 2, 0, 0, 0 from nation union all select 'exposure.trade.r' || r_regionkey, 0, 0, 0, 0 from region""",
        "node_properties": """select 'exposure.trade.r1' as unique_id, unnest(['unique_id', 'name', 'label', 'priority', 'maturity', 'exposure_type']) as property,
            unnest(['exposure.trade.r1', r_name, 'Exposure', 'medium', 'high', 'dashboard']) as value from region where r_regionkey = 1""",
        "test_owner": "select 'test.trade.assert_n' || n_nationkey as test_id, 'model.trade.n' || n_nationkey as model_id from nation where n_nationkey = 3",
        "column_flow": """with o1 as (select 'source.trade.s' || l_suppkey || '.balance' as origin, l_orderkey, max(1 - l_discount) as conf from lineitem where l_returnflag <> 'A' group by 1, 2
                union all select 'source.trade.p' || l_partkey || '.price', l_orderkey, max(1 - l_tax) from lineitem group by 1, 2),
            c1 as (select origin, o_custkey, max(least(conf, 1 - substr(o_orderpriority, 1, 1)::int / 20::double)) as conf from o1 join orders on o_orderkey = l_orderkey where o_orderstatus <> 'P' group by 1, 2),
            n1 as (select origin, c_nationkey, max(least(conf, case when c_acctbal > 0 then 0.9::double else 0.6::double end)) as conf from c1 join customer on c_custkey = o_custkey where c_acctbal > -500 group by 1, 2)
            select origin, 'model.trade.o' || l_orderkey || '.total' as node, round(conf, 6) as confidence, 1 as hops from o1 union all select origin, 'model.trade.c' || o_custkey || '.balance', round(conf, 6), 2 from c1
            union all select origin, 'model.trade.n' || c_nationkey || '.balance', round(conf, 6), 3 from n1""",
        "blast_radius": f"with {BLAST_SQL} select event_id, f.origin, node, round(confidence, 6) as confidence, hops, pruned from touched join fine f using (event_id)",
        "blast_scores": f"with {BLAST_SQL} select event_id, origin, node, round(coverage, 6) as coverage, fan_out, distance, hops, round(base, 10) as base_score, round(score, 10) as score from final",
        "impact_reports": f"""with {BLAST_SQL} select event_id, origin, risk_level, max_score, n_affected, n_gaps, n_pruned, exposures, planned || case when eligible then ',github_pr' else '' end as actions, model_id from reported""",
        "drafted_fixes": f"""with {BLAST_SQL} select event_id, model_id, eligible as fix_eligible, case when eligible and event_id % 4 > 1 then 'select ' || event_id || ' as fixed' end as fix_sql,
            planned || case when eligible and event_id % 4 > 1 then ',github_pr' else '' end as actions from reported""",
        "unknown_nodes": f"with {EVENTS_SQL} select event_id, node_id, 'node not found' as error, 'low' as risk_level from ev where event_id % 10 = 9",
        "node_lanes": f"""with {WALK_SQL}, broken as (select node from ({below}) where origin = 'source.trade.s1') select unique_id as node, name, label, layer,
            case when unique_id = 'source.trade.s1' then 'root' when unique_id in (select node from broken) then 'broken' else 'healthy' end as status from ({NODES_SQL})""",
        "graph_counts": f"""with {WALK_SQL} select 'graph_nodes' as name, (select count(*) from ({NODES_SQL})) as n union all select 'graph_edges', (select count(*) from so) + (select count(*) from oc) + (select count(*) from cn) + (select count(*) from nr)
            union all select 'graph_tests', (select count(*) from orders where o_orderpriority = '1-URGENT') + (select 2 * count(*) from customer where c_mktsegment = 'BUILDING') + (select count(*) from nation)
            union all select 'graph_columns', (select 2 * count(*) from supplier) + (select 2 * count(*) from part) + (select 3 * count(*) from orders) + (select 2 * count(*) from customer) + (select 2 * count(*) from nation)
            union all select 'graph_lineage', (select count(*) from (select distinct l_suppkey, l_orderkey, l_discount from lineitem where l_returnflag <> 'A')) + (select count(*) from (select distinct l_partkey, l_orderkey, l_tax from lineitem))
                + (select count(*) from orders where o_orderstatus <> 'P') + (select count(*) from customer where c_acctbal > -500)""",
        "lineage_resolution": oracle(f"select model, n_columns, n_resolved, n_rows from ({market['lineage_resolution']}) join ({models}) using (model)", *names),
        "price_lineage": oracle(f"select t.node, depth, confidence, path, n_filled from ({market['price_lineage']}) t join ({filled}) f on f.node = t.node", *names),
        "price_origin": oracle(f"select t.node, depth, confidence, path, n_filled from ({market['price_origin'].replace('select node, depth, confidence::double as confidence from reach', 'select node, depth, confidence::double as confidence, path from reach')}) t join ({filled}) f on f.node = t.node", *names),
    }
