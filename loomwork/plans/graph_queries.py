"""Queries and oracle SQL of the graph, lineage, risk, impact and incident operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators import graph as g
from loomwork.operators import impact, incidents, lineage, risk
from loomwork.session import table
from loomwork.sources.star import raw_tables

from .market import project

START = project.node_id("coingecko_coins_markets")
#: The column edges that carry one price column through the warehouse.
PRICE_EDGES = [
    ("coingecko_coins_markets", "current_price", "stg_coingecko__coins_markets", "current_price_usd", 0.5),
    ("stg_coingecko__coins_markets", "current_price_usd", "int_token_profiles", "current_price_usd", 1.0),
    ("int_token_profiles", "current_price_usd", "fct_daily_token_metrics", "current_price_usd", 1.0),
    ("int_token_profiles", "current_price_usd", "fct_protocol_health", "governance_token_price_usd", 1.0),
]


def _edges() -> list[tuple]:
    return [(project.node_id(a), b, project.node_id(c), d, s) for a, b, c, d, s in PRICE_EDGES]


def market_graph(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """The market project's graph tables and built frames (lazy; only schemas are read)."""
    frames = project.build(spark, raw_tables(spark, sf_dir))
    return g.frames_of(spark, g.node_rows(project), g.edge_rows(project), g.test_rows(project), g.column_rows(project, frames)), frames


def _roots(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market_graph(spark, sf_dir)[0]["graph_nodes"].select("unique_id", "name", "label", "layer", "materialized", "priority")


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market_graph(spark, sf_dir)[0]["graph_edges"]


def downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, _ = market_graph(spark, sf_dir)
    return g.dependent_models(graph, graph["graph_nodes"].filter("label = 'Source'").select(F.col("unique_id").alias("id")))


def upstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, _ = market_graph(spark, sf_dir)
    return g.dependent_models(graph, graph["graph_nodes"].filter("layer = 'marts'").select(F.col("unique_id").alias("id")), upstream=True)


def exposure_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, _ = market_graph(spark, sf_dir)
    return g.paths_to_exposures(graph, _roots(spark, START)).select("exposure", "priority", "depth", F.array_join("path", ">").alias("path"))


def exposure_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, _ = market_graph(spark, sf_dir)
    reached = g.reached_exposures(graph, graph["graph_nodes"].select(F.col("unique_id").alias("id")))
    return g.nearest_exposure(reached).select(F.col("origin").alias("node"), "distance")


def fan_outs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.fan_out(market_graph(spark, sf_dir)[0])


def column_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of the models (the columns of sources are tested nowhere)."""
    return g.test_coverage(market_graph(spark, sf_dir)[0]).filter("n_tested > 0").select("node", "n_tested", F.size("tests").alias("n_tests"))


def node_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = g.node_metadata(market_graph(spark, sf_dir)[0], project.node_id("whale_alert_pipeline"))
    return rows.select("unique_id", F.explode("properties").alias("property", "value"))


def test_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.tested_model(market_graph(spark, sf_dir)[0], "test.market.unique_dim_tokens_coin_id")


def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All column edges that the analyzed plans of the 17 models give."""
    return lineage.column_lineage(spark, project, market_graph(spark, sf_dir)[1])


def lineage_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many columns of each model have a source; counts of rows have none."""
    return spark.createDataFrame(lineage.resolution(project, market_graph(spark, sf_dir)[1]), "model string, n_columns int, n_resolved int")


def price_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column edges below one raw price column, found in the plans."""
    edges = lineage_edges(spark, sf_dir)
    trails = g.column_trails(edges, _roots(spark, f"{START}.current_price"))
    return trails.select("node", "depth", "confidence", F.array_join("path", ">").alias("path"))


def price_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same trails backward from a mart column."""
    edges = spark.createDataFrame(_edges(), lineage.EDGES)
    goal = f"{project.node_id('fct_protocol_health')}.governance_token_price_usd"
    return g.column_trails(edges, _roots(spark, goal), backward=True).select("node", "depth", "confidence")


def _events(spark: SparkSession) -> DataFrame:
    rows = [(1, START, "current_price", "column_removed", "critical"), (2, project.node_id("defi_llama_yields_pools"), None, "row_count_drop", "error"),
            (3, "test.market.unique_int_whale_activity_address", None, "test_failure", "warning"), (4, "model.market.nothing", None, "freshness_violation", "error"),
            (5, START, "no_such_column", "column_added", "info")]
    return spark.createDataFrame(rows, "event_id int, node_id string, column_name string, event_type string, severity string")


def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, frames = market_graph(spark, sf_dir)
    return impact.affected(spark, graph, lineage.column_lineage(spark, project, frames), _events(spark))


def blast_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, frames = market_graph(spark, sf_dir)
    rows = impact.scored(spark, graph, lineage.column_lineage(spark, project, frames), _events(spark))
    return rows.withColumns({"base_score": F.round("base_score", 6), "score": F.round("score", 6)})


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, frames = market_graph(spark, sf_dir)
    return impact.report(spark, graph, lineage.column_lineage(spark, project, frames), _events(spark))


def impact_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports(spark, sf_dir)
    return rows.select("event_id", "origin", "risk_level", "n_affected", "n_gaps", F.array_join("top_nodes", ",").alias("top_nodes"), "n_pruned", F.array_join("exposures", ",").alias("exposures"),
                       F.array_join(F.transform("actions", lambda a: a["type"]), ",").alias("actions"), "model_id")


def unknown_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.unknown(market_graph(spark, sf_dir)[0], _events(spark))


def node_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, _ = market_graph(spark, sf_dir)
    below = g.dependent_models(graph, _roots(spark, START)).select("node", F.lit(False).alias("is_root"))
    return impact.lanes(graph, below.unionByName(_roots(spark, START).select(F.col("id").alias("node"), F.lit(True).alias("is_root"))))


_KINDS = tuple(risk.ANOMALY)


def _risk_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("p_partkey") % len(_KINDS) + 1).cast("int"))
    return p.select("p_partkey", (F.col("p_size") % 5 / 4.0).alias("coverage"), (F.col("p_partkey") % 14).alias("fan_out"),
                    F.when(F.col("p_partkey") % 6 > 0, F.col("p_partkey") % 6).alias("distance"),
                    F.element_at(F.array(*map(F.lit, ("view", "table", "incremental", "seed"))), (F.col("p_size") % 4 + 1).cast("int")).alias("materialized"),
                    kind.alias("event_type"), F.element_at(F.array(*map(F.lit, risk.SEVERITY)), (F.col("p_partkey") % 4 + 1).cast("int")).alias("severity"),
                    (F.col("p_size") % 5 / 2.0 - 0.5).alias("confidence"), (F.col("p_partkey") % 9 - 2).alias("hops"), (F.col("p_partkey") % 2 == 0).alias("urgent"))


def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and final score, level and number of actions of a node per part."""
    c = F.col
    rows = _risk_inputs(spark, sf_dir).withColumn("base", risk.base_score(c("coverage"), c("fan_out"), c("distance"), c("materialized"), c("event_type")))
    rows = rows.withColumn("score", F.round(risk.in_context(c("base"), c("severity"), c("confidence"), c("hops"), c("urgent")), 9))
    level = risk.level(c("score"))
    planned = risk.actions(level, c("event_type"), pull_requests=True, pause=True, approval=True)
    return rows.select("p_partkey", F.round("base", 9).alias("base"), "score", level.alias("risk_level"),
                       F.array_join(F.transform(planned, lambda a: F.concat(a["type"], F.lit(":"), a["status"])), ",").alias("actions"))


def _case(key: str, values: dict[str, float], other: float) -> str:
    return f"case {key} " + " ".join(f"when '{k}' then {v}" for k, v in values.items()) + f" else {other} end"


def _pick(values: tuple[str, ...], index: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], ({index} + 1)::int)"


RISK_SQL = f"""
with i as (select p_partkey, p_size % 5 / 4.0 as coverage, p_partkey % 14 as fan_out, case when p_partkey % 6 > 0 then p_partkey % 6 end as distance,
        {_pick(('view', 'table', 'incremental', 'seed'), 'p_size % 4')} as materialized, {_pick(_KINDS, f'p_partkey % {len(_KINDS)}')} as event_type,
        {_pick(tuple(risk.SEVERITY), 'p_partkey % 4')} as severity, p_size % 5 / 2.0 - 0.5 as confidence, p_partkey % 9 - 2 as hops, p_partkey % 2 = 0 as urgent from part),
b as (select *, least(((1.0 - coverage)::double * 0.30 + least(fan_out / 10.0::double, 1.0) * 0.25 + coalesce(1.0::double / (distance + 1), 0) * 0.25
        + {_case('materialized', risk.MATERIALIZED, 0.5)}::double * 0.20) * {_case('event_type', risk.ANOMALY, 1.0)}::double, 1.0) as base from i),
s as (select *, round(least(base * {_case('severity', risk.SEVERITY, 1.0)}::double * (0.7 + 0.3 * least(greatest(confidence::double, 0), 1)) / (1.0::double + 0.05::double * greatest(hops, 0))
        * case when urgent then 1.15::double else 1.0 end, 1.0), 9) as score from b),
l as (select *, case when score >= 0.85 then 'critical' when score >= 0.60 then 'high' when score >= 0.30 then 'medium' else 'low' end as risk_level from s)
select p_partkey, round(base, 9) as base, score, risk_level, 'log:planned' || case when risk_level <> 'low' then ',slack_alert:planned' else '' end
       || case when risk_level in ('high', 'critical') and event_type in ('column_added', 'column_removed', 'type_changed', 'nullability_changed') then ',github_pr:pending' else '' end
       || case when risk_level = 'critical' then ',pause_dbt_run:pending' else '' end as actions from l"""


def _incident_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users as anomalies of nodes."""
    level = F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), (F.col("event_id") % 4 + 1).cast("int"))
    severity = F.element_at(F.array(*map(F.lit, ("info", "warning", "error", "critical"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("node_id"), "event_type",
                                                 F.lit(None).cast("string").alias("column_name"), F.col("ts").alias("detected_at"), severity.alias("severity"), level.alias("risk_level"))


_INCIDENTS = f"""e as (select event_id, 'u' || (user_id % 20) as node_id, event_type, ts as detected_at, {_pick(('info', 'warning', 'error', 'critical'), 'event_id % 4')} as severity,
    event_id % 4 as sev, {_pick(('low', 'medium', 'high', 'critical'), 'event_id % 4')} as risk_level from events),
k as (select *, substr(sha256(node_id || '|' || event_type || '|'), 1, 16) as incident from e)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlated sessions with their primary event and size."""
    rows = incidents.correlate(_incident_events(spark, sf_dir))
    return rows.groupBy("node_id", "session").agg(F.count("*").alias("n_events"), F.max(F.when(F.col("is_primary"), F.col("event_id"))).alias("primary_id"))


SESSIONS_SQL = f"""
with {_INCIDENTS}, f as (select *, case when detected_at - lag(detected_at) over w <= interval 15 minute then 0 else 1 end as st from e window w as (partition by node_id order by detected_at, event_id)),
n as (select *, sum(st) over (partition by node_id order by detected_at, event_id rows unbounded preceding) as session from f)
select node_id, session::bigint as session, count(*) as n_events, arg_max(event_id, (sev, detected_at, event_id)) as primary_id from n group by 1, 2"""


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = incidents.suppress(_incident_events(spark, sf_dir))
    return rows.groupBy("incident").agg(F.count("*").alias("n_events"), F.count_if("duplicate").alias("n_suppressed"))


DUPLICATES_SQL = f"""
with {_INCIDENTS}, d as (select incident, coalesce(detected_at - lag(detected_at) over (partition by incident order by detected_at, event_id) < interval 60 minute, false) as dup from k)
select incident, count(*) as n_events, count(*) filter (where dup) as n_suppressed from d group by 1"""


def incident_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = incidents.memory(_incident_events(spark, sf_dir))
    return rows.select("incident", "n", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"), F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"), "last_risk", "node_id", "event_type")


MEMORY_SQL = f"""
with {_INCIDENTS} select incident, count(*) as n, strftime(min(detected_at), '%Y-%m-%d %H:%M:%S') as first_seen, strftime(max(detected_at), '%Y-%m-%d %H:%M:%S') as last_seen,
    arg_max(risk_level, (detected_at, event_id)) as last_risk, min(node_id) as node_id, min(event_type) as event_type from k group by 1"""


def _outcomes(stored: DataFrame) -> DataFrame:
    text = F.when(F.substring("incident", 1, 1).between("0", "7"), "actionable").otherwise("noise")
    return stored.filter(F.substring("incident", 2, 1) < "a").select("incident", text.alias("outcome"), F.col("last_seen").alias("at"))


def risk_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents by last risk with the actionable rate of their feedback; half of the events merged in a second batch."""
    rows = _incident_events(spark, sf_dir)
    stored = incidents.merge(incidents.memory(rows.filter("detected_at < timestamp_ntz'2024-01-15 00:00:00'")), incidents.memory(rows.filter("detected_at >= timestamp_ntz'2024-01-15 00:00:00'")))
    out = incidents.calibration(stored, _outcomes(stored))
    return out.withColumn("actionable_rate", F.round("actionable_rate", 6))


CALIBRATION_SQL = f"""
with {_INCIDENTS}, m as (select incident, count(*) as n, arg_max(risk_level, (detected_at, event_id)) as last_risk from k group by 1),
o as (select incident, case when substr(incident, 1, 1) between '0' and '7' then 1 else 0 end as good from m where substr(incident, 2, 1) < 'a')
select last_risk, count(*) as n_incidents, sum(n)::bigint as n_events, round(avg(good), 6) as actionable_rate, coalesce(avg(good) < 0.5, false) as warn from m left join o using (incident) group by 1"""


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The executor's decision on every kind of action."""
    p = table(spark, sf_dir, "part").select(
        "p_partkey", F.element_at(F.array(*map(F.lit, risk.PRIORITY)), (F.col("p_partkey") % 4 + 1).cast("int")).alias("action"), (F.col("p_size") % 5 == 0).alias("duplicate"),
        (F.col("p_size") % 3 == 0).alias("held"), F.when(F.col("p_size") % 2 == 0, "select 1").alias("fix_sql"))
    return risk.execution(p).select("p_partkey", "action", "outcome", "step")


EXECUTIONS_SQL = f"""
with a as (select p_partkey, {_pick(tuple(risk.PRIORITY), 'p_partkey % 4')} as action, p_size % 5 = 0 as seen_before, p_size % 3 = 0 as waiting, p_size % 2 = 0 as drafted from part)
select p_partkey, action, case action when 'log' then 'executed'
        when 'github_pr' then case when seen_before then 'skipped_duplicate' when waiting then 'pending_approval' when drafted then 'executed' else 'no_fix_sql' end
        when 'slack_alert' then case when seen_before then 'skipped_duplicate' else 'executed' end
        when 'pause_dbt_run' then case when waiting then 'pending_approval' else 'paused' end end as outcome,
       case action when 'log' then 0 when 'github_pr' then 1 when 'slack_alert' then 2 else 3 end as step from a"""


#: The warehouse's graph by hand: name, label, layer, how it is built, priority of an exposure, and its direct inputs.
GRAPH = """
coingecko_coins_markets Source - - - -
coingecko_coins_detail Source - - - -
coingecko_exchanges Source - - - -
defi_llama_protocols Source - - - -
defi_llama_yields_pools Source - - - -
etherscan_eth_transactions Source - - - -
etherscan_token_transfers Source - - - -
stg_coingecko__coins_markets Model staging view - coingecko_coins_markets
stg_coingecko__coins_detail Model staging view - coingecko_coins_detail
stg_coingecko__exchanges Model staging view - coingecko_exchanges
stg_defi_llama__protocols Model staging view - defi_llama_protocols
stg_defi_llama__yields_pools Model staging view - defi_llama_yields_pools
stg_etherscan__transactions Model staging view - etherscan_eth_transactions
stg_etherscan__token_transfers Model staging view - etherscan_token_transfers
int_token_profiles Model intermediate view - stg_coingecko__coins_markets,stg_coingecko__coins_detail,stg_defi_llama__protocols,stg_etherscan__token_transfers
int_protocol_metrics Model intermediate view - stg_defi_llama__protocols,stg_defi_llama__yields_pools
int_whale_activity Model intermediate view - stg_etherscan__transactions,stg_etherscan__token_transfers
int_exchange_token_coverage Model intermediate view - stg_coingecko__exchanges,stg_coingecko__coins_markets
fct_daily_token_metrics Model marts table - int_token_profiles,int_whale_activity
fct_protocol_health Model marts table - int_protocol_metrics,int_token_profiles
fct_whale_movements Model marts table - int_whale_activity,int_token_profiles
dim_tokens Model marts table - stg_coingecko__coins_detail
dim_protocols Model marts table - stg_defi_llama__protocols
dim_exchanges Model marts table - stg_coingecko__exchanges
defi_market_slack_bot Exposure - - high fct_daily_token_metrics,fct_protocol_health
whale_alert_pipeline Exposure - - medium fct_whale_movements,dim_tokens
"""
#: How many columns of each model are tested, and by how many tests.
TESTED = """
stg_coingecko__coins_markets 2 3
stg_coingecko__coins_detail 2 3
stg_coingecko__exchanges 2 3
stg_defi_llama__protocols 2 3
stg_defi_llama__yields_pools 2 3
stg_etherscan__transactions 2 3
stg_etherscan__token_transfers 2 3
int_token_profiles 1 3
int_protocol_metrics 1 3
int_whale_activity 1 2
int_exchange_token_coverage 3 6
fct_daily_token_metrics 1 2
fct_protocol_health 1 3
fct_whale_movements 1 3
dim_tokens 1 3
dim_protocols 1 2
dim_exchanges 1 2
"""
#: What the graph queries are compared with: tables made of the two texts above, and recursions over sets of nodes, in the oracle's dialect.
GRAPH_SQL = f"""lines as (select string_split(line, ' ') as f from (select unnest(string_split(trim('{GRAPH}', chr(10)), chr(10))) as line)),
found as (select f[1] as name, f[2] as label, nullif(f[3], '-') as layer, nullif(f[4], '-') as materialized, nullif(f[5], '-') as priority, nullif(f[6], '-') as inputs,
    case when f[2] = 'Source' then 'source.market.' || regexp_extract(f[1], '^(coingecko|defi_llama|etherscan)') || '.' || f[1] else lower(f[2]) || '.market.' || f[1] end as id from lines),
steps as (select a.id as source_id, b.id as target_id, case when b.label = 'Exposure' then 'consumes' when a.label = 'Source' then 'source' else 'ref' end as edge_type
    from (select id, label, unnest(string_split(inputs, ',')) as parent from found) b join found a on a.name = b.parent)"""


def _within(kinds: str, upstream: bool = False) -> str:
    """``hops(origin, node, depth)``: sets of nodes that are reached in as many hops, from every node."""
    start, goal = ("target_id", "source_id") if upstream else ("source_id", "target_id")
    return f"""{GRAPH_SQL}, hops(origin, node, depth) as (select {start}, {goal}, 1 from steps where edge_type in ({kinds})
        union select origin, {goal}, depth + 1 from hops join steps on {start} = node where edge_type in ({kinds}) and depth < 15),
        nearest as (select origin, node, min(depth) as depth from hops group by 1, 2)"""


INNER, EVERY = "'ref', 'source'", "'ref', 'source', 'consumes'"
#: For each event of ``blast_radius`` the nodes it touches: event, node, hops, confidence, whether pruned.
BLAST = """
1 coingecko_coins_markets 0 0.5 n
1 stg_coingecko__coins_markets 1 0.5 n
1 int_token_profiles 2 0.5 n
1 fct_daily_token_metrics 3 0.5 n
1 fct_protocol_health 3 0.5 n
1 int_exchange_token_coverage - - y
1 fct_whale_movements - - y
2 defi_llama_yields_pools 0 1.0 n
2 stg_defi_llama__yields_pools 1 1.0 n
2 int_protocol_metrics 1 1.0 n
2 fct_protocol_health 1 1.0 n
3 int_whale_activity 0 1.0 n
3 fct_daily_token_metrics 1 1.0 n
3 fct_whale_movements 1 1.0 n
5 coingecko_coins_markets 0 1.0 n
5 stg_coingecko__coins_markets - 1.0 n
5 int_token_profiles - 1.0 n
5 int_exchange_token_coverage - 1.0 n
5 fct_daily_token_metrics - 1.0 n
5 fct_protocol_health - 1.0 n
5 fct_whale_movements - 1.0 n
5 stg_coingecko__coins_markets - - y
5 int_token_profiles - - y
5 int_exchange_token_coverage - - y
5 fct_daily_token_metrics - - y
5 fct_protocol_health - - y
5 fct_whale_movements - - y
"""
#: Columns of each model, and how many of them are counts of rows.
WIDTHS = """
stg_coingecko__coins_markets 10 0
stg_coingecko__coins_detail 11 0
stg_coingecko__exchanges 8 0
stg_defi_llama__protocols 11 0
stg_defi_llama__yields_pools 9 0
stg_etherscan__transactions 10 0
stg_etherscan__token_transfers 10 0
int_token_profiles 21 0
int_protocol_metrics 10 1
int_whale_activity 4 1
int_exchange_token_coverage 8 0
fct_daily_token_metrics 15 0
fct_protocol_health 13 0
fct_whale_movements 7 0
dim_tokens 10 0
dim_protocols 11 0
dim_exchanges 8 0
"""
BLAST_SQL = f"""blast as (select f[1]::int as event_id, f[2] as name, try_cast(nullif(f[3], '-') as int) as hops, try_cast(nullif(f[4], '-') as double) as confidence, f[5] = 'y' as pruned
    from (select string_split(line, ' ') as f from (select unnest(string_split(trim('{BLAST}', chr(10)), chr(10))) as line))),
wide as (select f[1] as name, f[2]::int as n_columns from (select string_split(line, ' ') as f from (select unnest(string_split(trim('{WIDTHS}', chr(10)), chr(10))) as line))),
tested as (select f[1] as name, f[2]::int as n_tested from (select string_split(line, ' ') as f from (select unnest(string_split(trim('{TESTED}', chr(10)), chr(10))) as line))),
happened as (select * from (values (1, 'coingecko_coins_markets', 'column_removed', 1.25, 1.3), (2, 'defi_llama_yields_pools', 'row_count_drop', 1.1, 0.9), (3, 'int_whale_activity', 'test_failure', 0.95, 1.0),
    (5, 'coingecko_coins_markets', 'column_added', 0.85, 0.3)) t(event_id, root, event_type, severe, kind)),
facts as (select b.*, h.event_type, h.severe, h.kind, r.id as origin, n.id as node, n.materialized, coalesce(coalesce(t.n_tested, 0) / w.n_columns, 0) as coverage,
        (select count(distinct target_id) from steps where source_id = n.id and edge_type <> 'consumes') as fan_out,
        (select min(depth) from nearest x join found e on e.id = x.node and e.label = 'Exposure' where x.origin = n.id) as distance,
        exists (select 1 from nearest x join found e on e.id = x.node and e.priority = 'high' where x.origin = r.id) as urgent
    from blast b join happened h using (event_id) join found r on r.name = h.root join found n on n.name = b.name left join tested t on t.name = b.name left join wide w on w.name = b.name),
based as (select *, least(((1 - coverage) * 0.30 + least(fan_out / 10, 1) * 0.25 + coalesce(1 / (distance + 1), 0) * 0.25 + case materialized when 'view' then 1.0 when 'table' then 0.7 else 0.5 end * 0.20) * kind, 1.0) as base from facts where not pruned),
final as (select *, least(base * severe * (0.7 + 0.3 * confidence) / (1 + 0.05 * coalesce(hops, 0)) * case when urgent then 1.15 else 1.0 end, 1.0) as final_score from based)"""
REPORT_SQL = f"""with recursive {_within(EVERY)}, {BLAST_SQL},
per as (select event_id, any_value(event_type) as event_type, any_value(origin) as origin, max(final_score) as top, count(*) as n_affected, count(*) filter (where coverage < 0.5) as n_gaps,
    array_to_string((array_agg(node order by final_score desc, node))[1:5], ',') as top_nodes from final group by 1),
leveled as (select *, case when top >= 0.85 then 'critical' when top >= 0.60 then 'high' when top >= 0.30 then 'medium' else 'low' end as risk_level from per)
select event_id, origin, risk_level, n_affected, n_gaps, top_nodes, (select count(distinct name) from blast b where b.event_id = l.event_id and pruned) as n_pruned,
    (select string_agg(e.name, ',' order by e.name) from nearest x join found e on e.id = x.node and e.label = 'Exposure' where x.origin = l.origin) as exposures,
    'log' || case when risk_level <> 'low' then ',slack_alert' else '' end || case when risk_level in ('high', 'critical') and event_type in ('column_added', 'column_removed', 'type_changed', 'nullability_changed') then ',github_pr' else '' end as actions,
    case event_id when 1 then 'model.market.stg_coingecko__coins_markets' when 2 then 'model.market.stg_defi_llama__yields_pools' when 5 then 'model.market.stg_coingecko__coins_markets' end as model_id
from leveled l"""


#: The market project's own graph, held by tests against texts written by hand; the registered queries of these names walk the graph of the given tables.
MARKET = (graph_nodes, graph_edges, downstream, upstream, exposure_paths, exposure_distance, fan_outs, column_tests, node_properties, test_owner, lineage_resolution, price_lineage, price_origin, blast_radius,
          blast_scores, impact_reports, unknown_nodes, node_lanes)


def queries() -> dict:
    return {f.__name__: f for f in (risk_scores, sessions, duplicates, incident_memory, risk_calibration, executions)}


def oracle_sql() -> dict[str, str]:
    return {"risk_scores": RISK_SQL, "sessions": SESSIONS_SQL, "duplicates": DUPLICATES_SQL, "incident_memory": MEMORY_SQL, "risk_calibration": CALIBRATION_SQL, "executions": EXECUTIONS_SQL}


def market_oracles() -> dict[str, str]:
    price = ", ".join(f"('{a}.{b}', '{c}.{d}', {s})" for a, b, c, d, s in _edges())
    trail = lambda start, goal, root: f"""with recursive edges(u, d, s) as (values {price}), reach(node, depth, path, confidence) as (
        select {goal}, 1, {start} || '>' || {goal}, s from edges where {start} = '{root}'
        union all select {goal}, depth + 1, path || '>' || {goal}, least(confidence, s) from reach join edges on {start} = node)"""  # noqa: E731
    goal = f"{project.node_id('fct_protocol_health')}.governance_token_price_usd"
    return {
        "graph_nodes": f"with {GRAPH_SQL} select id as unique_id, name, label, layer, materialized, priority from found",
        "graph_edges": f"with {GRAPH_SQL} select * from steps",
        "downstream": f"with recursive {_within(INNER)} select origin, node, depth from nearest join found on id = origin where label = 'Source'",
        "upstream": f"with recursive {_within(INNER, True)} select origin, node, depth from nearest join found on id = origin where layer = 'marts'",
        "exposure_paths": f"""with recursive {GRAPH_SQL}, trails(node, depth, path) as (select '{START}', 0, '{START}'
            union all select target_id, depth + 1, path || '>' || target_id from trails join steps on source_id = node)
            select name as exposure, priority, depth, path from trails join found on id = node where label = 'Exposure'""",
        "exposure_distance": f"with recursive {_within(EVERY)} select origin as node, min(depth) as distance from nearest join found on id = node where label = 'Exposure' group by 1",
        "fan_outs": f"with {GRAPH_SQL} select source_id as node, count(distinct target_id) as fan_out from steps where edge_type <> 'consumes' group by 1",
        "column_tests": f"""with {GRAPH_SQL}, tested as (select string_split(line, ' ') as f from (select unnest(string_split(trim('{TESTED}', chr(10)), chr(10))) as line))
            select id as node, f[2]::int as n_tested, f[3]::int as n_tests from tested join found on name = f[1]""",
        "node_properties": """select 'exposure.market.whale_alert_pipeline' as unique_id, property, value from (values ('unique_id', 'exposure.market.whale_alert_pipeline'), ('name', 'whale_alert_pipeline'),
            ('label', 'Exposure'), ('priority', 'medium'), ('maturity', 'medium'), ('exposure_type', 'ml')) t(property, value)""",
        "test_owner": "select 'test.market.unique_dim_tokens_coin_id' as test_id, 'model.market.dim_tokens' as model_id",
        "lineage_resolution": f"""select f[1] as model, f[2]::int as n_columns, f[2]::int - f[3]::int as n_resolved
            from (select string_split(line, ' ') as f from (select unnest(string_split(trim('{WIDTHS}', chr(10)), chr(10))) as line))""",
        "price_lineage": trail("u", "d", f"{START}.current_price") + " select node, depth, confidence::double as confidence, path from reach",
        "price_origin": trail("d", "u", goal) + " select node, depth, confidence::double as confidence from reach",
        "unknown_nodes": "select 4 as event_id, 'model.market.nothing' as node_id, 'node not found' as error, 'low' as risk_level",
        "node_lanes": f"""with recursive {_within(INNER)} select id as node, name, label, layer, case when id = '{START}' then 'root' when id in (select node from nearest where origin = '{START}') then 'broken' else 'healthy' end as status from found""",
        "blast_radius": f"""with recursive {_within(EVERY)}, {BLAST_SQL} select event_id, origin, node, hops, confidence, pruned from facts""",
        "blast_scores": f"""with recursive {_within(EVERY)}, {BLAST_SQL} select event_id, event_type, origin, node, coverage, fan_out, distance, hops, confidence, round(base, 6) as base_score, round(final_score, 6) as score from final""",
        "impact_reports": REPORT_SQL,
    }
