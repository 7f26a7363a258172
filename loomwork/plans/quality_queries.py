"""Queries and oracle SQL of scalar expressions, data tests, profiles and detectors on the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.columns import canonical_id, clipped, idempotency_key, incident_key, latest, layer_of, safe, surrogate_key, test_kind
from loomwork.operators import checks, inject, profile, schema
from loomwork.session import table

from .registry import DataTest, Project

star = Project("star")
#: Keys and references of the star schema.
STAR_TESTS = [
    *[DataTest("unique", m, c) for m, c in (("part", "p_partkey"), ("orders", "o_orderkey"), ("customer", "c_custkey"), ("lineitem", "l_orderkey"), ("labels", "doc_id"))],
    *[DataTest("not_null", m, c) for m, c in (("part", "p_name"), ("orders", "o_custkey"), ("lineitem", "l_shipdate"))],
    DataTest("relationships", "orders", "o_custkey", "customer", "c_custkey"), DataTest("relationships", "lineitem", "l_partkey", "part", "p_partkey"),
    DataTest("relationships", "documents", "doc_id", "labels", "doc_id"),
    DataTest("custom", "customer", "c_acctbal", failing="c_acctbal < 0"), DataTest("custom", "part", "p_type", failing="lower(p_type) like '%brass%' and p_size < 3"),
]


def typed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed staging of an all-string copy of events: safe and strict casts, JSON, epochs, scaling, booleans, CASE."""
    raw = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("user"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string").alias("epoch"),
        F.when(F.col("event_id") % 7 == 0, "junk").otherwise(F.round("value", 2).cast("decimal(18,2)").cast("string")).alias("value"), "event_type", "props")
    key = F.get_json_object("props", "$.k").try_cast("int")
    return raw.filter("id is not null").select(
        safe("id", "bigint").alias("event_id"), safe("user", "int").alias("user_id"), F.date_format(F.timestamp_seconds(safe("epoch", "bigint")), "yyyy-MM-dd HH:mm:ss").alias("at"),
        safe("value", "decimal(38,8)").cast("double").alias("value"), key.alias("k"), F.upper("event_type").alias("kind"), (F.lower("event_type") == "purchase").alias("is_purchase"),
        (safe("value", "double") / F.pow(F.lit(10), F.lit(2))).alias("scaled"), F.when(F.col("event_type").isin("click", "view"), "light").when(F.col("event_type").isin("purchase"), "heavy").alias("weight"))


TYPED_SQL = """
with raw as (select cast(event_id as varchar) as id, cast(user_id as varchar) as usr, cast(epoch(date_trunc('second', ts))::bigint as varchar) as ep,
             case when event_id % 7 = 0 then 'junk' else cast(cast(round(value, 2) as decimal(18,2)) as varchar) end as value, event_type, props from events)
select try_cast(id as bigint) as event_id, try_cast(usr as int) as user_id, strftime(make_timestamp(1000000 * try_cast(ep as bigint)), '%Y-%m-%d %H:%M:%S') as at,
       try_cast(value as double) as value, try_cast(json_extract_string(props, '$.k') as int) as k, upper(event_type) as kind, lower(event_type) = 'purchase' as is_purchase,
       try_cast(value as double) / pow(10, 2) as scaled, case when event_type in ('click', 'view') then 'light' when event_type = 'purchase' then 'heavy' end as weight
from raw where id is not null"""


def keys_and_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surrogate, incident and idempotency keys, identifiers, layers and clipped text."""
    p = table(spark, sf_dir, "part")
    name = F.concat(F.when(F.col("p_size") % 3 == 0, "stg_").when(F.col("p_size") % 3 == 1, "fct_").otherwise("raw_"), F.col("p_brand"))
    test = F.concat(F.lit("test.p."), F.when(F.col("p_size") % 2 == 0, "not_null_").otherwise("odd_"), F.col("p_brand"))
    folder = F.when(F.col("p_size") % 5 == 0, F.array(F.lit("models"), F.lit("intermediate"))).otherwise(F.array(F.lit("models")))
    return p.select("p_partkey", surrogate_key("p_name", F.when(F.col("p_size") > 25, F.col("p_brand")), "p_size").alias("row_key"),
                    incident_key("p_name", F.lit("type_changed"), F.when(F.col("p_size") > 25, F.col("p_brand"))).alias("incident"),
                    idempotency_key(F.lit("k"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")), "p_brand").alias("idempotency"),
                    canonical_id(F.lit("model"), F.lit("p"), name).alias("node"), layer_of(folder, name).alias("layer"), test_kind(test).alias("test_type"),
                    clipped("p_name", 8).alias("short_name"))


KEYS_SQL = """
with p as (select *, case p_size % 3 when 0 then 'stg_' when 1 then 'fct_' else 'raw_' end || p_brand as nm from part)
select p_partkey, md5(p_name || '-' || coalesce(case when p_size > 25 then p_brand end, '_dbt_utils_surrogate_key_null_') || '-' || p_size) as row_key,
       substr(sha256(p_name || '|type_changed|' || coalesce(case when p_size > 25 then p_brand end, '')), 1, 16) as incident,
       'k:' || strftime(date '2024-01-01' + p_size, '%Y%m%d') || ':' || p_brand as idempotency, 'model.p.' || nm as node,
       case when p_size % 5 = 0 then 'intermediate' when nm like 'stg\\_%' escape '\\' then 'staging' when nm like 'fct\\_%' escape '\\' then 'marts' end as layer,
       case when p_size % 2 = 0 then 'not_null' else 'custom' end as test_type,
       case when length(p_name) > 8 then substr(p_name, 1, 7) || '…' else p_name end as short_name
from p"""


def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest event of each user."""
    rows = latest(table(spark, sf_dir, "events"), ["user_id"], F.desc("ts"), F.desc("event_id"))
    return rows.select("user_id", "event_id", "event_type")


def data_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All star-schema tests with the number of violations."""
    frames = {name: table(spark, sf_dir, name) for t in STAR_TESTS for name in (t.model, t.parent) if name}
    return checks.run_tests(star, frames, STAR_TESTS)


def _test_sql(test: DataTest) -> str:
    if test.kind == "unique":
        bad = f"select {test.column} from {test.model} where {test.column} is not null group by 1 having count(*) > 1"
    elif test.kind == "relationships":
        bad = f"select 1 from {test.model} c where {test.column} is not null and not exists (select 1 from {test.parent} p where p.{test.parent_column} = c.{test.column})"
    else:
        bad = f"select 1 from {test.model} where {test.failing or test.column + ' is null'}"
    return f"select 'test.star.{test.name}' as test_id, case when count(*) > 0 then 'fail' else 'pass' end as status, count(*) as failures from ({bad})"


PROFILED = ("l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linenumber")


def _profile_sql(source: str, name: str, columns: tuple[str, ...]) -> str:
    value = "try_cast(cast({c} as varchar) as double)"
    return " union all ".join(f"""select '{name}' as table_name, '{c}' as column_name, count(*) as row_count, count(*) - count({c}) as null_count,
        case when count(*) > 0 then (count(*) - count({c})) / count(*) else 0.0 end as null_ratio, min({value.format(c=c)}) as min_value,
        max({value.format(c=c)}) as max_value, avg({value.format(c=c)}) as mean, stddev({value.format(c=c)}) as stddev, count({value.format(c=c)}) as value_count
        from ({source})""" for c in columns)


def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile of lineitem, long form."""
    df = profile.profile(table(spark, sf_dir, "lineitem"), "lineitem", list(PROFILED))
    return df.withColumns({c: F.round(c, 4) for c in ("null_ratio", "min_value", "max_value", "mean", "stddev")})


def _round_profile(sql: str) -> str:
    return f"""select table_name, column_name, row_count, null_count, round(null_ratio, 4) as null_ratio, round(min_value, 4) as min_value,
        round(max_value, 4) as max_value, round(mean, 4) as mean, round(stddev, 4) as stddev, value_count from ({sql})"""


DRIFTED = ("o_totalprice", "o_orderpriority", "o_custkey", "flat")
_OLD = "select o_totalprice, o_orderpriority, o_custkey, 1 as flat from orders"
_NEW = """select case when o_orderkey % 400 = 0 then o_totalprice * 1000 else o_totalprice end as o_totalprice,
    case when o_orderkey % 4 = 0 then null else o_orderpriority end as o_orderpriority, o_custkey,
    case when o_orderkey % 3 = 0 then -1 else 1 end as flat from orders where o_orderkey % 10 < 7"""


def profile_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events between the profile of orders and that of a damaged copy."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    old, new = (profile.profile(spark.sql(sql), "orders", list(DRIFTED)) for sql in (_OLD, _NEW))
    return profile.drift(old, new).select("event_type", "severity", "node_id", "column_name", F.col("metadata")["method"].alias("method"))


DRIFT_SQL = f"""
with old as ({_profile_sql(_OLD, 'orders', DRIFTED)}), new as ({_profile_sql(_NEW, 'orders', DRIFTED)}),
both_ as (select n.*, o.row_count as orows, o.null_ratio as onull, o.min_value as omin, o.mean as omean, o.stddev as osd, o.value_count as ocnt
          from new n join old o using (table_name, column_name))
select 'row_count_drop' as event_type, 'error' as severity, table_name as node_id, cast(null as varchar) as column_name, cast(null as varchar) as method
from both_ group by table_name having max(orows) > 0 and (max(orows) - max(row_count)) / max(orows) > 0.2
union all select 'null_ratio_spike', 'warning', table_name, column_name, null from both_ where null_ratio - onull > 0.1
union all select 'value_range_breach', 'error', table_name, column_name, m from (
    select *, case when ocnt >= 5 and coalesce(osd, 0) > 0 then case when min_value < omean - 3 * osd or max_value > omean + 3 * osd then 'sigma' end
              when omin >= 0 and min_value < 0 then 'sign_flip' end as m from both_) where m is not null"""

#: Two snapshots that differ in every way.
_SNAP_OLD = [("a", "id", "bigint", 1, True), ("a", "price", "string", 2, True), ("a", "roi", "string", 3, True), ("b", "score", "int", 1, True), ("gone", "x", "int", 1, True), ("gone", "y", "int", 2, True)]
_SNAP_NEW = [("a", "id", "bigint", 1, True), ("a", "price", "double", 2, True), ("b", "score", "int", 1, False), ("b", "fresh", "int", 2, True)]


def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events between two schema snapshots that differ in every way (by hand, held by tests)."""
    old, new = (spark.createDataFrame(rows, schema.SNAPSHOT) for rows in (_SNAP_OLD, _SNAP_NEW))
    return schema.schema_changes(old, new).select("event_type", "severity", "node_id", "column_name", "old_value", "new_value")


def _values(rows: list[tuple], names: str) -> str:
    return "(values " + ", ".join("(" + ", ".join(str(v).lower() if isinstance(v, bool) else repr(v) for v in r) + ")" for r in rows) + f") t({names})"


DIFF_SQL = f"""
with o as (select * from {_values(_SNAP_OLD, 't, c, ty, n, nl')}), w as (select * from {_values(_SNAP_NEW, 't, c, ty, n, nl')}),
j as (select coalesce(o.t, w.t) as node_id, coalesce(o.c, w.c) as column_name, o.ty as oty, w.ty as wty, o.nl as onl, w.nl as wnl
      from o full outer join w on o.t = w.t and o.c = w.c)
select 'column_added' as event_type, 'info' as severity, node_id, column_name, cast(null as varchar) as old_value, wty as new_value from j where oty is null
union all select 'column_removed', 'critical', node_id, column_name, oty, null from j where wty is null
union all select 'type_changed', 'error', node_id, column_name, oty, wty from j where oty <> wty
union all select 'nullability_changed', 'warning', node_id, column_name, onl::varchar, wnl::varchar from j where onl <> wnl"""

NOW = "2024-01-30 16:00:00"


def source_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freshness of each event type as a source, at a fixed time; one source never loaded."""
    loads = table(spark, sf_dir, "events").select(F.col("event_type").alias("source_name"), (F.col("ts") - F.expr("interval 4 hours") * F.length("event_type").cast("int")).alias("loaded_at"))
    never = spark.range(1).select(F.lit("never").alias("source_name"), F.lit(None).cast("timestamp_ntz").alias("loaded_at"))
    status = schema.freshness(loads.unionByName(never), F.lit(NOW).cast("timestamp"))
    return schema.freshness_events(status).select("event_type", "severity", F.col("node_id"), F.col("new_value").alias("status"))


FRESH_SQL = f"""
with s as (select event_type as source_name, max(ts - interval 4 hour * length(event_type)) as l from events group by 1 union all select 'never', null),
a as (select source_name, (epoch(timestamp '{NOW}') - epoch(date_trunc('second', l))) / 3600 as age from s)
select 'freshness_violation' as event_type, case when age is null or age > 12 then 'error' else 'warning' end as severity, source_name as node_id,
       case when age is null then 'runtime error' when age > 12 then 'error' else 'warn' end as status from a where age is null or age > 6"""


def test_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the failed star-schema tests."""
    e = schema.test_events(data_tests(spark, sf_dir))
    return e.select("event_type", "severity", "node_id", F.col("metadata")["test_type"].alias("test_type"), F.col("metadata")["failures"].alias("failures"))


def injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left, nulls and negatives after each injection into orders."""
    orders = table(spark, sf_dir, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("string"))
    parts = {"drop_column": inject.drop_column(orders, "o_orderstatus"), "blank": inject.blank(orders, "o_totalprice", 0.3),
             "drop_rows": inject.drop_rows(orders, 0.4), "negate": inject.negate(orders, "o_totalprice")}
    out = None
    for name, df in parts.items():
        row = df.agg(F.lit(name).alias("injection"), F.count("*").alias("n_rows"), F.count_if(F.col("o_totalprice").isNull()).alias("n_null"),
                     F.count_if(F.col("o_totalprice").startswith("-")).alias("n_negative"), F.lit(len(df.columns)).alias("n_columns"))
        out = row if out is None else out.unionByName(row)
    return out


def queries() -> dict:
    return {f.__name__: f for f in (typed_events, keys_and_names, latest_event, data_tests, table_profile, profile_drift, source_freshness,
                                    test_failures, injected)}


def star_tests_sql() -> str:
    return " union all ".join(_test_sql(t) for t in STAR_TESTS)


def failures_sql() -> str:
    return f"""select 'test_failure' as event_type, 'warning' as severity, test_id as node_id, failures::varchar as failures,
        case when split_part(test_id, '.', 3) like 'unique%' then 'unique' when split_part(test_id, '.', 3) like 'not_null%' then 'not_null'
             when split_part(test_id, '.', 3) like 'relationships%' then 'relationships' else 'custom' end as test_type from ({star_tests_sql()}) where status = 'fail'"""


def oracle_sql() -> dict[str, str]:
    return {
        "typed_events": TYPED_SQL, "keys_and_names": KEYS_SQL,
        "latest_event": "select user_id, event_id, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
        "data_tests": star_tests_sql(), "table_profile": _round_profile(_profile_sql("select * from lineitem", "lineitem", PROFILED)), "profile_drift": DRIFT_SQL,
        "source_freshness": FRESH_SQL, "test_failures": failures_sql(),
    }
