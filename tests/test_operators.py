"""Detectors, lineage, risk, impact, incidents and streaming on small inputs."""

import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomwork.operators import events, graph, impact, incidents, inject, lineage, profile, risk, schema
from loomwork.plans import graph_queries as q
from loomwork.plans.cycle import State, run_cycle
from loomwork.plans.market import project
from loomwork.sources.memory import IncidentMemory
from loomwork.sources.stores import PauseFlag
from loomwork.streaming import incidents as streams

from .conftest import SF
from .test_market import raw

T0 = datetime(2024, 1, 1, 12)


def line(spark, rows=100, nulls=0.0, low=1.0, high=100.0, mean=50.0, sd=None, count=0):
    return spark.createDataFrame([("t", "c", rows, int(rows * nulls), nulls, low, high, mean, sd, count)], profile.PROFILE)


@pytest.mark.parametrize("old, new, kind", [
    ({}, {"rows": 50}, "row_count_drop"), ({}, {"rows": 80}, None), ({"nulls": 0.05}, {"nulls": 0.40}, "null_ratio_spike"), ({}, {"low": -5.0}, "value_range_breach"),
    ({"mean": 100.0, "sd": 10.0, "count": 100}, {"low": 95.0, "high": 500.0}, "value_range_breach"), ({"mean": 100.0, "sd": 10.0, "count": 4, "low": -1.0}, {"high": 500.0}, None),
])
def test_drift(spark, old, new, kind):
    found = [r.event_type for r in profile.drift(line(spark, **old), line(spark, **new)).collect()]
    assert found == ([kind] if kind else [])


def test_first_run_gives_no_events(spark):
    now = spark.createDataFrame([("a", "x", "int", 1, True)], schema.SNAPSHOT)
    assert schema.schema_changes(now.limit(0), now).count() == 0
    assert profile.drift(line(spark).limit(0), line(spark)).count() == 0


def test_profile_of_an_empty_table_and_of_nan(spark):
    empty = profile.profile(spark.createDataFrame([], "a int"), "e").collect()[0]
    assert (empty.row_count, empty.null_ratio, empty.min_value) == (0, 0.0, None)
    odd = profile.profile(spark.createDataFrame([("NaN",), ("2",), (None,)], "a string"), "o").collect()[0]
    assert (odd.null_count, odd.max_value, odd.value_count) == (1, 2.0, 1)


def test_unknown_event_types_are_refused(spark):
    with pytest.raises(Exception, match="unknown event"):
        events.union(events.event(spark.createDataFrame([("n",)], "n string"), "nonsense", "info", "n")).collect()


def test_lineage_through_cte_union_window_and_aggregate(spark):
    spark.createDataFrame([(1, 2)], "k int, v int").createOrReplaceTempView("base")
    spark.createDataFrame([(1, 2)], "k int, w int").createOrReplaceTempView("other")
    df = spark.sql("""with u as (select k, v from base union all select k, w from other), s as (select k, sum(v) as total from u group by k)
        select s.k, total, row_number() over (order by total) as nth, upper(cast(s.k as string)) as name from s left join base b on b.k = s.k""")
    found = lineage.column_sources(df, {"base", "other"})
    assert found["total"][0] == {("base", "v"), ("other", "w")} and found["total"][1] == 1.0
    assert found["k"][0] == {("base", "k"), ("other", "k")} and found["name"][1] == 0.5 and found["nth"][0] == {("base", "v"), ("other", "w")}
    assert lineage.column_sources(spark.table("base").groupBy("k").agg(F.sum("v").alias("s")), {"base"})["s"] == ({("base", "v")}, 0.8)


def test_market_lineage_resolves(spark):
    frames = q.market_graph(spark, SF)[1]
    assert lineage.resolution_rate(project, frames) >= 0.98
    edges = lineage.column_lineage(spark, project, frames)
    assert {r[0] for r in edges.select("confidence").distinct().collect()} == {1.0, 0.8, 0.5}


def score(spark, **x):
    values = {"cov": 0.0, "fan": 0, "dist": None, "mat": "table", "kind": "type_changed"} | x
    df = spark.createDataFrame([tuple(values.values())], "cov double, fan int, dist int, mat string, kind string")
    return df.select(risk.base_score(*map(F.col, values))).first()[0]


def test_score_goldens(spark):
    assert score(spark, fan=4, dist=1) == pytest.approx(0.7315)
    assert score(spark, fan=50, dist=0, mat="view", kind="column_removed") == 1.0
    assert score(spark, cov=1.0, kind="column_added") < 0.1
    levels = spark.createDataFrame([(0.1,), (0.45,), (0.7,), (0.9,)], "s double").select(risk.level(F.col("s")))
    assert [r[0] for r in levels.collect()] == ["low", "medium", "high", "critical"]
    assert sum(risk.WEIGHTS.values()) == pytest.approx(1)


def test_blast_radius_goldens(spark):
    rows = {r.node.split(".")[-1]: r for r in q.blast_scores(spark, SF).filter("event_id = 1").collect()}
    golden = {"coingecko_coins_markets": 0.754508, "stg_coingecko__coins_markets": 0.835821, "int_token_profiles": 0.930027, "fct_daily_token_metrics": 0.752781, "fct_protocol_health": 0.748531}
    assert {k: r.score for k, r in rows.items()} == pytest.approx(golden, abs=1e-6)
    reports = {r.event_id: r for r in q.reports(spark, SF).collect()}
    assert reports[1].risk_level == "critical" and reports[1].n_pruned == 2 and reports[1].exposures == ["defi_market_slack_bot", "whale_alert_pipeline"]
    assert 4 not in reports and reports[5].n_pruned == 6


def test_trails_stop_at_cycles_and_dangling_edges_go(spark):
    node = lambda i: (i, i, "Model", None, None, None, None, None, None, None)
    g = graph.frames_of(spark, [node("a"), node("b")], [("a", "b", "ref"), ("b", "a", "ref"), ("b", "gone", "ref")], [("t", "a", "c", "unique")], [("a.c", "a", "c", "int")])
    assert g["graph_edges"].count() == 2
    assert [(r.node, r.depth) for r in graph.traverse(g["graph_edges"], spark.createDataFrame([("a",)], "id string")).collect()] == [("b", 1)]
    assert {r.node: r.coverage for r in graph.test_coverage(g).collect()} == {"a": 1.0, "b": 0.0}


def test_parse_check(spark):
    assert impact.valid_sql(spark, "select 1") and not impact.valid_sql(spark, "selekt from") and not impact.valid_sql(spark, None)


def feed(spark, *rows):
    return spark.createDataFrame([(i, n, "type_changed", None, T0 + timedelta(minutes=m), s, "low") for i, (n, m, s) in enumerate(rows)],
                                 "event_id long, node_id string, event_type string, column_name string, detected_at timestamp, severity string, risk_level string")


def test_correlation(spark):
    rows = incidents.correlate(feed(spark, ("n", 0, "warning"), ("n", 2, "critical"), ("n", 1, "error"), ("n", 17, "info"), ("n", 150, "info"))).collect()
    assert {r.event_id: r.session for r in rows} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 2}
    assert {r.event_id for r in rows if r.is_primary} == {1, 4}


def test_suppression_window_slides(spark):
    rows = incidents.suppress(feed(spark, ("n", 0, "info"), ("n", 59, "info"), ("n", 118, "info"), ("n", 178, "info"))).orderBy("event_id").collect()
    assert [r.duplicate for r in rows] == [False, True, True, False]


def one_node(spark, n=3000):
    """Events of one node (and a few of others), some of equal time, with gaps of many lengths."""
    rows = [(i, "hot" if i % 50 else "m", "type_changed", None, T0 + timedelta(seconds=(i * 7919 % n) ** 2 // 40), ("info", "error", "critical")[i % 3], "low") for i in range(n)]
    rows += [(n, None, "type_changed", None, T0, "info", "low"), (n + 1, None, "type_changed", None, None, "info", "low"), (n + 2, "hot", "type_changed", None, None, "info", "low")]
    return spark.createDataFrame(rows, "event_id long, node_id string, event_type string, column_name string, detected_at timestamp, severity string, risk_level string")


def plain_scan(df, window):
    """(session, gap within the window) of each event, one after the other."""
    out, last, number = {}, {}, {}
    rows = sorted(df.collect(), key=lambda r: (r.node_id or "", r.detected_at is not None, r.detected_at or T0, r.event_id))
    for r in rows:
        before = last.get(r.node_id)
        gap = None if before is None or r.detected_at is None else r.detected_at - before
        if gap is None or gap > window:
            number[r.node_id] = number.get(r.node_id, 0) + 1
        out[r.event_id] = (number[r.node_id], gap is not None and gap < window)
        last[r.node_id] = r.detected_at
    return out


def test_a_hot_node_is_scanned_by_many_tasks(spark):
    df = one_node(spark)
    sizes = incidents.ranged(df, "node_id", 16).filter("node_id = 'hot'").groupBy("_part").count().collect()
    assert len(sizes) >= 14 and max(r["count"] for r in sizes) < 600
    expected = plain_scan(df, timedelta(minutes=15))
    rows = incidents.correlate(df, ranges=16).collect()
    assert len(rows) == df.count() and {r.event_id: r.session for r in rows} == {k: v[0] for k, v in expected.items()}
    rank = {"info": 0, "error": 2, "critical": 3}
    best = {}
    for r in rows:
        key, worth = (r.node_id, r.session), (rank[r.severity], r.detected_at is not None, r.detected_at or T0, r.event_id)
        best[key] = max(best.get(key, worth), worth)
    assert {(r.node_id, r.session): r.event_id for r in rows if r.is_primary} == {k: v[3] for k, v in best.items()}
    marks = {r.event_id: r.duplicate for r in incidents.suppress(df, minutes=15, ranges=16).collect()}
    assert marks == {k: v[1] for k, v in expected.items()} and df.columns == incidents.correlate(df).columns[: len(df.columns)]


def test_repeated_rows_have_one_primary(spark):
    df = feed(spark, ("n", 0, "error"), ("n", 1, "info"))
    rows = incidents.correlate(df.union(df)).collect()
    assert len(rows) == 4 and sum(r.is_primary for r in rows) == 1


@pytest.mark.parametrize("order", [(0, 1, 2, 3, 4, 5), (1, 0, 3, 2, 5, 4), (2, 1, 0, 5, 4, 3)])
def test_suppression_stream_equals_batch_in_any_order_of_arrival(spark, tmp_path, order):
    minutes = [("n", 85, "info"), ("n", 100, "info"), ("n", 70, "info"), ("n", 161, "info"), ("m", 150, "info"), ("n", 165, "info")]
    batch = feed(spark, *minutes)
    end = feed(spark, ("z", 5000, "info"), ("z", 9000, "info")).withColumn("event_id", F.col("event_id") + 100)
    (tmp_path / "in").mkdir()
    read = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    name = f"marks{order[0]}"
    run = streams.suppress(read, late="100 minutes").writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/c").start()
    for i in order:
        batch.filter(f"event_id = {i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run.processAllAvailable()
    for i in range(2):
        end.filter(f"event_id = {100 + i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run.processAllAvailable()
    run.stop()
    found = {r.event_id: r.duplicate for r in spark.table(name).collect() if r.event_id < 100}
    assert found == {r.event_id: r.duplicate for r in incidents.suppress(batch).collect()} and len(found) == 6


def test_cycle_reports_each_change_once(spark, tmp_path):
    flag = PauseFlag(tmp_path / "pause.json")
    tables = raw(spark)
    first = run_cycle(spark, project, tables, State(), flag)
    assert [r.event_type for r in first.events.collect()] == ["test_failure"]
    tables["coingecko_exchanges"] = tables["coingecko_exchanges"].withColumn("extra", F.lit("x"))
    second = run_cycle(spark, project, tables, first, flag)
    assert sorted(r.event_type for r in second.events.collect()) == ["column_added", "test_failure"]
    assert sorted(r.event_type for r in run_cycle(spark, project, tables, second, flag).events.collect()) == ["test_failure"]
    flag.pause("by hand")
    assert run_cycle(spark, project, tables, second, flag).status == "paused"


def test_cycle_remembers_incidents(spark, tmp_path):
    """The same failed test in four cycles: reported, silenced within the hour, and reported again; a cycle that is run again counts once."""
    held, tables = IncidentMemory(spark, str(tmp_path / "memory")), raw(spark)
    late = spark.createDataFrame([('{"results": [{"unique_id": "source.market.coingecko.coingecko_exchanges", "status": "error"}]}',)], "value string")
    seen = []
    for number, minutes in ((1, 0), (2, 30), (2, 30), (3, 200)):
        state = run_cycle(spark, project, tables, State(), sources=late, memory=held, number=number, at=T0.replace(tzinfo=UTC) + timedelta(minutes=minutes), approval=True)
        seen.append((sorted(r.event_type for r in state.events.collect()), {(r.action, r.outcome) for r in state.executions.collect() if r.action == "slack_alert"}, state.notes))
    alert = lambda outcome: {("slack_alert", outcome)}
    assert [s[0] for s in seen] == [["freshness_violation", "test_failure"]] * 4
    assert [s[1] for s in seen] == [alert("executed"), alert("skipped_duplicate"), alert("skipped_duplicate"), alert("executed")]
    assert [s[2] for s in seen] == [[], [], ["cycle 2 was recorded before"], []] and {r.n for r in held.read().collect()} == {3}
    keys = [r.idempotency_key for r in state.executions.collect()]
    assert len(set(keys)) == len(keys) and all(k.split(":")[1] == "20240101" for k in keys)


def test_staging_choice_needs_sql(spark):
    nodes = spark.createDataFrame([("a", "staging", None), ("b", "staging", "select 1"), ("c", "staging", ""), ("d", "marts", "select 2")], "unique_id string, layer string, sql string")
    rows = spark.createDataFrame([(1, "a", 0), (1, "b", 2), (1, "d", 1), (2, "c", 1)], "event_id int, node string, hops int")
    assert [tuple(r) for r in impact.staging_to_fix({"graph_nodes": nodes}, rows).collect()] == [(1, "b")]
    assert {tuple(r) for r in impact.staging_to_fix({"graph_nodes": nodes.drop("sql")}, rows).collect()} == {(1, "a"), (2, "c")}


def test_profiles_merge(spark):
    """Merged periods equal the profile of all rows, also where the mean is large against the spread."""
    rows = [(f"2024-{1 + i % 5:02d}" if i % 17 else None, None if i % 11 == 0 else 1e9 + (i * 37 % 101), "x" if i % 3 else str(i)) for i in range(2000)]
    df = spark.createDataFrame(rows, "p string, v double, s string").repartition(3)
    parts = profile.partials(df, "t", F.col("p"), ["v", "s"])
    close = lambda rows: {r.column_name: [None if x is None else pytest.approx(x, rel=1e-9) if isinstance(x, float) else x for x in r] for r in rows.collect()}
    ours, theirs = {r.column_name: list(r) for r in profile.merged(parts).collect()}, close(profile.profile(df.drop("p"), "t"))
    assert ours == theirs
    stored = parts.filter("period is null or period <= '2024-03'")
    more = profile.extended(stored, df.withColumn("v", F.when(F.col("p") <= "2024-03", F.raise_error(F.lit("read again")).cast("double")).otherwise(F.col("v"))), "t", F.col("p"), ["v", "s"])
    assert {r.column_name: list(r) for r in profile.merged(more).collect()} == theirs
    empty = profile.merged(profile.partials(df.limit(0), "t", F.col("p"), ["v"]))
    assert empty.count() == 0


def test_key_tests_meet_in_one_exchange(spark):
    from loomwork.operators import checks
    from loomwork.plans.registry import DataTest, Project

    child = spark.createDataFrame([(1, 5, "7"), (1, None, "x"), (None, 9, "8"), (2, 9, None)], "k int, f long, t string")
    parent = spark.createDataFrame([(5,), (5,), (7,)], "id int")
    tests = [DataTest("unique", "child", "k"), DataTest("unique", "parent", "id"), DataTest("relationships", "child", "f", "parent", "id"), DataTest("relationships", "child", "t", "parent", "id")]
    found = checks.run_tests(Project("p"), {"child": child, "parent": parent}, tests)
    assert {r.test_id: r.failures for r in found.collect()} == {"test.p.unique_child_k": 1, "test.p.unique_parent_id": 1, "test.p.relationships_child_f_parent": 2, "test.p.relationships_child_t_parent": 2}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("hashpartitioning(test#") <= 3  # keys, tests, names


def mixed(h, k):
    k = k * 0xCC9E2D51 & 0xFFFFFFFF
    k = (k << 15 | k >> 17) & 0xFFFFFFFF
    h ^= k * 0x1B873593 & 0xFFFFFFFF
    h = (h << 13 | h >> 19) & 0xFFFFFFFF
    return (h * 5 + 0xE6546B64) & 0xFFFFFFFF


def murmur3_of_long(x):
    h = mixed(mixed(42, x & 0xFFFFFFFF), x >> 32 & 0xFFFFFFFF) ^ 8
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def test_hash_sample_is_murmur3(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    keys = [r[0] for r in orders.select("o_orderkey").collect()]
    left = {r[0] for r in inject.drop_rows(orders, 0.4).select("o_orderkey").collect()}
    assert left == {k for k in keys if abs(murmur3_of_long(k)) % 100 >= 40} and 0 < len(left) < len(keys)


def test_state_survives_a_restart(spark, tmp_path):
    tables, folder = raw(spark), str(tmp_path / "state")
    assert State.load(spark, folder).status == "never"
    first = run_cycle(spark, project, tables, State.load(spark, folder))
    first.save(folder, 1)
    held = State.load(spark, folder)
    assert (held.status, held.notes) == ("ok", []) and held.columns.count() == first.columns.count()
    tables["coingecko_exchanges"] = tables["coingecko_exchanges"].withColumn("extra", F.lit("x"))
    second = run_cycle(spark, project, tables, held)
    assert sorted(r.event_type for r in second.events.collect()) == ["column_added", "test_failure"]
    second.save(folder, 2)
    again = State.load(spark, folder)
    assert {tuple(r) for r in again.reports.select("event_id", "risk_level").collect()} == {tuple(r) for r in second.reports.select("event_id", "risk_level").collect()}


def test_flow_in_a_ladder_of_diamonds(spark):
    """2 ** 7 ways lead to the last column; the flow holds the best of each column, and a long wide way beats a short narrow one."""
    edges = [(f"{i}", "c", f"{i}{s}", "c", 0.9 if s == "a" else 0.5) for i in range(7) for s in "ab"] + [(f"{i}{s}", "c", f"{i + 1}", "c", 0.8) for i in range(7) for s in "ab"]
    edges += [("0", "c", "7", "c", 0.3), ("7", "c", "0", "c", 1.0)]
    df = spark.createDataFrame(edges, lineage.EDGES)
    found = {r.node: (r.confidence, r.hops) for r in graph.column_flow(df, spark.createDataFrame([("0.c",), ("none.c",)], "id string")).collect()}
    assert found == {f"{i}a.c": (0.9 if i == 0 else 0.8, 2 * i + 1) for i in range(7)} | {f"{i}b.c": (0.5, 2 * i + 1) for i in range(7)} | {f"{i}.c": (0.8, 2 * i) for i in range(1, 7)} | {"7.c": (0.8, 1)}
    back = graph.column_flow(df, spark.createDataFrame([("7.c",)], "id string"), backward=True)
    assert tuple(back.filter("node = '0.c'").select("confidence", "hops").first()) == (0.8, 1)
    assert graph.column_flow(df.limit(0), spark.createDataFrame([("0.c",)], "id string")).count() == 0


def test_executor_policy(spark):
    """Every action under every flag, by the reference's rules in words: duplicates silence alert and pull request, approval holds pull request and pause."""
    rows = [(a, d, h, f) for a in risk.PRIORITY for d in (True, False) for h in (True, False) for f in ("select 1", "", None)]
    out = risk.execution(spark.createDataFrame(rows, "action string, duplicate boolean, held boolean, fix_sql string")).collect()
    assert {r.outcome for r in out if r.action == "log"} == {"executed"}
    assert {(r.duplicate, r.outcome) for r in out if r.action == "slack_alert"} == {(True, "skipped_duplicate"), (False, "executed")}
    assert {(r.held, r.outcome) for r in out if r.action == "pause_dbt_run"} == {(True, "pending_approval"), (False, "paused")}
    pulls = {(r.duplicate, r.held, bool(r.fix_sql)): r.outcome for r in out if r.action == "github_pr"}
    assert pulls == {(d, h, f): "skipped_duplicate" if d else "pending_approval" if h else "executed" if f else "no_fix_sql" for d in (True, False) for h in (True, False) for f in (True, False)}
    assert len(out) == len(rows) and risk.execution(spark.createDataFrame([("slack_alert", None, None, None)], "action string, duplicate boolean, held boolean, fix_sql string")).first().outcome == "executed"


def test_reachable_in_a_ladder_of_diamonds(spark):
    """2 ** 7 trails lead to the last node; a frontier sees each node once."""
    edges = [(f"{i}", f"{i}{s}", "ref") for i in range(7) for s in "ab"] + [(f"{i}{s}", f"{i + 1}", "ref") for i in range(7) for s in "ab"] + [("7", "0", "ref")]
    df = spark.createDataFrame(edges, graph.EDGES)
    found = {r.node: r.depth for r in graph.reachable(df, spark.createDataFrame([("0",)], "id string")).collect()}
    assert found == {f"{i}{s}": 2 * i + 1 for i in range(7) for s in "ab"} | {str(i): 2 * i for i in range(1, 8)}
    back = graph.reachable(df, spark.createDataFrame([("7",)], "id string"), upstream=True)
    assert back.filter("node = '0'").first().depth == 14


def test_payload_holds_the_summary(spark):
    rows = q.reports(spark, SF)
    texts = {r.event_id: json.loads(r.payload) for r in impact.payload(rows, q._events(spark)).collect()}
    one = texts[1]
    assert one["event"] == {"event_type": "column_removed", "severity": "critical", "node_id": q.START, "column_name": "current_price"}
    assert (one["affected"], one["pruned"], one["risk_level"], one["actions"]) == (5, 2, "critical", ["log", "slack_alert", "github_pr"])
    assert {e["exposure"]: (e["priority"], e["depth"]) for e in one["exposures"]} == {"defi_market_slack_bot": ("high", 4), "whale_alert_pipeline": ("medium", 4)}
    assert len(one["top_risk_nodes"]) == 5 and all(g["coverage"] < 0.5 for g in one["coverage_gaps"]) and 4 not in texts


def test_drafts_that_do_not_parse_drop_the_pull_request(spark):
    rows = q.reports(spark, SF).filter("event_id = 1")
    for sql, left in (("select 1", True), ("selekt from", False)):
        out = impact.with_fixes(spark, rows, spark.createDataFrame([(1, sql)], "event_id int, fix_sql string")).first()
        assert ("github_pr" in [a["type"] for a in out.actions]) is left and (out.fix_sql == sql) is left
    none = impact.with_fixes(spark, rows, spark.createDataFrame([], "event_id int, fix_sql string")).first()
    assert "github_pr" not in [a["type"] for a in none.actions] and none.model_id == "model.market.stg_coingecko__coins_markets"


def test_newest_risk_of_equal_times_is_the_higher(spark):
    row = lambda risk: ("k", 1, T0, T0, risk, "n", "t", None)
    schema_ = "incident string, n long, first_seen timestamp, last_seen timestamp, last_risk string, node_id string, event_type string, column_name string"
    for pair in (("low", "high"), ("high", "low")):
        one, two = (spark.createDataFrame([row(r)], schema_) for r in pair)
        assert incidents.merge(one, two).first().last_risk == "high"


def test_session_stream_agrees_with_batch(spark, tmp_path):
    batch = feed(spark, ("n", 0, "warning"), ("n", 2, "critical"), ("n", 16, "info"), ("n", 150, "info"), ("m", 1, "error"), ("m", 400, "info"))
    batch.write.parquet(f"{tmp_path}/in")
    late = feed(spark, ("z", 5000, "info"))
    read = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 100).parquet(f"{tmp_path}/in")
    run = streams.sessions(read).writeStream.format("memory").queryName("found").option("checkpointLocation", f"{tmp_path}/c").start()
    run.processAllAvailable()
    for i in range(2):  # later events move the watermark past the sessions
        late.withColumn("detected_at", F.col("detected_at") + F.expr(f"interval {i} day")).write.mode("append").parquet(f"{tmp_path}/in")
        run.processAllAvailable()
    run.stop()
    ours = sorted(r.n_events for r in spark.table("found").filter("node_id <> 'z'").collect())
    theirs = sorted(r["count"] for r in incidents.correlate(batch).groupBy("node_id", "session").count().collect())
    assert ours == theirs
