"""Records, raw tables and state files."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomwork.functions.columns import quote
from loomwork.operators import graph, inject
from loomwork.plans import operation_queries
from loomwork.sources import artifacts, records, stores
from loomwork.sources.memory import IncidentMemory
from loomwork.sources.versions import Conflict, Versions


def test_values_become_text():
    assert [records.as_text(v) for v in (None, True, {"a": [1, None]}, 1.5, "x")] == [None, "true", '{"a":[1,null]}', "1.5", "x"]
    assert records.key_union([{"b": 1}, {"a": 1, "b": 2}]) == ["b", "a"]
    assert quote("a`b") == "`a``b`"


def test_envelopes():
    assert records.decoded({"result": [{"h": 1}]}) == [{"h": 1}]
    assert records.decoded({"message": "No transactions found", "result": None}) == []
    with pytest.raises(ValueError, match="rate limit"):
        records.decoded({"message": "NOTOK", "result": "rate limit"})


def test_one_retry_after_too_many_requests():
    calls = []

    def opener(url, parameters):
        calls.append(url)
        if len(calls) == 1:
            raise records.TooManyRequests
        if url.endswith("/gone"):
            raise records.NotAvailable
        return {"id": url}

    assert records.patient(opener, "u", {}, sleep=calls.append) == {"id": "u"} and calls == ["u", 30.0, "u"]
    assert records.each(opener, "c", ["a", "gone"]) == [{"id": "c/a"}]
    assert records.first(lambda *_: {"data": [1, 2, 3]}, "u", 2, under="data") == [1, 2]
    assert records.newest(lambda *_: {"result": [7]}, "u", "address", ["a", "b"]) == [7, 7]


def test_empty_fetch_keeps_the_table_and_failures_write_nothing(spark, tmp_path):
    folder = str(tmp_path)
    assert records.seed(spark, {"t": lambda: [{"a": 1}, {"b": [2]}]}, folder) == {"tables_synced": ["t"], "rows": 2}
    assert records.seed(spark, {"t": lambda: []}, folder) == {"tables_synced": [], "rows": 0}

    def broken():
        raise OSError

    with pytest.raises(OSError):
        records.seed(spark, {"t": lambda: [{"a": 5}], "u": broken}, folder)
    table = records.read_raw(spark, f"{folder}/t")
    assert sorted(table.dtypes) == [("_extracted_at", "string"), ("a", "string"), ("b", "string")] and table.filter("b = '[2]'").count() == 1
    text, full = records.probe({"t": table, "none": table.limit(0)})
    assert "| t | 2 |" in text and not full


def test_union_and_stringify(spark):
    a, b = spark.createDataFrame([(1, [1])], "x int, l array<int>"), spark.createDataFrame([("z",)], "y string")
    assert records.united([records.stringified(a), b]).orderBy("x").collect()[1].asDict() == {"x": "1", "l": "[1]", "y": None}


def test_snapshots(spark, tmp_path):
    path = f"{tmp_path}/s"
    for at, v in (("20240101T000000", 1), ("20240102T000000", 2)):
        stores.save_snapshot(spark.createDataFrame([("k", v)], "k string, v int"), path, at)
    assert stores.latest_snapshot(spark, path).first().v == 2 and stores.latest_snapshot(spark, path, back=1).first().v == 1
    assert stores.newest_rows(spark.read.parquet(path), "k").first().v == 2


def test_state_files(spark, tmp_path):
    path = tmp_path / "d" / "state.json"
    assert stores.read_json(path, []) == []
    assert stores.update_json(path, lambda v: [*v, 1], []) == [1] and stores.update_json(path, lambda v: [*v, 2], []) == [1, 2]
    assert stores.artifact(spark, str(path)).count() >= 1
    path.write_text("{damaged")
    assert stores.read_json(path, "default") == "default"


def test_samples_are_kept_once_all_are_fetched(tmp_path):
    rows = [{"id": i, "n": {"x": None}} for i in range(9)]
    assert records.save_samples({"a": lambda: rows, "b": lambda: rows[:2]}, str(tmp_path / "s"), {"a": 3}) == {"a": 3, "b": 2}
    assert json.loads((tmp_path / "s" / "a.json").read_text()) == rows[:3]

    def broken():
        raise records.NotAvailable

    with pytest.raises(records.NotAvailable):
        records.save_samples({"a": lambda: rows, "c": broken}, str(tmp_path / "t"), {})
    assert not (tmp_path / "t").exists()


def test_artifacts_are_read_from_files(spark, tmp_path):
    (tmp_path / "m.json").write_text(operation_queries.MANIFEST)
    (tmp_path / "c.json").write_text("{}")
    tables = artifacts.graph_tables(artifacts.document(spark, f"{tmp_path}/m.json"), artifacts.document(spark, f"{tmp_path}/c.json"))
    assert tables["graph_nodes"].count() == 7 and tables["graph_nodes"].filter("row_count is not null").isEmpty()
    assert {r.data_type for r in tables["graph_columns"].filter("column_name = 'order_id'").collect()} == {"string"}
    empty = spark.createDataFrame([("{}",)], "value string")
    assert all(df.isEmpty() for df in artifacts.graph_tables(empty, empty).values())
    models = graph.dependent_models(tables, spark.createDataFrame([("seed.shop.codes",)], "id string"))
    assert {r.node: r.depth for r in models.collect()} == {"model.shop.stg_orders": 1, "model.shop.fct_sales": 2, "snapshot.shop.old_orders": 2}


def test_rollback_restores_the_source(spark, tmp_path):
    path, source = str(tmp_path / "raw"), spark.createDataFrame([(str(i), str(i * 2)) for i in range(40)], "id string, v string")
    assert records.write_raw(inject.negate(inject.drop_rows(source, 0.4), "v", 0.5), path)
    assert records.read_raw(spark, path).count() < 40 and not inject.rollback(source.limit(0), path)
    assert inject.rollback(source, path)
    assert {tuple(r) for r in records.read_raw(spark, path).collect()} == {tuple(r) for r in source.collect()}


def test_injection_in_place_and_undo(spark, tmp_path):
    path, source = str(tmp_path / "raw"), spark.createDataFrame([(str(i), str(i * 2)) for i in range(200)], "id string, v string").repartition(4)
    records.write_raw(source, path)
    before = inject.in_place(spark, path, lambda df: inject.drop_rows(df, 0.1))
    again = inject.in_place(spark, path, lambda df: inject.blank(df, "v", 0.4))
    rows = records.read_raw(spark, path)
    assert before == 1 and again == 2 and rows.count() == inject.drop_rows(source, 0.1).count() and rows.filter("v is null").count() > 0
    inject.undo(spark, path, before)
    assert {tuple(r) for r in records.read_raw(spark, path).collect()} == {tuple(r) for r in source.collect()} and records.read_raw(spark, path, 2).filter("v is null").isEmpty()


def test_a_failure_before_the_commit_leaves_the_old_version(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "t"))
    assert store.latest().number == 0 and store.vacuum() == 0
    one, two = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "x int")
    store.replace({"a": one, "b": one}, note="first")
    with pytest.raises(Exception, match="no such luck"):  # b fails after a was staged
        store.replace({"a": two, "b": two.withColumn("x", F.when(F.col("x") > 0, F.raise_error(F.lit("no such luck"))).cast("int"))})
    assert store.latest().number == 1 and [store.read(n).first().x for n in "ab"] == [1, 1]
    base = store.latest()
    store.replace({"a": two})
    assert [store.read(n).first().x for n in "ab"] == [2, 1] and store.read("a", 1).first().x == 1 and store.latest().facts == {"note": "first"}
    with pytest.raises(Conflict):  # a second writer that began with version 1
        store.commit(base, {"a": store.stage(one)})
    (tmp_path / "t" / "log" / "000000000009.json").write_text('{"tab')  # a writer that died in its commit
    assert store.latest().number == 2 and store.restore(1).number == 10 and store.read("a").first().x == 1
    with pytest.raises(KeyError):
        store.get(7)
    assert store.vacuum(keep=1) >= 3 and store.read("b").first().x == 1  # a write that failed may leave its folder


def test_memory_is_merged_by_bucket_and_once(spark, tmp_path):
    path = str(tmp_path / "m")
    held = IncidentMemory(spark, path, buckets=16)
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    batch = lambda *rows: spark.createDataFrame([(i, n, "type_changed", None, at(m), r) for i, n, m, r in rows], "event_id long, node_id string, event_type string, column_name string, detected_at timestamp, risk_level string")
    first = batch(*[(i, f"n{i % 30}", i, "low") for i in range(90)])
    assert held.record(1, first) and not held.record(1, first)
    folders = held.store.latest().tables
    second = batch((100, "n3", 200, "high"), (101, "n3", 190, "low"), (102, "new", 200, "critical"))
    assert held.prior(second).orderBy("event_id").select("occurrences", "duplicate").collect() == [(3, False), (3, False), (0, False)]
    assert held.record(2, second) and not held.record(1, first)
    changed = {b for b, p in held.store.latest().tables.items() if folders.get(b) != p}
    assert 1 <= len(changed) <= 2 and set(folders) <= set(held.store.latest().tables)
    rows = {r.node_id: r for r in held.read().collect()}
    assert len(rows) == 31 and (rows["n3"].n, rows["n3"].last_risk, rows["n3"].last_seen, rows["n3"].first_seen) == (5, "high", at(200), at(3)) and rows["new"].n == 1
    assert held.prior(batch((1, "n3", 259, "low"), (2, "n3", 260, "low"))).orderBy("event_id").select("duplicate").collect() == [(True,), (False,)]
    outcome = spark.createDataFrame([(rows["n3"].incident, "noise", at(5)), (rows["n3"].incident, "actionable", at(4)), ("unknown", "noise", at(1))], "incident string, outcome string, at timestamp")
    assert held.feedback(1, outcome) and not held.feedback(1, outcome)
    again = IncidentMemory(spark, path)
    found = {r.node_id: r for r in again.read().collect()}
    assert again.buckets == 16 and len(found) == 31 and [o.outcome for o in found["n3"].outcomes] == ["actionable", "noise"] and found["n3"].n == 5 and found["n3"].last_risk == "high"
    assert again.record(3, first.limit(0)) and again.read().count() == 31


def test_freshness_document(spark):
    body = {"results": [{"unique_id": "source.a", "status": "Pass", "max_loaded_at": "2024"}, {"unique_id": "source.b", "status": "WARN", "max_loaded_at": "2023", "criteria": {"warn_after": {"count": 6}}},
                        {"unique_id": "source.c", "status": "error", "snapshotted_at": "now"}, {"unique_id": "source.d", "status": "runtime error"}, {"status": None}]}
    text = spark.createDataFrame([(json.dumps(body),)], "value string")
    rows = {r.node_id: r for r in artifacts.freshness_events(text).collect()}
    assert {n: r.severity for n, r in rows.items()} == {"source.b": "warning", "source.c": "error", "source.d": "error"}
    assert rows["source.b"].new_value == "2023" and json.loads(rows["source.b"].metadata["criteria"]) == {"warn_after": {"count": 6}} and rows["source.c"].metadata["snapshotted_at"] == "now"
    assert artifacts.freshness_events(spark.createDataFrame([("{}",)], "value string")).isEmpty()


def test_scratch_tables_go_at_the_end(spark):
    from loomwork.session import materialized, scratch

    kept = materialized(spark.range(3), "kept")
    with scratch(spark):
        df = materialized(spark.range(5), "gone")
        path = df.inputFiles()[0].rsplit("/", 1)[0]
        with scratch(spark):
            materialized(spark.range(2), "inner")
        assert df.count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path).count()
    assert kept.count() == 3
