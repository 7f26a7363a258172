"""Schema snapshots, their differences, freshness and test failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.columns import test_kind

from .events import event, union

SNAPSHOT = "table_name string, column_name string, data_type string, ordinal int, nullable boolean"


def snapshot(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """The columns of ``frames`` by table and ordinal; reads schemas, no rows."""
    rows = [(name, f.name, f.dataType.simpleString(), i, f.nullable) for name, df in sorted(frames.items()) for i, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(rows, SNAPSHOT).orderBy("table_name", "ordinal")


def schema_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Events for columns added, removed, retyped, or of other nullability. An empty previous snapshot gives none."""
    keys = ["table_name", "column_name"]
    old = previous.select(*keys, F.col("data_type").alias("old_type"), F.col("nullable").alias("old_null"), F.lit(True).alias("was"))
    new = current.select(*keys, F.col("data_type").alias("new_type"), F.col("nullable").alias("new_null"), F.lit(True).alias("is"))
    first_run = previous.groupBy().agg(F.count("*").alias("baseline"))
    both = old.join(new, keys, "full_outer").crossJoin(F.broadcast(first_run)).filter("baseline > 0")  # one row
    kept = both.filter("was and is")
    named = ("table_name", "column_name")
    return union(
        event(both.filter("was is null"), "column_added", "info", *named, None, F.col("new_type")),
        event(both.filter("is is null"), "column_removed", "critical", *named, F.col("old_type"), None),
        event(kept.filter("old_type <> new_type"), "type_changed", "error", *named, F.col("old_type"), F.col("new_type")),
        event(kept.filter("old_null <> new_null"), "nullability_changed", "warning", *named, F.col("old_null"), F.col("new_null")),
    )


def freshness(loads: DataFrame, now: Column, warn_hours: float = 6, error_hours: float = 12) -> DataFrame:
    """Status of each source in ``loads(source_name, loaded_at)`` at ``now``: pass, warn, error, or runtime error if it never loaded."""
    newest = loads.groupBy("source_name").agg(F.max("loaded_at").alias("loaded_at"))
    age = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("loaded_at").cast("timestamp"))) / 3600
    status = F.when(age.isNull(), "runtime error").when(age > error_hours, "error").when(age > warn_hours, "warn").otherwise("pass")
    return newest.select("source_name", "loaded_at", age.alias("age_hours"), status.alias("status"))


def freshness_events(status: DataFrame) -> DataFrame:
    severity = F.when(F.col("status") == "warn", "warning").when(F.col("status").isin("error", "runtime error"), "error")
    return event(status.filter(severity.isNotNull()), "freshness_violation", severity, "source_name", None, None, F.col("status"), age_hours=F.col("age_hours"))


def test_events(results: DataFrame) -> DataFrame:
    """Events of ``results(test_id, status, failures)``: a failed test warns, a broken one is an error."""
    severity = F.when(F.col("status") == "fail", "warning").when(F.col("status") == "error", "error")
    return event(results.filter(severity.isNotNull()), "test_failure", severity, "test_id", None, None, F.col("status"),
                 test_type=test_kind("test_id"), failures=F.col("failures"))


def run_summary(results: DataFrame) -> DataFrame:
    """Counts of a build's results(kind, unique_id, status), and the ids that failed."""
    bad = F.col("status").isin("fail", "error")
    return results.agg(
        F.count_if((F.col("kind") == "model") & (F.col("status") == "success")).alias("models_success"),
        F.count_if((F.col("kind") == "test") & (F.col("status") == "pass")).alias("tests_passed"),
        F.count_if(bad).alias("n_failed"), F.array_sort(F.collect_list(F.when(bad, F.col("unique_id")))).alias("failed"))
