"""Data tests as counts of violating rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.columns import col
from loomwork.plans.registry import DataTest, Project


def violations(df: DataFrame, test: DataTest, parent: DataFrame | None = None) -> DataFrame:
    """The rows (or keys) that break the test."""
    key = col(test.column)
    if test.kind == "unique":
        return df.filter(key.isNotNull()).groupBy(key.alias(test.column)).count().filter("count > 1")
    if test.kind == "not_null":
        return df.filter(key.isNull())
    if test.kind == "relationships":
        keys = parent.select(col(test.parent_column).alias("_parent")).distinct()
        return df.filter(key.isNotNull()).join(keys, key == F.col("_parent"), "left_anti")
    return df.filter(F.expr(test.failing))


def run_tests(project: Project, frames: dict[str, DataFrame], tests: list[DataTest] | None = None) -> DataFrame:
    """``test_id``, ``status`` (pass or fail) and ``failures`` of each test.

    All not-null and custom tests of a model are counted in one pass over it.
    The keys of all unique and relationship tests of all models, children and parents, meet in
    one exchange by (test, key), combined before it, so a hot key is a row a task.
    """
    tests = project.tests if tests is None else tests
    rows, counted, keyed = [], {}, []
    for test in tests:
        if test.kind in ("not_null", "custom"):
            counted.setdefault(test.model, []).append(test)
        else:
            keyed.append(test)
    if keyed:
        rows.append(key_failures(project, frames, keyed))
    for model, own in counted.items():
        broken = [F.count_if(col(t.column).isNull() if t.kind == "not_null" else F.expr(t.failing)) for t in own]
        names = F.array(*[F.lit(test_id(project, t)) for t in own])
        counts = frames[model].agg(F.array(*broken).alias("n"))
        rows.append(counts.select(F.explode(F.arrays_zip(names.alias("test_id"), F.col("n").alias("failures"))).alias("t")).select("t.test_id", "t.failures"))
    status = F.when(F.col("failures") > 0, "fail").otherwise("pass")
    return reduce(DataFrame.unionByName, rows).select("test_id", status.alias("status"), "failures")


def key_failures(project: Project, frames: dict[str, DataFrame], tests: list[DataTest]) -> DataFrame:
    """``test_id`` and ``failures`` of unique tests (keys with several rows) and relationship tests (rows whose key no parent has); null keys count for none.

    Every model is read once for its keys as a child and once as a parent. A child's key is compared in its parent's type.
    """
    sides: dict[tuple[str, int], list[Column]] = {}
    for number, test in enumerate(tests):
        key = col(test.column)
        if test.kind == "relationships":
            kind = frames[test.parent].schema[test.parent_column].dataType
            key = key.try_cast(kind) if kind != frames[test.model].schema[test.column].dataType else key
            sides.setdefault((test.parent, 1), []).append(F.struct(F.lit(number).alias("test"), col(test.parent_column).cast("string").alias("key"), F.lit(False).alias("lost")))
        lost = col(test.column).isNotNull() & key.isNull()  # no value of the parent's type: no parent has it
        sides.setdefault((test.model, 0), []).append(F.struct(F.lit(number).alias("test"), key.cast("string").alias("key"), lost.alias("lost")))
    parts = [frames[model].select(F.explode(F.array(*own)).alias("k")).select("k.*", F.lit(1 - parent).alias("child"), F.lit(parent).alias("parent")).filter("key is not null or lost") for (model, parent), own in sides.items()]
    met = reduce(DataFrame.unionByName, parts).groupBy("test", "key").agg(F.sum("child").alias("children"), F.max("parent").alias("parents"))
    unique = [n for n, t in enumerate(tests) if t.kind == "unique"]
    bad = F.when(F.col("test").isin(*unique), (F.col("children") > 1).cast("int")).otherwise(F.when(F.col("parents") == 0, F.col("children")).otherwise(0)) if unique else F.when(F.col("parents") == 0, F.col("children")).otherwise(0)
    found = met.groupBy("test").agg(F.sum(bad).alias("failures"))
    names = met.sparkSession.createDataFrame([(n, test_id(project, t)) for n, t in enumerate(tests)], "test int, test_id string")
    return names.join(found, "test", "left").select("test_id", F.coalesce("failures", F.lit(0)).cast("long").alias("failures"))


def test_id(project: Project, test: DataTest) -> str:
    return f"test.{project.name}.{test.name}"


test_id.__test__ = False  # a name, not a test
