"""The row type that all detectors return."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Event types and severities (ascending).
TYPES = ("column_added", "column_removed", "type_changed", "nullability_changed", "row_count_drop", "null_ratio_spike", "value_range_breach", "freshness_violation", "test_failure")
SEVERITIES = ("info", "warning", "error", "critical")
SCHEMA_CHANGES = TYPES[:4]

COLUMNS = ("event_type", "severity", "node_id", "column_name", "old_value", "new_value", "message", "metadata")


def event(df: DataFrame, kind: str | Column, severity: str | Column, node: str, column: str | None = None,
          old: Column | None = None, new: Column | None = None, message: Column | None = None, **metadata: Column) -> DataFrame:
    """Project rows to events; ``metadata`` becomes a string map."""
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    entries = [x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))]
    return df.select(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("event_type"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        F.col(node).alias("node_id"), (F.col(column) if column else F.lit(None).cast("string")).alias("column_name"),
        text(old).alias("old_value"), text(new).alias("new_value"), text(message).alias("message"),
        (F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")).alias("metadata"))


def union(*parts: DataFrame) -> DataFrame:
    """Events of several detectors, checked against the known types and severities."""
    rows = reduce(DataFrame.unionByName, parts)
    known = F.col("event_type").isin(*TYPES) & F.col("severity").isin(*SEVERITIES)
    return rows.withColumn("event_type", F.when(known, F.col("event_type")).otherwise(F.raise_error(F.concat(F.lit("unknown event "), "event_type"))))


def severity_rank(severity: Column) -> Column:
    return F.coalesce(*[F.when(severity == s, i) for i, s in enumerate(SEVERITIES)], F.lit(-1))
