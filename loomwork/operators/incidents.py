"""Incident memory: correlation into sessions, duplicate suppression, counts and calibration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from loomwork.functions.columns import incident_key
from loomwork.session import materialized

from .events import severity_rank


def ranged(events: DataFrame, key: str, ranges: int | None = None) -> DataFrame:
    """The events in ranges of (key, detected_at, event_id), numbered by ``_part`` and written, so that a node of very many events is many ranges."""
    count = ranges or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialized(events.repartitionByRange(count, key, "detected_at", "event_id").withColumn("_part", F.spark_partition_id()), "ranged")


def _within(key: str) -> WindowSpec:
    """A key's events of one range, in order: what one task has."""
    return Window.partitionBy(key, "_part").orderBy("detected_at", "event_id")


def _carried(rows: DataFrame, key: str, summary: Column, carry: Callable[[WindowSpec], Column], name: str) -> DataFrame:
    """``rows`` with what the ranges before hold of their key: a ``summary`` of each range (a row a range), carried on by a window over these."""
    parts = rows.groupBy(key, "_part").agg(summary.alias("_sum"))
    found = parts.select(F.col(key).alias("_k"), F.col("_part").alias("_p"), carry(Window.partitionBy(key).orderBy("_part")).alias(name))
    return rows.join(found, rows[key].eqNullSafe(found["_k"]) & (rows["_part"] == found["_p"]), "left").drop("_k", "_p")


def _micros() -> Column:
    return F.unix_micros(F.col("detected_at").cast("timestamp"))


def _gaps(rows: DataFrame, key: str) -> DataFrame:
    """Adds ``_gap``, the microseconds since the key's event before, in this range or an earlier one."""
    rows = _carried(rows, key, F.max(_micros()), lambda w: F.lag("_sum").over(w), "_before")
    first = F.row_number().over(_within(key)) == 1
    before = F.when(first, F.col("_before")).otherwise(F.lag(_micros()).over(_within(key)))
    return rows.withColumn("_gap", _micros() - before).drop("_before")


def correlate(events: DataFrame, minutes: int = 15, ranges: int | None = None) -> DataFrame:
    """Sessions per node: an event at most ``minutes`` after the one before belongs to its session.

    Adds ``session`` (from 1 per node) and ``is_primary``: the most severe event, then the newest, then the largest id.
    Events are scanned in ranges of time; what reaches a range from those before
    is the last time and the number of sessions, so no node has to fit in a task.
    Null times come first and begin sessions; null nodes are one node; repeated rows are numbered in any order.
    """
    rows = _gaps(ranged(events, "node_id", ranges), "node_id")
    starts = F.when(F.col("_gap").isNull() | (F.col("_gap") > minutes * 60_000_000), 1).otherwise(0)
    rows = rows.withColumn("_own", F.sum(starts).over(_within("node_id").rowsBetween(Window.unboundedPreceding, 0)))
    rows = _carried(rows, "node_id", F.max("_own"), lambda w: F.coalesce(F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_past")
    rows = rows.withColumn("session", F.col("_own") + F.col("_past")).drop("_gap", "_own", "_past")
    worth = F.struct(severity_rank(F.col("severity")).alias("rank"), "detected_at", "event_id")
    local = Window.partitionBy("node_id", "_part", "session")
    rows = materialized(rows.withColumn("_worth", worth).withColumn("_nth", F.row_number().over(local.orderBy(F.desc("_worth")))), "sessions")
    best = rows.filter("_nth = 1").withColumn("_best", F.row_number().over(Window.partitionBy("node_id", "session").orderBy(F.desc("_worth"), "_part")) == 1)  # a row a range
    best = best.select(F.col("node_id").alias("_k"), F.col("_part").alias("_p"), F.col("session").alias("_s"), "_best")
    same = rows["node_id"].eqNullSafe(best["_k"]) & (rows["_part"] == best["_p"]) & (rows["session"] == best["_s"])
    return rows.join(best, same, "left").withColumn("is_primary", F.col("_best") & (F.col("_nth") == 1)).drop("_k", "_p", "_s", "_best", "_nth", "_worth", "_part")


def suppress(events: DataFrame, minutes: int = 60, ranges: int | None = None) -> DataFrame:
    """Adds ``incident`` and ``duplicate``: strictly less than ``minutes`` after the incident's last event, suppressed ones included. Scanned in ranges as in :func:`correlate`."""
    keyed = events.withColumn("incident", incident_key("node_id", "event_type", "column_name"))
    rows = _gaps(ranged(keyed, "incident", ranges), "incident")
    return rows.withColumn("duplicate", F.coalesce(F.col("_gap") < minutes * 60_000_000, F.lit(False))).drop("_gap", "_part")


def severity_of_risk(level: str) -> Column:
    """Order of risk levels: what decides between two that were seen at one time."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), F.col(level)), F.lit(0))


def memory(events: DataFrame) -> DataFrame:
    """One row per incident: how often, first and last seen, and the risk it had last."""
    keyed = events.withColumn("incident", incident_key("node_id", "event_type", "column_name"))
    return keyed.groupBy("incident").agg(
        F.count("*").alias("n"), F.min("detected_at").alias("first_seen"), F.max("detected_at").alias("last_seen"),
        F.max_by("risk_level", F.struct("detected_at", "event_id")).alias("last_risk"), F.min("node_id").alias("node_id"), F.min("event_type").alias("event_type"), F.min("column_name").alias("column_name"))


def merge(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The memory after another batch: counts add up, the range widens, the newest risk stays (of equally new ones the higher)."""
    both = stored.unionByName(fresh)
    return both.groupBy("incident").agg(
        F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max_by("last_risk", F.struct("last_seen", severity_of_risk("last_risk"))).alias("last_risk"),
        F.min("node_id").alias("node_id"), F.min("event_type").alias("event_type"), F.min("column_name").alias("column_name"))


def attached(events: DataFrame, minutes: int = 15) -> DataFrame:
    """One row per session: its primary event with all columns, and ``correlated``, the others (type, severity, column) by time and id."""
    rows = correlate(events, minutes)
    others = F.struct("detected_at", "event_id", "event_type", "severity", "column_name")
    found = rows.groupBy("node_id", "session").agg(F.array_sort(F.collect_list(F.when(~F.col("is_primary"), others))).alias("correlated"))
    return rows.filter("is_primary").drop("is_primary").join(found, ["node_id", "session"])


def with_feedback(stored: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcomes(incident, outcome, at) of known incidents, in order of time; unknown keys are ignored."""
    lists = outcomes.groupBy("incident").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "outcome"))), lambda o: o["outcome"]).alias("outcomes"))
    return stored.join(lists, "incident", "left")


def calibration(stored: DataFrame, outcomes: DataFrame, warn_below: float = 0.5) -> DataFrame:
    """Incidents by last risk with the share of actionable feedback (null without any), and whether that share is too low."""
    known = outcomes.join(stored.select("incident", "last_risk"), "incident")
    rates = known.groupBy("last_risk").agg(F.avg((F.col("outcome") == "actionable").cast("int")).alias("actionable_rate"))
    counts = stored.groupBy("last_risk").agg(F.count("*").alias("n_incidents"), F.sum("n").alias("n_events"))
    return counts.join(rates, "last_risk", "left").withColumn("warn", F.coalesce(F.col("actionable_rate") < warn_below, F.lit(False)))


def calibration_total(stored: DataFrame, outcomes: DataFrame, warn_below: float = 0.5) -> DataFrame:
    """One row over all incidents: their number, their events, and the global share of actionable feedback (null without any)."""
    rate = outcomes.join(stored.select("incident"), "incident").agg(F.avg((F.col("outcome") == "actionable").cast("int")).alias("actionable_rate"))
    total = stored.agg(F.count("*").alias("n_incidents"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_events"))
    return total.join(F.broadcast(rate), how="cross").withColumn("warn", F.coalesce(F.col("actionable_rate") < warn_below, F.lit(False)))  # one row each
