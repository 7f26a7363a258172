"""Risk scores, levels and the actions that follow, as column expressions over any number of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .events import SCHEMA_CHANGES

#: Weights (they sum to 1), modifiers, thresholds and action priorities.
WEIGHTS = {"coverage": 0.30, "fan_out": 0.25, "distance": 0.25, "materialization": 0.20}
MATERIALIZED = {"view": 1.0, "table": 0.7, "incremental": 0.5}
ANOMALY = {"column_removed": 1.3, "type_changed": 1.1, "test_failure": 1.0, "row_count_drop": 0.9, "value_range_breach": 0.85,
           "null_ratio_spike": 0.8, "freshness_violation": 0.7, "nullability_changed": 0.6, "column_added": 0.3}
SEVERITY = {"info": 0.85, "warning": 0.95, "error": 1.10, "critical": 1.25}
THRESHOLDS = (("critical", 0.85), ("high", 0.60), ("medium", 0.30))
DECAY, BOOST = 0.05, 1.15
PRIORITY = {"log": 0, "slack_alert": 1, "github_pr": 2, "pause_dbt_run": 3}


def looked_up(key: Column, values: dict[str, float], other: float) -> Column:
    return F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in values.items()], F.lit(other))


def base_score(coverage: Column, fan_out: Column, distance: Column, materialized: Column, anomaly: Column) -> Column:
    """Weighted risk of a node, times the anomaly's modifier, at most 1. A null distance (no exposure) adds nothing."""
    near = F.when(distance.isNull(), F.lit(0.0)).otherwise(1.0 / (distance + 1))
    total = ((1.0 - coverage) * WEIGHTS["coverage"] + F.least(fan_out / 10.0, F.lit(1.0)) * WEIGHTS["fan_out"] + near * WEIGHTS["distance"]
             + looked_up(materialized, MATERIALIZED, 0.5) * WEIGHTS["materialization"])
    return F.least(total * looked_up(anomaly, ANOMALY, 1.0), F.lit(1.0))


def in_context(score: Column, severity: Column, confidence: Column, hops: Column, high_priority: Column, decay: float = DECAY) -> Column:
    """The score under severity, path confidence (held to 0 to 1), hops from the anomaly (at least 0) and a high-priority exposure, at most 1."""
    confidence, hops = F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)), F.greatest(hops, F.lit(0))
    boost = F.when(high_priority, BOOST).otherwise(1.0)
    return F.least(score * looked_up(severity, SEVERITY, 1.0) * (0.7 + 0.3 * confidence) / (1.0 + decay * hops) * boost, F.lit(1.0))


def level(score: Column) -> Column:
    return F.coalesce(*[F.when(score >= limit, name) for name, limit in THRESHOLDS], F.lit("low"))


def actions(risk: Column, event_type: Column, pull_requests: bool = True, pause: bool = False, approval: bool = False) -> Column:
    """Planned actions by priority: (type, priority, status). Pull requests only answer schema changes; held ones are pending."""
    worse = {name: [n for n, _ in THRESHOLDS[: i + 1]] for i, (name, _) in enumerate(THRESHOLDS)}

    def action(kind: str, when: Column, held: bool) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("type"), F.lit(PRIORITY[kind]).alias("priority"), F.lit("pending" if held else "planned").alias("status")))

    return F.array_sort(F.array_compact(F.array(
        action("log", F.lit(True), False), action("slack_alert", risk.isin(*worse["medium"]), False),
        action("github_pr", risk.isin(*worse["high"]) & event_type.isin(*SCHEMA_CHANGES) & F.lit(pull_requests), approval),
        action("pause_dbt_run", risk.isin(*worse["critical"]) & F.lit(pause), approval))), _by_priority)


def _by_priority(a: Column, b: Column) -> Column:
    return a["priority"] - b["priority"]


def execution(df: DataFrame) -> DataFrame:
    """Decision table of the executor over rows (action, duplicate, held, fix_sql): adds ``outcome`` and ``step``, the order of execution.

    A duplicate incident silences the pull request and the alert, never the log or
    the pause. Approval holds back the pull request and the pause, never the alert. A pull
    request needs a fix (an empty one is none). Null flags count as false.
    """
    action, fix = F.col("action"), F.coalesce(F.col("fix_sql"), F.lit("")) != ""
    duplicate, held = (F.coalesce(F.col(c), F.lit(False)) for c in ("duplicate", "held"))
    outcome = (F.when(action.isin("github_pr", "slack_alert") & duplicate, "skipped_duplicate").when(action.isin("github_pr", "pause_dbt_run") & held, "pending_approval")
               .when((action == "github_pr") & ~fix, "no_fix_sql").when(action == "pause_dbt_run", "paused").otherwise("executed"))
    order = F.when(action == "log", 0).when(action == "github_pr", 1).when(action == "slack_alert", 2).otherwise(3)
    return df.withColumn("outcome", outcome).withColumn("step", order)
