"""One monitoring cycle: profile and snapshot, compare with what was stored, replace it, report."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomwork.functions.columns import idempotency_key
from loomwork.operators import checks, events, impact, profile, risk, schema
from loomwork.operators import graph as g
from loomwork.operators.lineage import column_lineage
from loomwork.session import materialized
from loomwork.sources import artifacts
from loomwork.sources.memory import IncidentMemory
from loomwork.sources.stores import PauseFlag
from loomwork.sources.versions import Versions

from .registry import Project

FRAMES = ("columns", "profiles", "events", "reports", "executions")
TIMES_NTZ = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
TIMES = TIMES_NTZ + "XXX"


def to_records(df: DataFrame) -> DataFrame:
    """Each row as one JSON text (``value``); times keep their microseconds, nulls are left out."""
    return df.select(F.to_json(F.struct("*"), {"timestampFormat": TIMES, "timestampNTZFormat": TIMES_NTZ}).alias("value"))


def from_records(records: DataFrame, schema: StructType | str) -> DataFrame:
    """The rows of :func:`to_records`; a field that is missing is null, one that the schema lacks is ignored."""
    return records.select(F.from_json("value", schema, {"timestampFormat": TIMES, "timestampNTZFormat": TIMES_NTZ}).alias("r")).select("r.*")


@dataclass
class State:
    """What one cycle hands to the next."""

    columns: DataFrame | None = None
    profiles: DataFrame | None = None
    status: str = "never"
    events: DataFrame | None = None
    reports: DataFrame | None = None
    executions: DataFrame | None = None
    notes: list[str] = field(default_factory=list)

    def save(self, folder: str, cycle: int) -> None:
        """Store the state as cycle number ``cycle``, all of it in one step: a broken save is as none, and a repeated one replaces it."""
        held = {n: getattr(self, n) for n in FRAMES if getattr(self, n) is not None}
        spark = SparkSession.getActiveSession()
        Versions(spark, folder).replace(held, cycle=cycle, status=self.status, notes=self.notes, frames=sorted(held))

    @staticmethod
    def load(spark: SparkSession, folder: str) -> State:
        """The state that was stored last, or an empty one if none was."""
        store = Versions(spark, folder)
        last = store.latest()
        if not last.number:
            return State()
        frames = {n: store.read(n, last.number) for n in last.facts["frames"]}
        return State(**frames, status=last.facts["status"], notes=list(last.facts["notes"]))


def run_cycle(
    spark: SparkSession, project: Project, raw: dict[str, DataFrame], state: State, flag: PauseFlag | None = None, sources: DataFrame | None = None,
    memory: IncidentMemory | None = None, number: int = 0, at: datetime | None = None, approval: bool = False,
) -> State:
    """Detect on the raw tables, tests and source freshness, then score and decide on actions. Paused projects are left as they are.

    The baseline is replaced every time, so what persists is reported once. Each table is profiled once.
    ``sources`` is the text of a source-freshness document (none: no such events).
    With ``memory`` the events of cycle ``number``, seen ``at`` a time, are looked up in it, counted
    once however often the cycle is run again, and every planned action gets its outcome in ``executions``.
    """
    if flag and flag.paused:
        return State(state.columns, state.profiles, "paused", notes=["paused"])
    frames = project.build(spark, raw)
    columns = schema.snapshot(spark, raw)
    profiles = materialized(_together([profile.profile(df, name) for name, df in raw.items()]), "profiles")
    found = [schema.test_events(checks.run_tests(project, frames))]
    if sources is not None:
        found.append(artifacts.freshness_events(sources))
    named = spark.createDataFrame([(s, project.node_id(s)) for s in project.sources], "node_id string, full_id string")
    if state.columns is not None and state.profiles is not None:
        seen = events.union(schema.schema_changes(state.columns, columns), profile.drift(state.profiles, profiles))
        found.append(seen.join(named, "node_id", "left").withColumn("node_id", F.coalesce("full_id", "node_id")).select(*events.COLUMNS))
    together = materialized(events.union(*found).withColumn("event_id", F.monotonically_increasing_id()), "events")
    graph = g.frames_of(spark, g.node_rows(project), g.edge_rows(project), g.test_rows(project), g.column_rows(project, frames))
    reports = impact.report(spark, graph, column_lineage(spark, project, frames), together)
    if memory is None:
        return State(columns, profiles, "ok", together, reports)
    reports = materialized(reports, "reports")
    executions = materialized(decisions(together, reports, memory, at or datetime.now(UTC), approval), "executions")
    risky = together.join(reports.select("event_id", "risk_level"), "event_id", "left").withColumns({"risk_level": F.coalesce("risk_level", F.lit("low")), "detected_at": F.lit(at or datetime.now(UTC)).cast("timestamp")})
    fresh = memory.record(number, risky)
    return State(columns, profiles, "ok", together, reports, executions, [] if fresh else [f"cycle {number} was recorded before"])


def decisions(found: DataFrame, reports: DataFrame, memory: IncidentMemory, at: datetime, approval: bool = False, minutes: int = 60) -> DataFrame:
    """A row per planned action of each report: its outcome, its order, the key that makes it happen once, and how often the incident was seen before.

    An event is a duplicate if its incident was seen less than ``minutes`` ago, or earlier in this batch.
    """
    timed = memory.prior(found.withColumn("detected_at", F.lit(at).cast("timestamp")), minutes)
    first = timed.groupBy("incident").agg(F.min("event_id").alias("_first"))
    keyed = timed.join(first, "incident").withColumn("duplicate", F.col("duplicate") | (F.col("event_id") > F.col("_first"))).select("event_id", "incident", "duplicate", "occurrences", "detected_at")
    held = F.lit(approval) & F.exists("actions", lambda a: a["type"].isin("github_pr", "pause_dbt_run"))
    fix = F.col("fix_sql") if "fix_sql" in reports.columns else F.lit(None).cast("string")
    rows = reports.join(keyed, "event_id").select("event_id", "incident", "duplicate", "occurrences", "detected_at", held.alias("held"), fix.alias("fix_sql"), F.explode("actions").alias("a"))
    rows = rows.select("*", F.col("a.type").alias("action")).drop("a")
    return risk.execution(rows).select("event_id", "incident", "occurrences", "action", "outcome", "step", idempotency_key("incident", F.to_date("detected_at"), "action").alias("idempotency_key"))


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
