"""Incident memory as a stored keyed table.

Incidents lie in ``buckets`` folders by the hash of their key. A batch reads and
rewrites the buckets that its events fall in, into new folders, and commits them
in one step with its number: a batch that is run again changes nothing, and a
failure between leaves the memory as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.columns import incident_key
from loomwork.operators import incidents

from .versions import Version, Versions

SCHEMA = """incident string, n long, first_seen timestamp, last_seen timestamp, last_risk string, node_id string, event_type string, column_name string,
    outcomes array<struct<at: timestamp, outcome: string>>"""


class IncidentMemory:
    """What is known of each incident: how often and when it was seen, its last risk, and the outcomes recorded for it."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        """``buckets`` holds when the memory is begun; a begun one keeps its own number."""
        self.spark, self.store = spark, Versions(spark, path)
        self.buckets = int(self.store.latest().facts.get("buckets", buckets))

    def bucket(self, key: str = "incident") -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _of(self, version: Version, buckets: list[int]) -> DataFrame:
        names = [version.tables[n] for n in map(str, buckets) if n in version.tables]
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.store.path}/{n}" for n in names]) if names else self.spark.createDataFrame([], SCHEMA)
        return rows

    def read(self) -> DataFrame:
        """All incidents."""
        version = self.store.latest()
        return self._of(version, sorted(map(int, version.tables)))

    def _merge(self, batch: int, kind: str, fresh: DataFrame) -> bool:
        """Merge rows of ``SCHEMA`` into the buckets they fall in. Outcomes alone (n 0) are kept only for known incidents."""
        version = self.store.latest()
        if batch <= int(version.facts.get(kind, 0)):
            return False
        fresh = fresh.withColumn("bucket", self.bucket())
        touched = sorted(r.bucket for r in fresh.select("bucket").distinct().collect())  # at most as many as there are buckets
        if touched:
            both = self._of(version, touched).withColumn("bucket", self.bucket()).unionByName(fresh)
            newest = F.struct(F.col("last_seen"), incidents.severity_of_risk("last_risk"))
            merged = both.groupBy("bucket", "incident").agg(
                F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
                F.max_by("last_risk", F.when(F.col("last_seen").isNotNull(), newest)).alias("last_risk"), F.min("node_id").alias("node_id"), F.min("event_type").alias("event_type"),
                F.min("column_name").alias("column_name"), F.array_sort(F.flatten(F.collect_list("outcomes"))).alias("outcomes")).filter("n > 0")
            folder = self.store.stage(merged.repartition("bucket"), "bucket")
            own = {name.split("=")[1]: f"{folder}/{name}" for name in self.store.parts(folder)}
            tables = {n: p for n, p in version.tables.items() if int(n) not in touched} | own
        else:
            tables = version.tables
        self.store.commit(version, tables, **(version.facts | {kind: batch, "buckets": self.buckets}))
        return True

    def record(self, batch: int, events: DataFrame) -> bool:
        """Count the ``events`` of batch number ``batch`` (ascending from 1); False, and nothing changes, if it was recorded before."""
        rows = incidents.memory(events).withColumns({"first_seen": F.col("first_seen").cast("timestamp"), "last_seen": F.col("last_seen").cast("timestamp"), "outcomes": F.array().cast("array<struct<at: timestamp, outcome: string>>")})
        return self._merge(batch, "events", rows.select(*[f.name for f in self.spark.createDataFrame([], SCHEMA).schema]))

    def feedback(self, batch: int, outcomes: DataFrame) -> bool:
        """Record ``outcomes(incident, outcome, at)`` of known incidents; unknown keys are ignored, a batch that was recorded before changes nothing."""
        none = {n: F.lit(None).cast(t) for n, t in (("first_seen", "timestamp"), ("last_seen", "timestamp"), ("last_risk", "string"), ("node_id", "string"), ("event_type", "string"), ("column_name", "string"))}
        entry = F.struct(F.col("at").cast("timestamp").alias("at"), F.col("outcome"))
        rows = outcomes.filter("incident is not null").groupBy("incident").agg(F.array_sort(F.collect_list(entry)).alias("outcomes")).withColumn("n", F.lit(0).cast("long")).withColumns(none)
        return self._merge(batch, "outcomes", rows.select(*[f.name for f in self.spark.createDataFrame([], SCHEMA).schema]))

    def prior(self, events: DataFrame, minutes: int = 60) -> DataFrame:
        """``events`` with ``incident``, how often it was seen before (``occurrences``), and whether it is a ``duplicate``: less than ``minutes`` after it was last seen."""
        keyed = events.withColumn("incident", incident_key("node_id", "event_type", "column_name"))
        touched = sorted(r.b for r in keyed.select(self.bucket().alias("b")).distinct().collect())
        known = self._of(self.store.latest(), touched).select("incident", F.col("n").alias("occurrences"), "last_seen")
        gap = F.unix_micros(F.col("detected_at").cast("timestamp")) - F.unix_micros("last_seen")
        return keyed.join(known, "incident", "left").withColumns({"occurrences": F.coalesce("occurrences", F.lit(0)), "duplicate": F.coalesce(gap < minutes * 60_000_000, F.lit(False))}).drop("last_seen")


