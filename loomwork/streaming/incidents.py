"""Streaming forms of the incident operators, on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from loomwork.functions.columns import incident_key

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sessions(events: DataFrame, minutes: int = 15, late: str = "30 minutes") -> DataFrame:
    """Events per node and session: a gap of more than ``minutes`` closes a session; later events than ``late`` are dropped by the watermark."""
    timed = events.withColumn("detected_at", F.col("detected_at").cast("timestamp")).withWatermark("detected_at", late)
    window = F.session_window("detected_at", f"{minutes} minutes")
    return timed.groupBy("node_id", window.alias("session")).agg(F.count("*").alias("n_events")).select(
        "node_id", F.col("session.start").alias("first_at"), "n_events")


class Suppressor(StatefulProcessor):
    """Events wait in state until the watermark has passed them, and leave in order of (time, id) with their mark.

    What arrives out of order, but not later than the watermark allows, so gives what a batch gives. State
    of an incident is its waiting events and its last time; the latter goes when it can no longer matter.
    """

    def __init__(self, minutes: int) -> None:
        self.window = minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, event_id long", "n long")
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key: tuple[str], rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        times = []
        for row in rows:
            place = (row["micros"], row["event_id"])
            known = self.waiting.getValue(place)
            self.waiting.updateValue(place, (1 if known is None else known[0] + 1,))
            times.append(row["micros"])
        self.handle.registerTimer(-(-min(times) // 1000))
        return iter(())

    def handleExpiredTimer(self, key: tuple[str], timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        passed = 1000 * timerValues.getCurrentWatermarkInMs()
        waiting = {(k[0], k[1]): v[0] for k, v in self.waiting.iterator()}
        held = self.last.get()
        last = None if held is None else held[0]
        for place in sorted(p for p in waiting if p[0] <= passed):
            for _ in range(waiting.pop(place)):
                yield Row(event_id=place[1], incident=key[0], micros=place[0], duplicate=last is not None and place[0] - last < self.window)
                last = place[0]
            self.waiting.removeKey(place)
        if waiting:
            self.handle.registerTimer(-(-min(waiting)[0] // 1000))
        if last is not None and not waiting and passed - last >= self.window:
            self.last.clear()
        elif last is not None:
            self.last.update((last,))
            self.handle.registerTimer(-(-(last + self.window) // 1000))

    def close(self) -> None:
        pass


def suppress(events: DataFrame, minutes: int = 60, late: str = "30 minutes") -> DataFrame:
    """Marks an event whose incident had another less than ``minutes`` before, in the order of event time.

    An event is returned when the watermark (``late`` behind the newest) has passed it; what comes
    later than that is dropped. Events without time or id are left out. Uses ``transformWithState``, which needs the RocksDB state store.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = events.withColumn("detected_at", F.col("detected_at").cast("timestamp")).withWatermark("detected_at", late).filter("detected_at is not null and event_id is not null")
    keyed = timed.select(F.col("event_id").cast("long").alias("event_id"), incident_key("node_id", "event_type", "column_name").alias("incident"), F.unix_micros("detected_at").alias("micros"), "detected_at")
    marked = keyed.groupBy("incident").transformWithState(Suppressor(minutes), "event_id long, incident string, micros long, duplicate boolean", "Append", "EventTime")
    return marked.select("event_id", "incident", F.timestamp_micros("micros").alias("detected_at"), "duplicate")


def every_quarter(stream: DataFrame, checkpoint: str) -> DataStreamWriter:
    """A writer that runs each 15 minutes, the cadence of the monitoring cycle."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime="15 minutes")
