"""Artifacts, snapshots and small state files."""

from __future__ import annotations

import fcntl
import json
import os
import tempfile
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.functions.columns import quote


def artifact(spark: SparkSession, path: str) -> DataFrame:
    """A JSON artifact (manifest, catalog, run results, source freshness) as a frame of one row."""
    return spark.read.option("multiLine", True).json(path)


def save_snapshot(df: DataFrame, path: str, captured_at: str) -> None:
    """Append the rows of one capture; captures are partitions and never change."""
    df.withColumn("captured_at", F.lit(captured_at)).write.mode("append").partitionBy("captured_at").parquet(path)


def latest_snapshot(spark: SparkSession, path: str, back: int = 0) -> DataFrame:
    """The newest capture, or the one ``back`` captures before it. Only its partition is read."""
    rows = spark.read.option("recursiveFileLookup", False).parquet(path).withColumn("captured_at", F.col("captured_at").cast("string"))
    captures = rows.select("captured_at").distinct().orderBy(F.desc("captured_at")).limit(back + 1).collect()
    at = captures[back][0] if len(captures) > back else None
    return rows.filter(F.col("captured_at") == F.lit(at)).drop("captured_at")


def newest_rows(df: DataFrame, *keys: str) -> DataFrame:
    """The newest captured row of each key; of equally new ones the first by its other columns."""
    order = Window.partitionBy(*keys).orderBy(F.desc("captured_at"), *[F.col(quote(c)).cast("string") for c in df.columns if c not in (*keys, "captured_at")])
    return df.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")


def read_json(path: str | Path, default: Any) -> Any:
    """A small state file; missing or damaged ones read as ``default``."""
    try:
        return json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return default


def write_json(path: str | Path, value: Any) -> None:
    """Replace a state file in one step, after its bytes are on disk."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(handle, "w") as out:
        json.dump(value, out)
        out.flush()
        os.fsync(out.fileno())
    os.replace(name, path)


def update_json(path: str | Path, change: Callable[[Any], Any], default: Any) -> Any:
    """Read, change and write a state file under a lock."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.with_suffix(".lock").open("w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        value = change(read_json(path, default))
        write_json(path, value)
    return value


class PauseFlag:
    """A flag file: while it exists, builds are paused and detection is skipped."""

    def __init__(self, path: str | Path) -> None:
        self.path = Path(path)

    def pause(self, reason: str) -> None:
        write_json(self.path, {"reason": reason})

    def resume(self) -> None:
        self.path.unlink(missing_ok=True)

    @property
    def paused(self) -> bool:
        return self.path.exists()
