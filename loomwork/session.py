"""Session settings and table access."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_SCRATCH: list[list[str]] = []


def build_session(app: str = "loomwork", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, ANSI casts and UTC; ``conf`` keys use _ for the dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder (any store that Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names, which all executors see; in our own folder only where it is unset, in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="loomwork-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        folder = Path(_OWN[0]).as_uri()
    path = f"{folder.rstrip('/')}/loomwork/{label}-{uuid.uuid4().hex}"
    for made in _SCRATCH[-1:]:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write into the shared folder meanwhile are deleted at its end, so write or count results inside.

    Outside of it they stay until whoever owns the folder deletes them: a result may still read them.
    """
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile has its shuffle files removed at its end: the table stands for them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialized(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back."""
    path = shared_path(df.sparkSession, label)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that is never broadcast. Spark judges a table by its compressed files, so ids and pairs of a hundred MB and more would go through the driver."""
    return df.hint("merge")
