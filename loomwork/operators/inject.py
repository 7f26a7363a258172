"""Rewrites that plant anomalies, always in the same rows, and the way back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.columns import col, hash_sampled
from loomwork.sources.records import read_raw, write_raw
from loomwork.sources.versions import Versions


def drop_column(df: DataFrame, column: str) -> DataFrame:
    return df.drop(column)


def blank(df: DataFrame, column: str, share: float) -> DataFrame:
    """Nulls in ``column`` for a hash sample of the rows."""
    return df.withColumn(column, F.when(~hash_sampled(df.columns[0], share), col(column)))


def drop_rows(df: DataFrame, share: float) -> DataFrame:
    return df.filter(~hash_sampled(df.columns[0], share))


def negate(df: DataFrame, column: str, share: float = 0.05) -> DataFrame:
    """A minus sign before the (string) values of a hash sample."""
    return df.withColumn(column, F.when(hash_sampled(df.columns[0], share), F.concat(F.lit("-"), col(column))).otherwise(col(column)))


def in_place(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> int:
    """Rewrite the raw table at ``path`` from itself; the number of the version before, to go back to."""
    before = Versions(spark, path).latest().number
    write_raw(change(read_raw(spark, path)), path)
    return before


def undo(spark: SparkSession, path: str, version: int) -> None:
    """Make an older version of the raw table at ``path`` the newest again; no row is copied."""
    Versions(spark, path).restore(version)


def rollback(source: DataFrame, path: str) -> bool:
    """Replace the damaged raw table at ``path`` by the rows of its source; an empty source leaves it. Whether it wrote."""
    return write_raw(source, path)
