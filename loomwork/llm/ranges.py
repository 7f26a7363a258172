"""Contiguous doc_id ranges, found from the key columns alone."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, input_bytes

LOWEST = -(1 << 63)
MOST = 8192  # ranges: a row of two longs for each reaches the driver and every task
RANGE_BYTES = 16 << 20


def repeated_ids(docs: DataFrame) -> DataFrame:
    """The doc_ids that more than one row has (``_again``), from a scan of that column alone; null is left out."""
    return cut(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
               .select(F.col("doc_id").alias("_again")), "repeated-ids")


def flagged(docs: DataFrame) -> tuple[DataFrame, Column | None]:
    """``docs`` of (doc_id, text), and what says that a row's doc_id is null or repeated (None: of no row)."""
    again = repeated_ids(docs)
    if not again.isEmpty():
        return docs.join(again, docs["doc_id"] == again["_again"], "left"), F.col("_again").isNotNull() | F.col("doc_id").isNull()
    return docs, None if docs.filter("doc_id is null").isEmpty() else F.col("doc_id").isNull()


def range_count(docs: DataFrame) -> int:
    """A range per ``RANGE_BYTES``, at least the session's shuffle width, at most ``MOST``: larger inputs have larger ranges.

    Whoever reads a range lets Spark sort it and streams the rows, so a range's size is bound by disk alone.
    """
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(MOST, max(width, -(-input_bytes(docs) // RANGE_BYTES)))


def range_tops(keyed: DataFrame, ranges: int) -> np.ndarray:
    """The largest (_k, _s) of each of at most ``ranges`` ranges, ascending. Only these two columns are read and sampled."""
    ranged = keyed.select("_k", "_s").repartitionByRange(ranges, "_k", "_s").groupBy(F.spark_partition_id().alias("p"))
    found = ranged.agg(F.max(F.struct("_k", "_s")).alias("top")).collect()
    return np.array(sorted((r["top"]["_k"], r["top"]["_s"]) for r in found), np.int64).reshape(-1, 2)


def range_of(k: np.ndarray, s: np.ndarray, tops: np.ndarray) -> np.ndarray:
    """The range of each key: how many tops lie below it (at most the last range)."""
    at = np.searchsorted(tops[:, 0], k, side="left")
    stop = np.searchsorted(tops[:, 0], k, side="right")
    for i in np.flatnonzero(at < stop).tolist():
        at[i] += np.searchsorted(tops[at[i]: stop[i], 1], s[i], side="left")
    return np.minimum(at, max(len(tops) - 1, 0)).astype(np.int64)
