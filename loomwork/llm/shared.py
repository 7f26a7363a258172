"""Helpers that the training-data operators share.

Lineage is cut by writing a Parquet table into the folder that the session
names in ``spark.checkpoint.dir``; losing an executor then costs only the
tasks that it ran, never an earlier stage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomwork.session import shared_path, shuffles_removed

_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def new_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors see."""
    return shared_path(spark, label)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back (cuts lineage)."""
    path = new_path(df.sparkSession, label)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[made] = path
    return made


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`cut` that nothing reads any more."""
    path = _PATHS.pop(df, None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path made by :func:`new_path`, or what is below it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df``; no job runs for it.

    Local rows and RDDs have no estimate (Catalyst takes 8 EB); then only the leaves that have one count.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(plan.stats().sizeInBytes())
    if size < 1 << 55:
        return size
    leaves = plan.collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 55)


def memory_scale(spark: SparkSession) -> int:
    """How many times a GB an executor has for each of its cores (1 to 8): what tasks hold at a time grows with it."""
    conf = spark.sparkContext.getConf()
    size = conf.get("spark.executor.memory", "1g").lower()
    gb = float(re.sub(r"[a-z]+$", "", size)) * {"k": 2.0**-20, "m": 2.0**-10, "g": 1.0, "t": 2.0**10}.get(size.rstrip("b")[-1:], 2.0**-30)
    return int(min(8, max(1, gb // int(conf.get("spark.executor.cores", "1")))))


def parts_for(df: DataFrame, mb: int = 10) -> int:
    """Shuffle width: the session's, or more where ``df`` holds over ``mb`` MB per partition (times :func:`memory_scale`)."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(width, -(-input_bytes(df) // (mb * memory_scale(df.sparkSession) << 20)))


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, under these names, whatever else ``df`` carries (also names that differ in case alone)."""
    return fixed(df, *names).select(*names)


def fixed(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with its columns ``names`` where they are, and all others that would be taken for one of them renamed.

    Where no column has exactly the name asked for, one that differs in case is it.
    """
    seen, out = set(df.columns), []
    lower = {n.lower(): n for n in names}
    taken: set[str] = set()
    for c in df.columns:
        asked = lower.get(c.lower())
        if asked is not None and (c == asked or asked not in seen) and asked not in taken:
            taken.add(asked)
            out.append(asked)
        else:
            out.append(c if asked is None else fresh(df, c, *out))
    return df if out == df.columns else df.toDF(*out)


def fresh(df: DataFrame, name: str, *more: str) -> str:
    """``name``, with as many underscores after it as make it unlike all columns of ``df`` and ``more``."""
    used = {c.lower() for c in (*df.columns, *more)}
    while name.lower() in used:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller record batches, so that Python objects stay few."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def words_of(text: bytes) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+``: bytes.split() breaks at exactly those six bytes."""
    return text.split()


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the graph with edges a-b: (vertex, smallest vertex of its component)."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a):]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, root):
            return ids, ids[root]
        root = new


def binary_column(values: list[bytes]) -> pa.Array:
    return pa.array(values, type=pa.binary())


def pack_texts(texts: list[bytes]) -> bytes:
    """Lengths and bytes of several texts as one buffer (see :func:`unpack_texts`)."""
    lengths = np.fromiter(map(len, texts), np.uint32, len(texts))
    return np.uint32(len(texts)).tobytes() + lengths.tobytes() + b"".join(texts)


def unpack_texts(blob: bytes) -> list[bytes]:
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    ends = np.frombuffer(blob, np.uint32, n, 4).astype(np.int64).cumsum() + 4 + 4 * n
    begins = [4 + 4 * n, *ends[:-1].tolist()] if n else []
    return [blob[i:j] for i, j in zip(begins, ends.tolist(), strict=True)]

