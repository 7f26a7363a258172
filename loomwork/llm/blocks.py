"""Compact column blobs, and the way removal marks meet their documents.

A stage that must shuffle very many small records (a hash per window, a mark per
word) packs them per target bucket into blobs: byte planes of integer columns,
compressed. A shuffle then moves a few rows of dense bytes instead of one row
per record. Buckets are numbered, and their number follows the input's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .ranges import repeated_ids
from .shared import binary_column, cut, fresh, mix64


def to_ipc(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(rows)
    return sink.getvalue().to_pybytes()


def pack(*arrays: np.ndarray) -> bytes:
    """Integer columns of equal length as compressed byte planes, as wide as each range needs."""
    out = [np.uint32(len(arrays[0])).tobytes()]
    for a in arrays:
        bits = a.astype(np.int64, copy=False).view(np.uint64)
        base = bits.min() if len(bits) else np.uint64(0)
        rest = bits - base
        width = (int(rest.max()).bit_length() + 7) // 8 if len(bits) else 0
        planes = rest.view(np.uint8).reshape(-1, 8)[:, :width]
        out += [base.tobytes(), bytes([width]), np.ascontiguousarray(planes.T).tobytes()]
    return zstandard.compress(b"".join(out), 1)


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    """The columns of :func:`pack`, as int64."""
    data = zstandard.decompress(blob)
    n, at, out = int(np.frombuffer(data, np.uint32, 1)[0]), 4, []
    for _ in range(columns):
        base, width = np.frombuffer(data, np.uint64, 1, at)[0], data[at + 8]
        at += 9
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = np.frombuffer(data, np.uint8, width * n, at).reshape(width, n).T
        at += width * n
        out.append((full.view(np.uint64).ravel() + base).view(np.int64))
    return out


def by_bucket(bucket: np.ndarray, *arrays: np.ndarray) -> tuple[list[int], list[bytes]]:
    """One :func:`pack` blob per distinct bucket; order within a bucket stays."""
    if not len(bucket):
        return [], []
    order = np.argsort(bucket, kind="stable")
    names, first = np.unique(bucket[order], return_index=True)
    ends = [*first[1:].tolist(), len(order)]
    blobs = [pack(*(a[order[i:j]] for a in arrays)) for i, j in zip(first.tolist(), ends, strict=True)]
    return names.tolist(), blobs


def doc_bucket(ids: np.ndarray, subs: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(ids.view(np.uint64) ^ mix64(subs.view(np.uint64))) % np.uint64(buckets)).astype(np.int64)


def blob_rows(buckets: list[int], blobs: list[bytes], **more: int) -> pa.RecordBatch:
    fields = [pa.array(buckets, pa.int64()), binary_column(blobs), *(pa.array([v] * len(blobs), pa.int32()) for v in more.values())]
    return pa.record_batch(fields, ["bucket", "blob", *more])


def with_sub(docs: DataFrame) -> DataFrame:
    """``docs`` and one column more, the last: 0, or a hash of the text on rows whose doc_id occurs more than once.

    Rows with one doc_id and different texts can so be told apart, while unique
    doc_ids (the usual case, found with a scan of that column alone) cost nothing.
    Where doc_ids repeat or are missing the rows are written once: a task that runs again then reads
    them in the same order, and deals those without doc_id to the same buckets.
    """
    sub = fresh(docs, "_sub")
    again = repeated_ids(docs)
    if again.isEmpty():
        plain = docs.withColumn(sub, F.lit(0).cast("long"))
        return plain if docs.filter("doc_id is null").isEmpty() else cut(plain, "keyed")
    own = fresh(docs, "_again")
    hashed = F.when(F.col(own).isNotNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    return cut(docs.join(again.toDF(own), F.col("doc_id") == F.col(own), "left").withColumn(own, hashed).withColumnRenamed(own, sub), "keyed")


def apply_marks(
    docs: DataFrame,
    marks: DataFrame,
    buckets: int,
    edit: Callable[[pa.RecordBatch, list[np.ndarray | None]], pa.RecordBatch],
    schema: StructType | str,
) -> DataFrame:
    """Bring each document its marks and edit it.

    ``docs`` has ``doc_id`` and what :func:`with_sub` adds; ``marks`` has
    ``bucket`` and ``blob``, the latter packing (doc_id, sub, mark). Documents go
    to the bucket of (doc_id, sub) as compressed Arrow batches; in each bucket the
    marks sort first, so they are held while its documents stream past. ``edit``
    gets a batch and for each row the ascending distinct marks, or None. Rows
    without doc_id have no marks, and are dealt over all buckets.
    """
    place = docs.columns.index("doc_id")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, subs = batch.column(place), np.asarray(batch.column(batch.num_columns - 1), np.int64)
            spread = np.arange(batch.num_rows) if ids.null_count else None
            bucket = doc_bucket(np.array(ids.fill_null(0), np.int64), subs, buckets)
            if spread is not None:
                bucket = np.where(np.asarray(ids.is_valid().to_pylist(), bool), bucket, spread % buckets)
            order = np.argsort(bucket, kind="stable")
            names, first = np.unique(bucket[order], return_index=True)
            blobs = []
            for i, j in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
                blobs.append(to_ipc(batch.take(pa.array(order[i:j]))))
            yield blob_rows(names.tolist(), blobs, kind=1)

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, index = None, [], None
        for batch in batches:
            for bucket, blob, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != at:
                    at, held, index = bucket, [], None
                if kind == 0:
                    held.append(unpack(blob, 3))
                    continue
                if index is None:
                    index, held = _index(held), []
                with pa.ipc.open_stream(blob) as reader:
                    for rows in reader:
                        yield edit(rows, _look_up(index, rows.column(place), rows.column(rows.num_columns - 1)))

    packed = docs.mapInArrow(send, "bucket long, blob binary, kind int")
    both = marks.select("bucket", "blob", F.lit(0).alias("kind")).unionByName(packed)
    return both.repartitionById(buckets, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "kind").mapInArrow(receive, schema)


def _index(held: list[list[np.ndarray]]) -> tuple[dict[tuple[int, int], int], np.ndarray, np.ndarray]:
    if not held:
        return {}, np.zeros(1, np.int64), np.zeros(0, np.int64)
    doc, sub, mark = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((mark, sub, doc))
    doc, sub, mark = doc[order], sub[order], mark[order]
    fresh = np.r_[True, (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1]) | (mark[1:] != mark[:-1])]
    doc, sub, mark = doc[fresh], sub[fresh], mark[fresh]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1])])
    keys = {k: i for i, k in enumerate(zip(doc[first].tolist(), sub[first].tolist(), strict=True))}
    return keys, np.r_[first, len(doc)], mark


def _look_up(index: tuple[dict[tuple[int, int], int], np.ndarray, np.ndarray], ids: pa.Array, subs: pa.Array) -> list[np.ndarray | None]:
    keys, bounds, mark = index
    places = [keys.get(pair) for pair in zip(ids.to_pylist(), subs.to_pylist(), strict=True)]
    return [None if p is None else mark[bounds[p]: bounds[p + 1]] for p in places]
