"""Best-fit packing planned on the histogram of piece lengths.

Documents are encoded and cut into pieces of at most ``capacity`` tokens. Only
the histogram of piece lengths (at most ``capacity`` counts) reaches the
driver. There, best-fit decreasing runs over counts: all pieces of one length
are placed at once, into groups of sequences with equal room. The plan is a
list of slot ranges, and each piece finds its slot by its rank among the pieces
of its length. Ranks come from per-task counts, so no length, however frequent,
has to pass through one task.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoder import encoder, give_back, text_batches
from .shared import columns, cut

BATCH_BYTES = 6 << 20  # of text encoded at a time: ids and marks of its words take many times as much
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece; ``nth`` counts pieces of one length within the task ``part``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what an earlier stage's tasks left
        library, part, seen = encoder(vocabulary), TaskContext.get().partitionId(), defaultdict(int)

        def rows_of(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            ids, bounds = library.encode(batch.column(1), end_id)
            view = memoryview(ids).cast("B")
            for doc, begin, end in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                total, start = end - begin, 0
                for k in range(-(-total // capacity)):
                    size = (total - 1) % capacity + 1 if k == 0 else capacity
                    at = 4 * (begin + start)
                    rows.append((doc, k, start, size, zlib.crc32(view[at: at + 4 * size]), part, seen[size]))
                    seen[size] += 1
                    start += size
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = [c.split()[0] for c in PIECES.split(", ")]
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in text_batches(batches, 1, BATCH_BYTES):
            yield rows_of(batch)
            give_back()

    return columns(docs, "doc_id", "text").mapInArrow(run, PIECES)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Returns slot ranges (length, first rank, count, first sequence, offset, per
    sequence): rank r of a range goes to sequence first + (r - first rank) // per,
    at offset + (r - first rank) % per * length. Sequences are filled without gaps.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> (first sequence, how many)
    rooms: list[int] = []  # the rooms with open sequences, ascending
    slots, opened = [], 0

    def leave(left: int, first: int, count: int) -> None:
        if left and count:
            if not room[left]:
                bisect.insort(rooms, left)
            room[left].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                break
            left = rooms[at]
            first, count = room[left].pop()
            if not room[left]:
                rooms.pop(at)
            fit = left // length  # best fit goes on filling the sequence it has just filled most
            full, rest = divmod(todo, fit)
            used = min(count, full)
            if used:
                slots.append((length, rank, used * fit, first, capacity - left, fit))
                leave(left - fit * length, first, used)
                rank, todo = rank + used * fit, todo - used * fit
            if used < count and todo:
                slots.append((length, rank, rest, first + used, capacity - left, rest))
                leave(left - rest * length, first + used, 1)
                leave(left, first + used + 1, count - used - 1)
                todo = 0
            elif used < count:
                leave(left, first + used, count - used)
        if todo:
            fit = capacity // length
            full, rest = divmod(todo, fit)
            if full:
                slots.append((length, rank, full * fit, opened, 0, fit))
                leave(capacity - fit * length, opened, full)
                rank, opened = rank + full * fit, opened + full
            if rest:
                slots.append((length, rank, rest, opened, 0, rest))
                leave(capacity - rest * length, opened, 1)
                opened += 1
    return slots


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    A document's ids end with ``end_id``. Longer ones are cut into pieces of
    ``capacity`` tokens, of which the first may be shorter. Returns ``doc_id``,
    ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``;
    the pieces of a sequence lie one after the other from offset 0.

    Null and empty texts are one piece that holds only ``end_id``. Rows without
    doc_id, and repeated rows, are packed like all others. Other columns are
    ignored. An empty table gives an empty result.
    """
    rows = cut(pieces(docs, vocabulary, end_id, capacity), "pieces")
    counts = cut(rows.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = plan(histogram, capacity)
    ranked = rows.join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))
    grouped: dict[int, list[tuple[int, ...]]] = defaultdict(list)
    for length, *slot in slots:
        grouped[length].append(tuple(slot))
    shared = docs.sparkSession.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in grouped.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = shared.value
        for batch in batches:
            length, rank = np.asarray(batch.column(3)), np.asarray(batch.column(5))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for one in np.unique(length).tolist():
                own = np.flatnonzero(length == one)
                slot = plans[one]
                row = slot[np.searchsorted(slot[:, 0], rank[own], side="right") - 1]
                nth = rank[own] - row[:, 0]
                sequence[own] = row[:, 2] + nth // row[:, 4]
                offset[own] = row[:, 3] + nth % row[:, 4] * one
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                                  ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
