"""Line dedup by content-defined chunks of lines.

Lines are hashed, a rolling hash over ``window`` consecutive line hashes is
taken, and a chunk of two lines or more ends wherever that hash is divisible by
``mean``. The boundaries depend on nearby lines only, so a passage that is moved, or that
has other text before it, is soon cut at the same places. Chunks of several lines
that occur more than once in the corpus keep their first occurrence.

Chunks meet by hash but are told apart by their bytes: a block of documents
keeps one copy of each distinct chunk, and its bytes travel to the bucket of
the chunk's hash, where equal bytes (not equal hashes) decide.

A repeat rarely begins and ends at boundaries, so a repeated chunk grows: a line
next to it goes too where the chunk with all lines between it and that line
occurs earlier. These runs travel as 128-bit hashes, chained from the chunk's
over its neighbours' lines. Beyond a neighbour that agrees wholly, the neighbour is
a repeated chunk itself and grows on. Without a whole chunk in it, a repeat stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .blocks import apply_marks, blob_rows, by_bucket, doc_bucket, pack, unpack, with_sub
from .encoder import forget
from .shared import cut, fixed, memory_scale, mix64, pack_texts, parts_for, slices, unpack_texts

BLOCK_BYTES = 16 << 20
HELD = 200  # bytes that a unit takes beside its key
STEP = 0x9E3779B97F4A7C15


def chunk_edges(lines: list[bytes], window: int, mean: int) -> list[int]:
    """Line numbers where chunks begin, with the number of lines at the end; only the last chunk may have a single line."""
    n = len(lines)
    if n <= window:
        return [0, n]
    hashes = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, lines)), ">u8").astype(np.uint64)
    rolled = np.zeros(n - window + 1, np.uint64)
    for j in range(window):
        rolled = rolled * np.uint64(STEP) + hashes[j: n - window + 1 + j]
    ends = np.flatnonzero(mix64(rolled) % np.uint64(mean) == 0) + window
    edges = [0]
    for end in ends[ends < n].tolist():
        if end - edges[-1] > 1:
            edges.append(end)
    return [*edges, n]


def chunk_units(text: bytes, window: int, mean: int, grow: bool) -> Iterator[tuple[int, bytes]]:
    """(unit, key) of each chunk of two lines or more that is not blank, and of the runs that it grows to.

    A unit is twice a chunk's first line, or twice the line that a run ends in, and one. The key is
    the chunk's bytes, or a run's hash, chained from the chunk's line by line outwards.
    """
    lines = text.split(b"\n")
    edges = chunk_edges(lines, window, mean)
    digest = xxhash.xxh3_128_digest
    for k, (i, j) in enumerate(zip(edges, edges[1:], strict=False)):
        if j - i < 2:
            continue
        chunk = b"\n".join(lines[i:j])
        if not chunk.strip():
            continue
        yield 2 * i, chunk
        if grow:
            own = digest(chunk)
            before = after = own
            for line in range(i - 1, edges[k - 1] - 1 if k else -1, -1):
                before = digest(b"<" + before + lines[line])
                yield 2 * line + 1, before
            for line in range(j, edges[k + 2] if k + 2 < len(edges) else j):
                after = digest(b">" + after + lines[line])
                yield 2 * line + 1, after


Place = tuple[int, int, int]


def _keep_first(seen: dict[bytes, Place], chunk: bytes, place: Place, later: list[Place]) -> None:
    best = seen.setdefault(chunk, place)
    if place < best:
        seen[chunk] = place
        later.append(best)
    elif place > best:
        later.append(place)


def _mark_rows(later: list[Place], buckets: int, **kind: int) -> pa.RecordBatch:
    doc, sub, chunk = np.array(later, np.int64).reshape(-1, 3).T
    doc = np.ascontiguousarray(doc)
    return blob_rows(*by_bucket(doc_bucket(doc, np.ascontiguousarray(sub), buckets), doc, sub, chunk), **kind)


def repeated_chunks(docs: DataFrame, window: int, mean: int, buckets: int, grow: bool = True) -> DataFrame:
    """Marks (doc bucket, packed doc_id, sub, unit) of all but the first of equal units (see :func:`chunk_units`).

    A block is flushed by the bytes that it holds, also inside a text.
    """

    most = BLOCK_BYTES * memory_scale(docs.sparkSession)

    def flush(seen: dict[bytes, Place], later: list[Place]) -> Iterator[pa.RecordBatch]:
        yield _mark_rows(later, buckets, kind=1)
        chunks = list(seen)
        where = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, chunks)), ">u8").astype(np.uint64)
        bucket = (where % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        places = np.array(list(seen.values()), np.int64).reshape(-1, 3)
        names, first = np.unique(bucket[order], return_index=True)
        blobs = []
        for i, j in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
            own = order[i:j]
            head = pack(*places[own].T)
            blobs.append(np.uint32(len(head)).tobytes() + head + zstandard.compress(pack_texts([chunks[x] for x in own.tolist()]), 1))
        yield blob_rows(names.tolist(), blobs, kind=0)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen: dict[bytes, Place] = {}
        later: list[Place] = []
        total = 0
        for batch in slices(batches, 1000):
            for doc, sub, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                if doc is None or not text:
                    continue
                for unit, key in chunk_units(text, window, mean, grow):
                    _keep_first(seen, key, (doc, sub, unit), later)
                    total += len(key) + HELD
                    if total >= 3 * most:
                        yield from flush(seen, later)
                        seen, later, total = {}, [], 0
        if seen:
            yield from flush(seen, later)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, Place] = {}
        later: list[Place] = []
        for batch in batches:
            for bucket, blob, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 1:
                    yield blob_rows([bucket], [blob])
                    continue
                size = int(np.frombuffer(blob, np.uint32, 1)[0])
                places = zip(*(a.tolist() for a in unpack(blob[4: 4 + size], 3)), strict=True)
                for chunk, place in zip(unpack_texts(zstandard.decompress(blob[4 + size:])), places, strict=True):
                    _keep_first(seen, chunk, place, later)
        yield _mark_rows(later, buckets)

    sent = docs.select("doc_id", docs.columns[-1], "text").mapInArrow(send, "bucket long, blob binary, kind int")
    return sent.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(meet, "bucket long, blob binary")


def dedup_lines(docs: DataFrame, window: int = 2, mean: int = 2, grow: bool = True) -> DataFrame:
    r"""Remove multi-line chunks that occur earlier, in the order of (doc_id, place).

    With ``grow``, lines next to a chunk go as well, up to the ends of its neighbours, where the
    run of that line, the chunk and what is between them occurs earlier.

    All columns of ``docs`` come back; ``text`` keeps its other lines, joined by
    ``\n``. Added: ``n_lines`` and ``n_removed_lines``; columns of these names
    are replaced, and one that differs from doc_id or text in case alone is renamed.

    Null text stays null with no lines; an empty text is one empty line. Chunks
    of white space only are kept. Rows without doc_id neither remove nor lose
    lines; rows equal in doc_id and text count as one document and stay alike.
    Texts that lose all lines become empty. Empty tables give empty results.
    """
    docs = fixed(docs.drop(*[c for c in docs.columns if c.lower() in {"n_lines", "n_removed_lines"}]), "doc_id", "text")
    keyed = with_sub(docs)
    buckets = parts_for(docs.select("doc_id", "text"))
    marks = cut(repeated_chunks(keyed, window, mean, buckets, grow), "chunk-marks")
    names = docs.columns
    place = names.index("text")
    out = StructType([*docs.schema.fields[:place], StructField("text", StringType()), *docs.schema.fields[place + 1:],
                      StructField("n_lines", LongType()), StructField("n_removed_lines", LongType())])

    def edit(rows: pa.RecordBatch, marked: list[np.ndarray | None]) -> pa.RecordBatch:
        texts, n_lines, n_removed = [], [], []
        for text, gone in zip(rows.column(place).cast(pa.binary()).to_pylist(), marked, strict=True):
            lines = [] if text is None else text.split(b"\n")
            n_lines.append(len(lines))
            if gone is None or text is None:
                n_removed.append(0)
                texts.append(text)
                continue
            edges = chunk_edges(lines, window, mean)
            end = dict(zip(edges, edges[1:], strict=False))
            stay = [True] * len(lines)
            for unit in gone.tolist():
                i = unit // 2
                j = i + 1 if unit % 2 else end[i]
                stay[i:j] = [False] * (j - i)
            kept = [line for line, own in zip(lines, stay, strict=True) if own]
            n_removed.append(len(lines) - len(kept))
            texts.append(b"\n".join(kept))
        fields = [rows.column(i) if i != place else pa.array(texts, pa.binary()).cast(pa.string()) for i in range(len(names))]
        return pa.record_batch([*fields, pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64())], [*names, "n_lines", "n_removed_lines"])

    return apply_marks(keyed, marks, buckets, edit, out)
