"""Token ids in Parquet list columns, in the order of doc_id.

Each shard is one file that holds a contiguous range of documents: ``doc_id``,
``shard``, ``offset`` (ids of the shard before the document), ``n_tokens`` and
the list column ``tokens``. Ids are dictionary-encoded (bit-packed to the width
of the vocabulary) or delta-encoded, row groups have a set size, and the
writer's page indexes let a reader skip to the pages it needs; metadata alone
is read without touching the token pages.

The ranges come from the doc_id column only. Documents are then encoded
where they are read, and their compressed ids travel once, to their shard,
where Spark sorts them and the writer streams them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoder import encoder, forget, text_batches
from .ranges import LOWEST, MOST, flagged, range_count, range_of, range_tops
from .shared import binary_column, columns, cut, new_path

FILE = "doc_id long, shard int, offset long, n_tokens long, tokens array<int>"


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, *, encoding: str = "dictionary",
                 row_group_mb: int = 16, page_kb: int = 256, codec: str = "zstd") -> None:
    """Encode ``text`` and write the token table to ``path``.

    ``encoding`` is ``dictionary`` or ``delta``. Null and empty texts hold only
    ``end_id``. Rows without doc_id come first; these, and rows that share a
    doc_id, are ordered by a hash of the text, and equal ones are dealt over
    all ranges that their key spans. Other columns are ignored; an empty table
    gives an empty file set with the schema.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")
    docs = columns(docs, "doc_id", "text")
    rows, several = flagged(docs)
    tie = F.lit(0).cast("long")
    if several is not None:  # where a row goes within its key is free
        mask = (1 << 24) - 1
        salted = F.xxhash64("text").bitwiseAND(F.lit(~mask)).bitwiseOR(F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit(mask)))
        tie = F.when(several, salted).otherwise(tie)
    keyed = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(LOWEST)).alias("_k"), tie.alias("_s"))
    if several is not None:  # numbers of rows after a join hold for one run of it only: written, they are the same for every reader and for tasks that run again
        keyed = cut(keyed, "salted")
    tops = range_tops(keyed, range_count(docs))
    shards = max(1, len(tops))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, squeeze = encoder(vocabulary), zstandard.ZstdCompressor(level=1).compress
        for batch in text_batches(batches, 1):
            ids, edges = library.encode(batch.column(1), end_id)
            narrow = not len(ids) or int(ids.max()) < 1 << 16
            raw, wide = memoryview(ids.astype("<u2") if narrow else ids).cast("B"), 2 if narrow else 4
            at = (wide * edges).tolist()
            blobs = [squeeze(raw[i:j]) for i, j in zip(at, at[1:], strict=False)]
            key, sub = np.asarray(batch.column(2), np.int64), np.asarray(batch.column(3), np.int64)
            yield pa.record_batch([pa.array(range_of(key, sub, tops), pa.int32()), batch.column(2), batch.column(3), batch.column(0),
                                   pa.array(np.full(len(blobs), wide, np.int32)), binary_column(blobs)], ["shard", "k", "s", "doc_id", "wide", "ids"])

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        expand = zstandard.ZstdDecompressor().decompress
        shard, offset = None, 0
        for batch in text_batches(batches, 3, 4 << 20):
            to = np.asarray(batch.column(0))
            for one in np.unique(to).tolist():
                part = batch.filter(pa.array(to == one))
                if one != shard:
                    shard, offset = one, 0
                ids = [np.frombuffer(expand(b), f"<u{w}") for w, b in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                size = np.array([len(x) for x in ids], np.int64)
                ends = size.cumsum()
                tokens = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.record_batch([part.column(1), part.column(0), pa.array(offset + ends - size), pa.array(size), tokens], [c.split()[0] for c in FILE.split(", ")])
                offset += int(ends[-1])

    sent = keyed.mapInArrow(send, "shard int, k long, s long, doc_id long, wide int, ids binary")
    placed = sent.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "k", "s").select("shard", "doc_id", "wide", "ids")
    (placed.mapInArrow(receive, FILE).write.option("compression", codec).option("parquet.block.size", row_group_mb << 20).option("parquet.page.size", page_kb << 10)
     .option("parquet.enable.dictionary", str(encoding == "dictionary").lower()).option("parquet.writer.version", "PARQUET_2_0").parquet(path))


def read_tokens(spark: SparkSession, path: str, tokens: bool = True) -> DataFrame:
    """The token table with ``start``, the ids of all documents before; ``tokens=False`` reads metadata only.

    A number per shard, of which there are at most ``ranges.MOST``, passes through the driver.
    """
    rows = spark.read.schema(FILE).parquet(path)
    sizes = sorted(rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    bases = zip([r["shard"] for r in sizes], [0, *accumulate(r["n"] for r in sizes)], strict=False)
    base = spark.createDataFrame(list(bases), "shard int, base long")
    base = F.broadcast(base) if len(sizes) <= MOST else base
    kept = (rows if tokens else rows.drop("tokens")).join(base, "shard")
    return kept.select(*[c for c in rows.columns if c in kept.columns], (F.col("base") + F.col("offset")).alias("start"))


def token_checksums(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of a table from :func:`read_tokens`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            lists = batch.column(3)
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), np.uint32)).cast("B")
            edges = (4 * np.asarray(lists.offsets, np.int64)).tolist()
            crc = [zlib.crc32(raw[i:j]) for i, j in zip(edges, edges[1:], strict=False)]
            yield pa.record_batch([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encoded_checksums(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Write the documents' tokens to a file set in the shared folder and check-sum what is read back."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary, end_id)
    return token_checksums(read_tokens(docs.sparkSession, path))
