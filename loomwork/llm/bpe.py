"""Byte-level BPE encoding and decoding with a global shuffle of distinct words.

Documents are split into pre-tokens in blocks. A block numbers its distinct
words by frequency and writes each document as a sequence of these numbers, in
the order of position: the explosion into (word, document, position), with
the rows of one word in one block combined before the shuffle. The distinct
words of all blocks meet by hash, each is encoded once, and its ids return to
the blocks that hold it. There they join the sequences, which reassembles every
document by position; decoding joins the ids with the table of token bytes.

The split runs once: its words and sequences are written to the shared folder,
as are the ids of the words, and the join reads these tables. So the numbers of
a block are fixed, whatever is computed again after a loss.

A document is split at single spaces before a character that is not white
space, where no pre-token crosses; each distinct piece of a block is matched
once. A text where a space precedes white space is matched whole.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import pack, unpack
from .encoder import LOOSE, regrouped, text_batches
from .shared import binary_column, columns, cut, memory_scale, new_path, pack_texts, parts_for, remove, unpack_texts

BLOCK_BYTES = 16 << 20
GROUP_WORDS = 1 << 17
RANKS = 6368 + (8 << 16)


@functools.cache
def token_bytes(path: str) -> list[bytes]:
    """The token-byte table of a rank file: bytes by id."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


@functools.cache
def word_encoder(path: str, pattern: str):
    """Ids of one pre-token, as the tiktoken library merges its bytes."""
    import tiktoken

    ranks = {token: i for i, token in enumerate(token_bytes(path)) if token}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in blocks of about ``most`` bytes of text, at least a row each."""
    held, size = [], 0
    for batch in text_batches(batches, 1, most):
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def numbered(texts: pa.Array, pattern: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words by falling frequency; all texts' words as these numbers; how many each text has."""
    texts = texts.fill_null("")
    loose = pc.match_substring_regex(texts, LOOSE)
    whole = np.flatnonzero(np.asarray(loose.to_pylist(), bool))
    lists = pc.split_pattern(pc.if_else(loose, "", texts), " ")
    count = np.asarray(pc.list_value_length(lists), np.int64)
    coded = lists.flatten().dictionary_encode()
    codes, units = np.asarray(coded.indices, np.int64), coded.dictionary
    first = count.cumsum() - count
    seen, rest = np.zeros(len(units), bool), np.ones(len(codes), bool)
    rest[first] = False
    seen[codes[rest]] = True
    spaced = np.flatnonzero(seen)  # a text's first unit has no leading space
    number = np.zeros(len(units), np.int64)
    number[spaced] = np.arange(len(spaced))
    heads = codes[first]
    codes = number[codes]
    codes[first] = len(spaced) + np.arange(len(first))
    pieces = [*pc.binary_join_element_wise(" ", units.take(pa.array(spaced)), "").to_pylist(), *units.take(pa.array(heads)).to_pylist()]
    for i, text in zip(whole.tolist(), texts.take(pa.array(whole)).to_pylist(), strict=True):
        pieces[len(spaced) + i] = text
    find, words = regex.compile(pattern).findall, {}
    split = [find(p) for p in pieces]
    size = np.fromiter(map(len, split), np.int64, len(split))
    total = int(size.sum())
    flat = np.fromiter((words.setdefault(w, len(words)) for w in chain.from_iterable(split)), np.int64, total)
    long = size[codes]
    begin = (size.cumsum() - size)[codes] - (long.cumsum() - long)
    numbers = flat[np.repeat(begin, long) + np.arange(int(long.sum()))]
    edges = np.r_[0, long.cumsum()][np.r_[0, count.cumsum()]]
    order = np.argsort(-np.bincount(numbers, minlength=len(words)), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    spelt = list(words)
    return [spelt[i] for i in order.tolist()], place[numbers], np.diff(edges)


def pack_ranks(numbers: np.ndarray) -> bytes:
    """Word numbers by falling frequency, compressed: a byte for the first 224, two for the next 6,144, three for others.

    The bytes of each place are compressed apart, as their frequencies differ.
    """
    if len(numbers) and int(numbers.max()) >= RANKS:
        return b"\0" + pack(numbers)
    over, far = numbers - 224, numbers - 6368
    first = np.where(over < 0, numbers, np.where(far < 0, 224 + (over >> 8), 248 + (far >> 16))).astype(np.uint8)
    rest = far[far >= 0]
    streams = [zstandard.compress(x.astype(np.uint8).tobytes(), 1) for x in (first, over[(over >= 0) & (far < 0)] & 255, rest >> 8 & 255, rest & 255)]
    return b"\1" + pack_texts(streams)


def unpack_ranks(blob: bytes) -> np.ndarray:
    """The numbers of :func:`pack_ranks`."""
    if blob[0] == 0:
        return unpack(blob[1:], 1)[0]
    first, second, high, low = (np.frombuffer(zstandard.decompress(x), np.uint8).astype(np.int64) for x in unpack_texts(blob[1:]))
    two, three = (first >= 224) & (first < 248), first >= 248
    first[two] = 224 + (first[two] - 224 << 8) + second
    first[three] = 6368 + (first[three] - 248 << 16) + (high << 8) + low
    return first


def _framed(head: bytes, body: bytes) -> bytes:
    return np.uint32(len(head)).tobytes() + head + body


def _parts(blob: bytes, columns_: int) -> tuple[list[np.ndarray], bytes]:
    size = int(np.frombuffer(blob, np.uint32, 1)[0])
    return unpack(blob[4: 4 + size], columns_), blob[4 + size:]


def split_documents(docs: DataFrame, pattern: str, buckets: int) -> tuple[DataFrame, DataFrame, str]:
    """Words (bucket, block, blob) and sequences (block, blob) of ``docs(doc_id, text)``, written to the shared folder; where the words are."""

    most = BLOCK_BYTES * memory_scale(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in blocks(batches, most):
            words, numbers, sizes = numbered(batch.column(1), pattern)
            found = [w.encode() for w in words]
            where = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, found)), ">u8").astype(np.uint64)
            bucket = (where % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            names, first = np.unique(bucket[order], return_index=True)
            blobs = []
            for i, j in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
                own = order[i:j]
                blobs.append(_framed(pack(own), zstandard.compress(pack_texts([found[x] for x in own.tolist()]), 9)))
            has = np.asarray(batch.column(0).is_valid().to_pylist(), np.int64)
            ids, ends = np.asarray(batch.column(0).fill_null(0), np.int64), sizes.cumsum()
            group = (ends - sizes) // GROUP_WORDS
            edges = [*np.flatnonzero(np.r_[True, group[1:] != group[:-1]]).tolist(), len(ids)]
            for i, j in zip(edges, edges[1:], strict=False):
                blobs.append(_framed(pack(has[i:j], ids[i:j], sizes[i:j]), pack_ranks(numbers[int(ends[i] - sizes[i]): int(ends[j - 1])])))
            many = len(edges) - 1
            yield pa.record_batch([pa.array([0] * len(names) + [1] * many, pa.int32()), pa.array([*names.tolist(), *[0] * many], pa.int32()),
                                   pa.array([block] * len(blobs), pa.int64()), binary_column(blobs)], ["kind", "bucket", "block", "blob"])
            block += 1

    form, path = "kind int, bucket int, block long, blob binary", new_path(docs.sparkSession, "words")
    docs.mapInArrow(run, form).write.partitionBy("kind").parquet(path)
    held = docs.sparkSession.read.schema("bucket int, block long, blob binary, kind int").parquet(path)
    return held.filter("kind = 0").select("bucket", "block", "blob"), held.filter("kind = 1").select("block", "blob"), f"{path}/kind=0"


def encode_and_decode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` (array of int) and ``decoded`` (the bytes of those ids) of every text.

    ``ranks`` is the path of a rank file, ``pattern`` what splits texts into
    pre-tokens; strings of special tokens are ordinary text. Null and empty
    texts have no ids. Rows without doc_id and repeated rows are each encoded.
    Other columns are ignored; an empty table gives an empty result.
    """
    docs = columns(docs, "doc_id", "text")
    buckets = parts_for(docs, 8)
    words, sequences, place = split_documents(docs, pattern, buckets)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}
        merge = word_encoder(ranks, pattern)
        for batch in batches:
            out = []
            for blob in batch.column(2).to_pylist():
                (number,), rest = _parts(blob, 1)
                ids = []
                for word in unpack_texts(zstandard.decompress(rest)):
                    if word not in known:
                        known[word] = np.array(merge(word.decode()), np.int32)
                    ids.append(known[word])
                out.append(_framed(pack(number, np.fromiter(map(len, ids), np.int64, len(ids))), pack(np.concatenate(ids))))
            yield pa.record_batch([batch.column(1), pa.array(np.zeros(len(out), np.int32)), binary_column(out)], ["block", "kind", "blob"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(token_bytes(ranks), pa.binary())
        at, held, joined = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                block, kind, blob = (batch.column(c)[i].as_py() for c in range(3))
                if block != at:
                    at, held, joined = block, [], None
                if kind == 0:
                    held.append(blob)
                    continue
                if joined is None:
                    joined, held = _dictionary(held, table), []
                flat, begin, size, spelt = joined
                (has, docs, count), rest = _parts(blob, 3)
                numbers = unpack_ranks(rest)
                long = size[numbers]
                ends = long.cumsum()
                ids = flat[np.repeat(begin[numbers] - (ends - long), long) + np.arange(int(long.sum()))]
                edges = np.r_[0, ends][np.r_[0, count.cumsum()]].astype(np.int32)
                yield pa.record_batch([pa.array(docs, mask=has == 0), pa.ListArray.from_arrays(pa.array(edges), pa.array(ids)), regrouped(spelt.take(pa.array(numbers)), count)],
                                      ["doc_id", "ids", "decoded"])

    encoded = cut(words.repartitionById(buckets, F.col("bucket")).mapInArrow(encode, "block long, kind int, blob binary"), "word-ids")
    remove(docs.sparkSession, place)
    both = encoded.union(sequences.select("block", F.lit(1).alias("kind"), "blob"))
    return (both.repartition(2 * buckets, "block").sortWithinPartitions("block", "kind")
            .mapInArrow(assemble, "doc_id long, ids array<int>, decoded binary"))


def _dictionary(held: list[bytes], table: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """A block's ids, and by word number: where they begin, how many they are, and their bytes."""
    numbers, sizes, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for blob in held:
        (number, size), rest = _parts(blob, 2)
        numbers.append(number)
        sizes.append(size)
        flat.append(unpack(rest, 1)[0].astype(np.int32))
    number, size, ids = np.concatenate(numbers), np.concatenate(sizes), np.concatenate(flat)
    order = np.argsort(number)
    begin, size = (size.cumsum() - size)[order], size[order]
    ids = ids[np.repeat(begin - (size.cumsum() - size), size) + np.arange(len(ids))]
    return ids, size.cumsum() - size, size, regrouped(table.take(pa.array(ids)), size)
