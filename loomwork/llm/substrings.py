"""Substring dedup with Rabin-Karp hashes of fixed-length word windows.

Every window of ``width`` consecutive words gets a polynomial hash of its word
hashes, and 16 bits of a second one by which windows of one hash are told apart;
a block of documents computes all of its windows with running sums.
A block keeps of each hash only its smallest document's windows (the others
are marked at once), so a passage in very many documents travels at most once
per block. Buckets of the hash space then find each hash's smallest document
over the corpus and mark the windows of all others. The marks meet their
documents again, where overlapping windows merge into maximal intervals.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .blocks import apply_marks, blob_rows, by_bucket, doc_bucket, unpack, with_sub
from .shared import cut, fixed, memory_scale, mix64, parts_for, slices, text_bytes, words_of

BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
CHECK = np.uint64(0xD6E8FEB86659FD93)
BLOCK_WORDS = 1 << 20


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of each ``width``-long window, modulo 2**64, finally mixed.

    Window i is the sum of words[i + j] / BASE**j, taken from running sums of words[t] / BASE**t.
    """
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64)
    powers = np.full(n, BASE, np.uint64)
    inverse = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    powers[0] = inverse[0] = 1
    powers, inverse = np.cumprod(powers, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * inverse, dtype=np.uint64, out=sums[1:])
    return mix64((sums[width:] - sums[:-width]) * powers[: n - width + 1])


def grouped(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, where a new window begins in it): equal windows have equal hashes and equal checks."""
    order = np.argsort(hashes, kind="stable")
    own, check = hashes[order], checks[order]
    same = own[1:] == own[:-1]
    if np.any(same & (check[1:] != check[:-1])):  # different windows of one hash: bring equal ones together
        order = np.lexsort((checks, hashes))
        own, check = hashes[order], checks[order]
        same = (own[1:] == own[:-1]) & (check[1:] == check[:-1])
    return order, np.r_[np.ones(min(1, len(order)), bool), ~same]


def intervals(starts: np.ndarray, width: int) -> np.ndarray:
    """Maximal [begin, end) word intervals covered by windows at the ascending ``starts``."""
    gap = np.flatnonzero(np.diff(starts) > width)
    return np.stack([starts[np.r_[0, gap + 1]], starts[np.r_[gap, len(starts) - 1]] + width], axis=1)


def repeated_windows(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    """Marks (doc bucket, packed doc_id, sub, start) of windows that a smaller doc_id holds too.

    ``docs`` has ``doc_id``, ``text`` and what ``with_sub`` adds.
    """
    most = BLOCK_WORDS * memory_scale(docs.sparkSession)

    def flush(held: list[tuple[int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """Empties ``held``."""
        held.sort(key=lambda x: x[0])
        size = np.array([len(h) for *_, h in held], np.int64)
        ids, subs = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)
        words = np.concatenate([h for *_, h in held])
        hashes = window_hashes(words, width)
        checks = (window_hashes(mix64(words ^ CHECK), width) >> np.uint64(48)).astype(np.int64)
        del words
        owner = np.repeat(np.arange(len(held)), size)
        held.clear()
        begin = size.cumsum() - size
        start = np.arange(len(owner)) - begin[owner]
        whole = (start <= size[owner] - width)[: len(hashes)]
        hashes, checks, owner, start = hashes[whole], checks[whole], owner[: len(whole)][whole], start[: len(whole)][whole]
        order, fresh = grouped(hashes, checks)  # documents ascend, so the smallest of a window is first
        hashes, checks, owner, start = hashes[order], checks[order], owner[order], start[order]
        first = np.flatnonzero(fresh)
        low = np.repeat(ids[owner[first]], np.diff(np.r_[first, len(hashes)]))
        later = ids[owner] > low
        doc, sub, at = ids[owner[later]], subs[owner[later]], start[later]
        yield blob_rows(*by_bucket(doc_bucket(doc, sub, buckets), doc, sub, at), kind=1)
        hashes, checks, owner, start = hashes[~later], checks[~later], owner[~later], start[~later]
        bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        yield blob_rows(*by_bucket(bucket, hashes.view(np.int64), checks, ids[owner], subs[owner], start), kind=0)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in slices(batches, 1000):
            for doc, sub, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True):
                words = words_of(text)
                if doc is None or len(words) < width:
                    continue
                held.append((doc, sub, word_hashes(words)))
                total += len(words)
                if total >= most:
                    yield from flush(held)
                    total = 0
        if held:
            yield from flush(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {}
        for batch in batches:
            for bucket, blob, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 1:
                    yield blob_rows([bucket], [blob])
                else:
                    held.setdefault(bucket, []).append(unpack(blob, 5))
        for bucket in list(held):
            parts = [list(x) for x in zip(*held.pop(bucket), strict=True)]
            columns = []
            for part in parts:
                columns.append(np.concatenate(part))
                part.clear()
            hashes, checks, doc, sub, start = columns
            del columns
            order, fresh = grouped(hashes, checks)
            some = ~(fresh & np.r_[fresh[1:], True])  # windows that are not alone
            order, first = order[some], np.flatnonzero(fresh[some])
            if not len(order):
                continue
            owner = doc[order]
            low = np.repeat(np.minimum.reduceat(owner, first), np.diff(np.r_[first, len(owner)]))
            later = order[owner > low]
            yield blob_rows(*by_bucket(doc_bucket(doc[later], sub[later], buckets), doc[later], sub[later], start[later]))

    sent = docs.select("doc_id", docs.columns[-1], "text").mapInArrow(send, "bucket long, blob binary, kind int")
    return sent.repartitionById(buckets, F.col("bucket").cast("int")).mapInArrow(meet, "bucket long, blob binary")


def dedup_substrings(docs: DataFrame, width: int = 13, keep_layout: bool = False) -> DataFrame:
    r"""Remove words that lie in a window of ``width`` words which a smaller doc_id holds too.

    Words are ``[^\x20\x09-\x0D]+``, unchanged. Windows are judged on the input:
    what one document loses changes nothing for the others. All columns of
    ``docs`` come back; ``text`` holds the kept words, joined by one space, or
    with ``keep_layout`` the text without the removed words and the white space
    after each of them. Added: ``n_words``, ``n_removed`` and
    ``spans``, the maximal removed word intervals [begin, end); columns of these
    names are replaced, and one that differs from doc_id or text in case alone is renamed.

    Null text: null stays, no words. Texts of fewer words than ``width`` are kept.
    Rows without doc_id neither remove nor lose words. Rows that share a doc_id
    do not remove each other's words. Empty tables give empty results.
    """
    docs = fixed(docs.drop(*[c for c in docs.columns if c.lower() in {"n_words", "n_removed", "spans"}]), "doc_id", "text")
    keyed = with_sub(docs)
    buckets = parts_for(docs.select("doc_id", "text"), 5)
    marks = cut(repeated_windows(keyed, width, buckets), "window-marks")
    names = docs.columns
    place = names.index("text")
    out = StructType([*docs.schema.fields[:place], StructField("text", StringType()), *docs.schema.fields[place + 1:],
                      StructField("n_words", LongType()), StructField("n_removed", LongType()),
                      StructField("spans", ArrayType(ArrayType(LongType())))])

    def edit(rows: pa.RecordBatch, marked: list[np.ndarray | None]) -> pa.RecordBatch:
        texts, n_words, n_removed, spans = [], [], [], []
        for text, starts in zip(rows.column(place).cast(pa.binary()).to_pylist(), marked, strict=True):
            words = words_of(text or b"")
            cuts = [] if starts is None else intervals(starts, width).tolist()
            n_words.append(len(words))
            n_removed.append(sum(j - i for i, j in cuts))
            spans.append(cuts)
            if text is None or (keep_layout and not cuts):
                texts.append(text)
                continue
            edges = [0, *chain.from_iterable(cuts), len(words)]
            kept = [(edges[i], edges[i + 1]) for i in range(0, len(edges), 2)]
            texts.append(_layout(text, words, kept) if keep_layout else b" ".join(chain.from_iterable(words[i:j] for i, j in kept)))
        fields = [rows.column(i) if i != place else pa.array(texts, pa.binary()).cast(pa.string()) for i in range(len(names))]
        fields += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64())))]
        return pa.record_batch(fields, [*names, "n_words", "n_removed", "spans"])

    return apply_marks(keyed, marks, buckets, edit, out)


def _layout(text: bytes, words: list[bytes], kept: list[tuple[int, int]]) -> bytes:
    begins, at = [], 0
    for word in words:
        at = text.index(word, at)
        begins.append(at)
        at += len(word)
    begins.append(len(text))
    lead = text[: begins[0]]
    return lead + b"".join(text[begins[i]: begins[j]] for i, j in kept if j > i)
