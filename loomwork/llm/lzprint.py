"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into phrases: each is the longest phrase seen so far in the
text plus one more byte (LZ78). The set of phrases is hashed, and its
``KEEP`` smallest 32-bit hashes are the signature. The likeness of two
signatures estimates the Jaccard similarity of the phrase sets, which is high
where one text's dictionary would compress the other.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import LOWEST, flagged, range_count, range_of, range_tops
from .shared import columns, slices, text_bytes

KEEP = 128


def parse(data: bytes, at: int, end: int, known: set[bytes]) -> tuple[int, list[bytes]]:
    """Parse ``data[at:end]`` and add the new phrases to ``known``.

    Returns where the unfinished last phrase begins, and the new phrases. Every
    prefix of a phrase is a phrase, so the search may start from the length of
    the last one and go either way.
    """
    fresh = []
    size = 3
    while True:
        stop = at + size
        if stop <= end and data[at:stop] in known:
            stop += 1
            while stop <= end and data[at:stop] in known:
                stop += 1
            if stop > end:
                return at, fresh
        else:
            stop = min(stop, end + 1) - 1
            while stop > at and data[at:stop] not in known:
                stop -= 1
            stop += 1
            if stop > end:
                return at, fresh
        phrase = data[at:stop]
        known.add(phrase)
        fresh.append(phrase)
        size, at = stop - at, stop


def hashes(phrases: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, phrases)), ">u4")[::2].astype(np.uint32)


def signature(*parts: np.ndarray) -> np.ndarray:
    """The smallest distinct hashes of the parts together, ascending."""
    return np.unique(np.concatenate(parts))[:KEEP]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smallest hashes of both that both have; two empty signatures are alike."""
    both = np.concatenate([a, b])
    both.sort()
    twice = both[1:] == both[:-1]
    fresh = np.r_[True, ~twice] if len(both) else twice
    rank = fresh.cumsum()
    total = min(KEEP, int(rank[-1])) if len(both) else 0
    return float((twice & (rank[1:] <= total)).sum() / total) if total else 1.0


def spell(sign: np.ndarray) -> str:
    return base64.b64encode(sign.astype("<u4").tobytes()).decode()


def fingerprint(text: bytes) -> np.ndarray:
    return signature(hashes(parse(text, 0, len(text), set())[1]))


def edit(text: str, donor: str) -> tuple[str, int]:
    """The text with its last third replaced by the donor's beginning, and how many characters stay."""
    third = len(text) // 3
    return text[: len(text) - third] + donor[:third], len(text) - third


def fingerprint_both(text: str, edited: str, common: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of a text and of another that begins with the same ``common`` characters (parsed once)."""
    one, two = text.encode(), edited.encode()
    shared = len(text[:common].encode())
    known: set[bytes] = set()
    at, phrases = parse(one, 0, shared, known)
    base = hashes(phrases)
    other = hashes(parse(two, at, len(two), set(known))[1])
    own = hashes(parse(one, at, len(one), known)[1])
    return signature(base, own), signature(base, other)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fingerprint`` of every whole text; null texts count as empty (an empty fingerprint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = [spell(fingerprint(t)) for t in text_bytes(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


OUT = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n long"
CHUNK = 1000


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprint each text, its edit with the next document, and compare.

    The next document is the one before in ascending (doc_id, hash of the text
    among rows that share a doc_id); after the lowest comes the highest. Null
    texts count as empty, rows without doc_id as lowest. A single row is its
    own next, and equal rows follow one another. Returns the columns of ``OUT``
    without ``n``; other columns are ignored; an empty table gives an empty result.

    Documents go to contiguous ranges of doc_id, which Spark sorts and the
    tasks stream. The highest document of a range also goes to the range above
    it, whose lowest document it follows, so ranges need no further exchange.
    Rows equal in doc_id and text travel and are parsed once, with their number.
    """
    docs = columns(docs, "doc_id", "text")
    rows, several = flagged(docs)
    if several is None:
        keyed = rows.select("doc_id", "text", F.lit(0).cast("long").alias("_s"), F.lit(1).cast("long").alias("_n"))
    else:
        texts = rows.withColumn("text", F.coalesce("text", F.lit("")))
        equal = texts.filter(several).groupBy("doc_id", "text").agg(F.count("*").alias("_n"))
        keyed = texts.filter(~several).select("doc_id", "text", F.lit(0).cast("long").alias("_s"), F.lit(1).cast("long").alias("_n")).union(
            equal.select("doc_id", "text", F.xxhash64("text"), "_n"))
    keyed = keyed.withColumn("_k", F.coalesce("doc_id", F.lit(LOWEST)))
    tops = range_tops(keyed, range_count(docs))
    count = max(1, len(tops))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches, 1000):
            if not batch.num_rows:
                continue
            texts = pa.array([squeeze(t) for t in text_bytes(batch.column(1))], pa.binary())
            key, sub = np.asarray(batch.column(0), np.int64), np.asarray(batch.column(2), np.int64)
            to = range_of(key, sub, tops)
            edge = np.flatnonzero((key == tops[to, 0]) & (sub == tops[to, 1]))
            own = pa.array(np.r_[np.arange(len(key)), edge])
            goes = np.r_[to, (to[edge] + 1) % count]
            halo = np.r_[np.zeros(len(key), np.int32), np.ones(len(edge), np.int32)]
            yield pa.record_batch([pa.array(goes, pa.int32()), pa.array(halo), *(batch.column(i).take(own) for i in (0, 2, 4, 3)), texts.take(own)],
                                  ["bucket", "halo", "k", "s", "doc_id", "n", "text"])

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        at, last, waiting, closed, out = None, None, None, False, []
        for batch in slices(batches, 500):
            for bucket, halo, doc, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != at:
                    at, last, waiting, closed = bucket, None, None, False
                if closed:
                    continue
                raw = expand(blob)
                text = raw.decode()
                if last is not None:
                    edited, common = edit(last[2], text)
                    sign, edited_sign = fingerprint_both(last[2], edited, common)
                    if waiting:
                        out.append((*waiting[:-1], likeness(waiting[-1], sign), 1))
                    spelt = spell(sign)
                    if last[1] > 1:
                        again, common = edit(last[2], last[2])
                        own = fingerprint_both(last[2], again, common)[1]
                        out.append((last[0], len(last[2]), again, spelt, spell(own), likeness(sign, own), 1.0, last[1] - 1))
                    waiting = (last[0], len(last[2]), edited, spelt, spell(edited_sign), likeness(sign, edited_sign), sign)
                last, closed = (doc, n, text), bool(halo)
                if closed:
                    out.append((*waiting[:-1], likeness(waiting[-1], fingerprint(raw)), 1))
                if len(out) >= 500 or sum(len(row[2]) for row in out[-2:]) > 1 << 20:
                    yield _rows(out)
                    out = []
        if out:
            yield _rows(out)

    sent = keyed.select("_k", "text", "_s", "_n", "doc_id").mapInArrow(send, "bucket int, halo int, k long, s long, doc_id long, n long, text binary")
    ordered = sent.repartitionById(count, F.col("bucket")).sortWithinPartitions("bucket", "halo", F.desc("k"), F.desc("s"), "text")
    found = ordered.select("bucket", "halo", "doc_id", "n", "text").mapInArrow(receive, OUT)
    if several is not None:  # equal rows become rows again, a thousand of them in a place
        parts = F.transform(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div " + str(CHUNK))), lambda c: F.least(F.lit(CHUNK).cast("long"), F.col("n") - c * CHUNK))
        found = found.withColumn("n", F.explode(parts)).repartition(count).withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return found.drop("n")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [c.split()[0] for c in OUT.split(", ")])
