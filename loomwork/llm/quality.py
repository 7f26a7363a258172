"""Quality classifier: random Fourier features, ridge, isotonic calibration.

Each text is described by statistics of its bytes, words and lines. Random
Fourier features of the standardised statistics approximate a Gaussian kernel;
ridge regression on them needs only the sums of outer products, which every
partition adds up for itself and which meet in two steps. A quarter of the
training rows is left out of the fit; isotonic regression on their raw scores
turns scores into probabilities. All training rows take part, whatever their number.

Fixed sizes reach the driver: the sums (``FEATURES`` squared), and a histogram
of ``BINS`` raw scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .encoder import forget
from .shared import binary_column, columns, cut, fixed, slices, text_bytes

FEATURES = 256
BINS = 4096
LOW, HIGH = -0.5, 1.5  # range of the raw scores in the histogram; outer ones count at its ends
GROUPS = 64
SENT_IDS = 2_000_000  # labelled ids that may go to every executor (16 MB and a hash table)
STATISTICS = (
    "log_bytes", "log_words", "word_length", "upper_share", "digit_share", "punctuation_share", "space_share", "other_share",
    "doubled_punctuation", "wordless_share", "shouted_share", "punctuated_share", "distinct_words", "adjacent_repeats",
    "log_lines", "distinct_lines", "line_length", "entropy",
)


def _classes() -> np.ndarray:
    """Class of each byte: 0 lower, 1 upper, 2 digit, 3 punctuation, 4 space, 5 other."""
    kinds = np.full(256, 5, np.uint8)
    kinds[33:127] = 3
    kinds[ord("a"): ord("z") + 1], kinds[ord("A"): ord("Z") + 1], kinds[ord("0"): ord("9") + 1] = 0, 1, 2
    kinds[9:14] = kinds[32] = 4
    return kinds


CLASSES = _classes()


def statistics(text: bytes) -> np.ndarray:
    """The ``STATISTICS`` of a text; all zero for an empty one."""
    out = np.zeros(len(STATISTICS))
    if not text:
        return out
    raw = np.frombuffer(text, np.uint8)
    kinds = CLASSES[raw]
    n = len(raw)
    share = np.bincount(kinds, minlength=6) / n
    letters = share[0] + share[1] + share[5]
    words = text.split()
    count = max(1, len(words))
    punctuation = kinds == 3
    doubled = np.count_nonzero(punctuation[1:] & (raw[1:] == raw[:-1])) / max(1, np.count_nonzero(punctuation))
    wordless = shouted = punctuated = 0.0
    if words:
        inside = np.r_[False, kinds != 4, False]
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        begin, end = edge[::2], edge[1::2]
        lower = np.r_[0, ((kinds == 0) | (kinds == 5)).cumsum()]
        upper = np.r_[0, (kinds == 1).cumsum()]
        has_lower, has_upper = lower[end] > lower[begin], upper[end] - upper[begin]
        wordless = np.mean(~has_lower & (has_upper == 0))
        shouted = np.mean(~has_lower & (has_upper > 1))
        punctuated = np.mean(punctuation[end - 1])
    lines = text.split(b"\n")
    bytes_seen = np.bincount(raw, minlength=256)
    p = bytes_seen[bytes_seen > 0] / n
    out[:] = (
        np.log1p(n), np.log1p(len(words)), n * (1 - share[4]) / count, share[1] / max(letters, 1e-9), share[2], share[3], share[4], share[5],
        doubled, wordless, shouted, punctuated, len(set(words)) / count ** 0.9, sum(map(eq, words, words[1:])) / count,
        np.log1p(len(lines)), len(set(lines)) / len(lines), np.log1p(n / len(lines)), -(p * np.log2(p)).sum(),
    )
    return out


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``x``, the statistics of each whole text as packed doubles; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [statistics(t).tobytes() for t in text_bytes(batch.column(1))]
            yield pa.record_batch([batch.column(0), binary_column(rows)], ["doc_id", "x"])

    return columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, x binary")


def partition_sums(rows: DataFrame, add: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of ``add`` over all batches: per partition, then per group of partitions, then here."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                one = add(batch)
                total = one if total is None else total + one
        if total is not None:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32()), binary_column([total.tobytes()])], ["g", "s"])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                one = np.frombuffer(blob)
                total = one if total is None else total + one
        if total is not None:
            yield pa.record_batch([binary_column([total.tobytes()])], ["s"])

    sums = rows.mapInArrow(local, "g int, s binary").repartitionById(GROUPS, F.col("g")).mapInArrow(group, "s binary")
    return sum((np.frombuffer(r["s"]) for r in sums.collect()), np.zeros(1))


@dataclass(frozen=True)
class Model:
    """What scoring needs: bounded by ``FEATURES`` and ``BINS``."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of label 1."""
        return np.interp(self.raw(x), self.knots, self.levels)


def unpack_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(-1, len(STATISTICS))


def isotonic(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: nondecreasing means of ``total / count`` (bins with a count only)."""
    blocks: list[list[float]] = []
    for n, s in zip(count.tolist(), total.tolist(), strict=True):
        blocks.append([n, s, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n2, s2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n2, blocks[-1][1] + s2, blocks[-1][2] + k2]
    return np.concatenate([np.full(int(k), s / n) for n, s, k in blocks])


def learnable() -> Column:
    """True for the doc_ids whose label may be learnt."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1


def truths(labels: DataFrame) -> DataFrame:
    """``doc_id`` and ``y``, the mean of its learnable labels."""
    named = columns(labels, "doc_id", "quality").filter("doc_id is not null and quality is not null").filter(learnable())
    return named.groupBy("doc_id").agg(F.avg("quality").alias("y"))


def fit(rows: DataFrame, labels: DataFrame, ridge: float = 1e-3, width: float = 3.0, seed: int = 7) -> Model:
    """Fit on the rows of :func:`document_statistics` that have a learnable label.

    Null labels and labels without doc_id are ignored; several labels of one
    doc_id count as their mean. Without any training row the model scores 0.5.
    """
    truth = truths(labels)
    spare = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 6 == 5  # a quarter of the learnable rows
    train = cut(rows.join(truth, "doc_id").select("x", "y", spare.alias("spare")), "quality-train")

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = unpack_rows(batch.column(0))
        return np.r_[len(x), x.sum(axis=0), (x * x).sum(axis=0)]

    k = len(STATISTICS)
    sums = partition_sums(train, moments)
    if len(sums) == 1:
        nothing = np.zeros(k)
        return Model(nothing, nothing + 1, np.zeros((k, FEATURES)), np.zeros(FEATURES), np.zeros(FEATURES + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    mean = sums[1: k + 1] / sums[0]
    scale = np.sqrt(np.maximum(sums[k + 1:] / sums[0] - mean**2, 0))
    scale[scale < 1e-9] = 1.0
    random = np.random.default_rng(seed)
    base = Model(mean, scale, random.normal(size=(k, FEATURES)) / width, random.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), mean, mean)

    def products(batch: pa.RecordBatch) -> np.ndarray:
        own = ~np.asarray(batch.column(2).to_pylist(), bool)
        z, y = base.expand(unpack_rows(batch.column(0))[own]), np.asarray(batch.column(1), float)[own]
        return np.r_[(z.T @ z).ravel(), z.T @ y, len(z)]

    sums = partition_sums(train, products)
    d = FEATURES + 1
    weights = np.linalg.solve(sums[: d * d].reshape(d, d) + max(1.0, sums[-1]) * ridge * np.eye(d), sums[d * d: -1])
    linear = Model(base.mean, base.scale, base.directions, base.phases, weights, mean, mean)

    def histogram(batch: pa.RecordBatch) -> np.ndarray:
        own = np.asarray(batch.column(2).to_pylist(), bool)
        raw, y = linear.raw(unpack_rows(batch.column(0))[own]), np.asarray(batch.column(1), float)[own]
        at = np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int64)
        return np.r_[np.bincount(at, minlength=BINS).astype(float), np.bincount(at, y, minlength=BINS)]

    sums = partition_sums(train, histogram)
    count, total = sums[:BINS], sums[BINS:]
    used = np.flatnonzero(count > 0)
    knots, levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    if len(used):
        knots = LOW + (used + 0.5) * (HIGH - LOW) / BINS
        levels = isotonic(count[used], total[used])
    return Model(base.mean, base.scale, base.directions, base.phases, weights, knots, levels)


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` for the rows of :func:`document_statistics`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([batch.column(0), pa.array(model.score(unpack_rows(batch.column(1))))], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every row of ``docs``.

    Learns from ``labels(doc_id, quality)`` as :func:`fit` says; only ``text``
    makes the score. Null and empty texts are scored from all-zero statistics.
    A row without doc_id is scored, never learnt, and not held out. Repeated
    rows each count. Other columns are ignored; an empty table gives an empty result.
    """
    rows = cut(document_statistics(docs), "quality-statistics")
    held_out = F.coalesce(~learnable(), F.lit(False))
    return scored(rows, fit(rows, labels)).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, unchanged, whose text scores 0.5 or more.

    Learns as :func:`fit` says. Each text is described once: the fit reads the
    statistics of the rows that have a learnable label, and scoring is part of
    the filter. Null and empty texts are scored from all-zero statistics; rows
    without doc_id are scored too, and repeated rows each. Without labels all
    rows stay. Other columns are kept, and one that differs from doc_id or text
    in case alone is renamed; an empty table gives an empty result.
    """
    docs = fixed(docs, "doc_id", "text")
    ids = cut(truths(labels).select("doc_id"), "quality-ids")
    if ids.count() <= SENT_IDS:  # else the texts are shuffled to their labels
        ids = F.broadcast(ids)
    model = fit(document_statistics(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")), labels)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches):
            if batch.num_rows:
                x = np.stack([statistics(t) for t in text_bytes(batch.column(place))])
                stay = pa.array(model.score(x) >= 0.5)
                yield batch.filter(stay)

    return docs.mapInArrow(run, docs.schema)
