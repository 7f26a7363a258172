"""Ranked lexical search: MaxScore over shards of an inverted index.

A shard is what one task gathers from its own rows, in ascending order of
doc_id, so postings are never shuffled. Of the terms only those of the items
are indexed (their number is bound by the block of items). Document
frequencies are summed over shards, then each shard answers every item.

For an item, a shard orders its terms by their upper bounds (the largest
impact that a posting of the shard has). While the sum of the smallest bounds
cannot lift a document over the score of the item's ``k``-th so far, those terms
are non-essential: candidates come from the others' postings alone, and
a non-essential posting is probed only for candidates that may still qualify.
Documents are taken in ranges, so that the limit rises between them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import pack, unpack
from .encoder import text_batches
from .shared import binary_column, columns, cut

BLOCK_PAIRS = 1 << 17  # (item, term) pairs that are searched for at a time; a longer item is a block of its own
SHARD_POSTINGS = 1 << 20
SHARD_DOCS = 1 << 16
RANGE = 4096  # documents between two looks at the limit
BATCH = 8 << 20
GROUPS = 16  # sums of document frequencies that reach the driver, each as long as a block has terms
#: Terms hold digits, letters and all bytes from 128 on; A-Z become lower case, all else separates.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms, the term at each place of all texts one after the other, and how many places each text has."""
    texts = pa.concat_arrays([texts.fill_null("")])
    n = len(texts)
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int32, n + 1, 4 * texts.offset)
    raw = b"" if data is None else data.to_pybytes()[edges[0]: edges[-1]].translate(FOLD)
    folded = pa.StringArray.from_buffers(n, pa.py_buffer((edges - edges[0]).astype(np.int32)), pa.py_buffer(raw))
    lists = pc.split_pattern(folded, " ")
    flat = lists.flatten().dictionary_encode()
    codes = np.asarray(flat.indices, np.int64)
    real = np.asarray(pc.not_equal(flat.dictionary, "").to_pylist(), bool)[codes] if len(codes) else np.zeros(0, bool)
    sizes = np.asarray(pc.list_value_length(lists), np.int64)
    owner = np.repeat(np.arange(n), sizes)[real]
    return flat.dictionary, codes[real], np.bincount(owner, minlength=n)


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct ``item_id``, ``term`` of the items; rows that share an item_id (null too) are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 1, BATCH):
            words, codes, sizes = terms_of(batch.column(1))
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            pair = np.unique(owner * max(1, len(words)) + codes)
            yield pa.record_batch([batch.column(0).take(pa.array(pair // max(1, len(words)))), words.take(pa.array(pair % max(1, len(words))))], ["item_id", "term"])

    return columns(items, "item_id", "text").mapInArrow(run, "item_id long, term string").distinct()


@dataclass
class Queries:
    """A block of items: their ids, the distinct terms, and each item's term numbers."""

    items: list[int | None]
    terms: pa.Array
    of: list[np.ndarray]


def blocks(pairs: DataFrame, most: int) -> Iterator[Queries]:
    """The items in blocks of at most ``most`` pairs (at least an item each), read one block at a time."""

    def made(rows: list[tuple[int | None, list[str]]]) -> Queries:
        terms = pa.array(sorted({t for _, own in rows for t in own}), pa.string())
        number = {t: i for i, t in enumerate(terms.to_pylist())}
        return Queries([i for i, _ in rows], terms, [np.array([number[t] for t in own], np.int64) for _, own in rows])

    held: list[tuple[int | None, list[str]]] = []
    size, last = 0, None
    for row in pairs.orderBy("item_id", "term").toLocalIterator():
        if not held or row["item_id"] != last:
            if size >= most:
                yield made(held)
                held, size = [], 0
            held.append((row["item_id"], []))
            last = row["item_id"]
        held[-1][1].append(row["term"])
        size += 1
    if held:
        yield made(held)


SHARD = "docs long, terms long, doc binary, postings binary, df binary"


class Builder:
    """Gathers postings (term, document, tf) and lengths of a task's documents until a shard is full."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.ids: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_docs = self.n_postings = 0

    def add(self, ids: pa.Array, sizes: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        self.ids.append((np.asarray(ids.fill_null(0), np.int64), np.asarray(ids.is_null().to_pylist(), np.int64), sizes))
        self.found.append((doc + self.n_docs, term, tf))
        self.n_docs += len(sizes)
        self.n_postings += len(doc)

    @property
    def full(self) -> bool:
        return self.n_postings >= SHARD_POSTINGS or self.n_docs >= SHARD_DOCS

    def shard(self) -> pa.RecordBatch:
        """Documents by ascending doc_id (rows without one last), postings by term and document, and each term's number of documents."""
        ids, null, sizes = (np.concatenate(x) for x in zip(*self.ids, strict=True))
        doc, term, tf = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((sizes, ids, null))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc = place[doc]
        by_term = np.lexsort((doc, term))
        doc, term, tf = doc[by_term], term[by_term], tf[by_term]
        names, df = np.unique(term, return_counts=True)
        steps = np.diff(doc, prepend=0)  # small where a term is frequent
        row = [int((sizes > 0).sum()), int(sizes.sum()), pack(ids[order], null[order], sizes[order]), pack(steps, tf), pack(names, df)]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        self.clear()
        return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in SHARD.split(", ")])


def index(docs: DataFrame, terms: pa.Array) -> DataFrame:
    """Shards of the documents with the postings of ``terms``; every document's length counts."""
    sent = docs.sparkSession.sparkContext.broadcast(terms.to_pylist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = pa.array(sent.value, pa.string()), Builder()
        width = max(1, len(known))
        for batch in text_batches(batches, 1, BATCH):
            words, codes, sizes = terms_of(batch.column(1))
            number = np.asarray(pc.fill_null(pc.index_in(words, value_set=known), -1), np.int64)
            term = number[codes]
            own = term >= 0
            doc = np.repeat(np.arange(batch.num_rows), sizes)[own]
            pair, tf = np.unique(doc * width + term[own], return_counts=True)
            held.add(batch.column(0), sizes, pair // width, pair % width, tf)
            if held.full:
                yield held.shard()
        if held.n_docs:
            yield held.shard()

    return columns(docs, "doc_id", "text").mapInArrow(run, SHARD)


def totals(shards: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms with repeats, and the document frequency of each indexed term; sums per task, then per group."""

    def add(batches: Iterator[pa.RecordBatch], packed: bool) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for docs, terms, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                total = np.zeros(n_terms + 2, np.int64) if total is None else total
                total[-2:] += docs, terms
                if packed:
                    names, df = unpack(blob, 2)
                    total[names] += df
                else:
                    total[:n_terms] += np.frombuffer(blob, np.int64)
        if total is not None:
            fields = [pa.array([total[-2]], pa.int64()), pa.array([total[-1]], pa.int64()), binary_column([total[:n_terms].tobytes()]), pa.array([TaskContext.get().partitionId() % GROUPS], pa.int32())]
            yield pa.record_batch(fields, ["docs", "terms", "df", "g"])

    kinds = "docs long, terms long, df binary, g int"
    sums = shards.select("docs", "terms", "df").mapInArrow(lambda b: add(b, True), kinds).repartitionById(GROUPS, F.col("g")).mapInArrow(lambda b: add(b, False), kinds)
    df, n, length = np.zeros(n_terms, np.int64), 0, 0
    for row in sums.collect():
        df, n, length = df + np.frombuffer(row["df"], np.int64), n + row["docs"], length + row["terms"]
    return n, length, df


def impacts(weight: np.ndarray, tf: np.ndarray, size: np.ndarray, n: int, length: int) -> np.ndarray:
    """What a posting adds to its document's score, in whole numbers."""
    m = 10 + 90 * size * n // max(1, length)
    return weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))


class Shard:
    """A loaded shard: postings with their impacts, and the bounds of its terms."""

    def __init__(self, doc: bytes, postings: bytes, df: bytes, weight: np.ndarray, n: int, length: int) -> None:
        self.ids, self.null, sizes = unpack(doc, 3)
        steps, tf = unpack(postings, 2)
        names, count = unpack(df, 2)
        self.doc = steps.cumsum()
        self.impact = impacts(weight[np.repeat(names, count)], tf, sizes[self.doc], n, length)
        first = count.cumsum() - count
        self.bound = np.zeros(len(weight), np.int64)
        self.begin, self.end = np.zeros(len(weight), np.int64), np.zeros(len(weight), np.int64)
        self.begin[names], self.end[names] = first, first + count
        if len(names):
            self.bound[names] = np.maximum.reduceat(self.impact, first)

    def best(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The places and scores of the ``k`` best documents (score above 0; of equal scores the first places), best first."""
        terms = terms[self.bound[terms] > 0]
        terms = terms[np.argsort(self.bound[terms], kind="stable")]
        below = np.r_[0, self.bound[terms].cumsum()]  # what the terms before each can add together
        at = self.begin[terms].copy()
        top_place, top_score, limit = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for low in range(0, len(self.ids), RANGE):
            high = min(low + RANGE, len(self.ids))
            essential = int(np.searchsorted(below, limit, side="right")) - 1  # a later document needs more than the limit
            if essential >= len(terms):
                break
            score = np.zeros(high - low, np.int64)
            for t in range(essential, len(terms)):
                at[t], stop = np.searchsorted(self.doc[self.begin[terms[t]]: self.end[terms[t]]], (low, high)) + self.begin[terms[t]]
                score[self.doc[at[t]: stop] - low] += self.impact[at[t]: stop]
            candidates = np.flatnonzero(score)
            for t in range(essential - 1, -1, -1):
                candidates = candidates[score[candidates] + below[t + 1] > limit]
                if not len(candidates):
                    break
                own = self.doc[self.begin[terms[t]]: self.end[terms[t]]]
                place = np.searchsorted(own, candidates + low)
                hit = place < len(own)
                hit[hit] = own[place[hit]] == candidates[hit] + low
                score[candidates[hit]] += self.impact[self.begin[terms[t]] + place[hit]]
            candidates = candidates[score[candidates] > limit]
            if len(candidates):
                top_place, top_score = np.r_[top_place, candidates + low], np.r_[top_score, score[candidates]]
                keep = np.lexsort((top_place, -top_score))[:k]
                top_place, top_score = top_place[keep], top_score[keep]
                limit = int(top_score[-1]) if len(keep) == k else 0
        return top_place, top_score


class Best:
    """The ``k`` best (score, doc_id) of each item over the shards of a task."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.held: dict[int, np.ndarray] = {}

    def add(self, item: int, score: np.ndarray, null: np.ndarray, ids: np.ndarray) -> None:
        rows = np.stack([score, null, ids])
        if item in self.held:
            rows = np.concatenate([self.held[item], rows], axis=1)
        self.held[item] = rows[:, np.lexsort((rows[2], rows[1], -rows[0]))[: self.k]]


def search(docs: DataFrame, items: DataFrame, k: int = 10, most: int = BLOCK_PAIRS) -> DataFrame:
    """The ``k`` best documents of each item: ``item_id``, ``rank`` (from 1), ``doc_id``, ``score``.

    Scores are those of the module's formula in 64-bit whole numbers (see
    :func:`weights` and :func:`impacts`); only scores above 0 are returned. Equal
    scores are ranked by ascending doc_id, rows without doc_id last. Null and
    empty texts have no terms and are never found; repeated documents count and
    are returned each. Items without terms return nothing, and rows
    that share an item_id are one item. Other columns are ignored; empty tables give an empty result.
    """
    spark = docs.sparkSession
    parts = [answered(docs, block, k) for block in blocks(cut(item_terms(items), "item-terms"), most)]
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def weights(n: int, df: np.ndarray) -> np.ndarray:
    """A term's weight: floor(1000 ln((2 n + 2) / (2 df + 1))) in doubles."""
    return np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)


def answered(docs: DataFrame, block: Queries, k: int) -> DataFrame:
    """Each task's ``k`` best documents of every item of a block."""
    spark: SparkSession = docs.sparkSession
    shards = cut(index(docs, block.terms), "lexical-shards")
    n, length, df = totals(shards, len(block.terms))
    sent = spark.sparkContext.broadcast((block.items, block.of, weights(n, df)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, of, weight = sent.value
        best = Best(k)
        for batch in batches:
            for doc, postings, terms in zip(*(batch.column(i) for i in range(3)), strict=True):
                shard = Shard(doc.as_py(), postings.as_py(), terms.as_py(), weight, n, length)
                for i, own in enumerate(of):
                    place, score = shard.best(own, k)
                    if len(place):
                        best.add(i, score, shard.null[place], shard.ids[place])
        if best.held:
            names = np.repeat(list(best.held), [rows.shape[1] for rows in best.held.values()])
            score, null, ids = np.concatenate(list(best.held.values()), axis=1)
            yield pa.record_batch([pa.array([items[i] for i in names.tolist()], pa.int64()), pa.array(ids, mask=null.astype(bool)), pa.array(score)], ["item_id", "doc_id", "score"])

    return shards.select("doc", "postings", "df").mapInArrow(run, "item_id long, doc_id long, score long")
