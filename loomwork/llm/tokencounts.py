"""Token counts by a two-tier lookup of pre-token lengths, on the map side alone.

A pre-token's ids do not depend on its neighbours, so a text's count is the sum
of its pre-tokens' lengths. The lengths of the corpus's frequent pre-tokens are
broadcast as a compact open-addressing hash table (numpy arrays and one blob of
bytes). What it lacks is looked up in the worker's own cache, and what that
lacks is encoded, once. No pre-token is ever shuffled.

The frequent pre-tokens are found in all texts: a task keeps a bounded summary
of counts, and summaries meet in groups of ``FAN`` until one is left. A summary
may lose the count of a rare pre-token; that costs time, never a right count.

Texts are cut into units at spaces before a character that is not white space,
where no pre-token crosses; distinct units of a batch are cut once.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoder import text_batches
from .shared import binary_column, columns, input_bytes, pack_texts, unpack_texts

ENTRIES = 1 << 16  # pre-tokens of the broadcast table
LONGEST = 64  # bytes of a pre-token in it: with ENTRIES the bound of its size, about 7 MB
SUMMARY = 1 << 14  # pre-tokens of a task's summary
FAN = 64  # summaries that one task joins
KEEP = 400_000  # pre-tokens of each half of a worker's cache
BATCH = 8 << 20

LOOSE = r" ([\t\n\x0b\x0c\r\x{85}\p{Z}]|\z)"
BEFORE_WORD = r" ([^\t\n\x0b\x0c\r\x{85}\p{Z}])"
#: Runs that are a pre-token each wherever they stand in a unit: letters of blocks that no version of Unicode has changed, digits, marks, a line feed.
RUN = r"( ?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+| ?[0-9]+| ?[!-&(-/:-@\[-`{-~]+|\n)"
PLAIN = r"^ ?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}0-9!-&(-/:-@\[-`{-~]+(\n[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}0-9!-&(-/:-@\[-`{-~]+)*$"
PRIVATE = range(0xE000, 0xF8FF)


@dataclass(frozen=True)
class LengthTable:
    """Lengths of pre-tokens by open addressing; hits are compared by bytes."""

    hashes: np.ndarray  # 0: a free slot
    entry: np.ndarray
    begins: np.ndarray
    blob: bytes
    lengths: np.ndarray

    @staticmethod
    def of(tokens: list[bytes], lengths: list[int]) -> LengthTable:
        size = 2 << max(4, (len(tokens) - 1).bit_length() if tokens else 0)
        hashes, entry = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        for i, (token, h) in enumerate(zip(tokens, _hashes(tokens).tolist(), strict=True)):
            at = h & size - 1
            while hashes[at]:
                at = at + 1 & size - 1
            hashes[at], entry[at] = h, i
        begins = np.r_[0, np.fromiter(map(len, tokens), np.int64, len(tokens)).cumsum()].astype(np.int32)
        return LengthTable(hashes, entry, begins, b"".join(tokens), np.array(lengths, np.int32))

    def find(self, tokens: list[bytes]) -> np.ndarray:
        """The length of each token, or -1."""
        h = _hashes(tokens)
        out, left, step = np.full(len(tokens), -1, np.int64), np.arange(len(tokens)), 0
        mask = np.uint64(len(self.hashes) - 1)
        begins, blob = self.begins.tolist(), self.blob
        while len(left):
            at = ((h[left] + np.uint64(step)) & mask).astype(np.int64)
            seen = self.hashes[at]
            for i, e in zip(left[seen == h[left]].tolist(), self.entry[at[seen == h[left]]].tolist(), strict=True):
                if blob[begins[e]: begins[e + 1]] == tokens[i]:
                    out[i] = self.lengths[e]
            left, step = left[(seen != 0) & (out[left] < 0)], step + 1
        return out


def _hashes(tokens: list[bytes]) -> np.ndarray:
    found = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, tokens)), ">u8").astype(np.uint64)
    return np.maximum(found, np.uint64(1))


class Cutter:
    """Texts as pre-tokens, by the vocabulary's own pre-tokenizer."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if type(self.library.pre_tokenizer).__name__ != "ByteLevel" or self.library.normalizer is not None or self.library.pre_tokenizer.add_prefix_space:
            raise ValueError("counts by pre-token need a byte-level vocabulary without normaliser and prefix space")
        added = self.library.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("an added token of this vocabulary takes its surroundings in")
        self.added = sorted((t.content for t in added), key=len, reverse=True)

    def segments(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The texts cut at strings of added tokens, each segment's text, and how many such strings each text has."""
        n, owner = len(texts), np.arange(len(texts))
        marks = np.zeros(n, np.int64)
        if len(self.added) > 1:  # the library takes the first match, of several the longest
            pattern = re.compile("|".join(map(re.escape, self.added)))
            cut = [pattern.split(t) for t in texts.to_pylist()]
        elif self.added and pc.any(pc.match_substring(texts, self.added[0])).as_py():
            cut = pc.split_pattern(texts, self.added[0])
        else:
            return texts, owner, marks
        lists = pa.array(cut, pa.list_(pa.string())) if isinstance(cut, list) else cut
        sizes = np.asarray(pc.list_value_length(lists), np.int64)
        return lists.flatten(), np.repeat(owner, sizes), sizes - 1

    def units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct units, the unit at each place of all texts one after the other, and how many places each text has."""
        loose = pc.match_substring_regex(texts, LOOSE)
        spaced = pc.if_else(loose, "", texts)
        lists = pc.split_pattern(spaced, " ")
        sizes = np.asarray(pc.list_value_length(lists), np.int64)
        coded = lists.flatten().dictionary_encode()
        codes = np.asarray(coded.indices, np.int64)
        head = np.zeros(len(codes), bool)  # a text's first unit has no space before it
        head[sizes.cumsum() - sizes] = True
        keys = 2 * codes + head
        seen = np.zeros(2 * len(coded.dictionary), bool)
        seen[keys] = True
        used = np.flatnonzero(seen)
        number = np.zeros(len(seen), np.int64)
        number[used] = np.arange(len(used))
        words = coded.dictionary.take(pa.array(used // 2))
        units = pc.binary_join_element_wise(pa.array(np.where(used % 2, "", " ").astype(object), pa.string()), words, "")
        places = number[keys]
        odd = np.flatnonzero(np.asarray(loose.to_pylist(), bool))
        if not len(odd):
            return units, places, sizes
        rest = texts.take(pa.array(odd))
        mark = next((chr(c) for c in PRIVATE if not pc.any(pc.match_substring(rest, chr(c))).as_py()), None)
        if mark is None:
            raise ValueError("a batch of texts holds every character of the private use area")
        more = pc.split_pattern(pc.replace_substring_regex(rest, BEFORE_WORD, mark + r" \1"), mark)
        own = np.asarray(pc.list_value_length(more), np.int64)
        coded = more.flatten().dictionary_encode()
        others = len(units) + np.asarray(coded.indices, np.int64)
        count = sizes.copy()
        count[odd] = own  # a loose text stands for one empty unit above
        first = count.cumsum() - count
        out = np.zeros(int(count.sum()), np.int64)
        inside = np.zeros(len(out) + 1, np.int64)
        inside[first[odd]] += 1
        np.add.at(inside, first[odd] + own, -1)
        mine = inside[:-1].cumsum() > 0
        out[mine] = others
        plain = np.ones(len(places), bool)
        plain[(sizes.cumsum() - sizes)[odd]] = False
        out[~mine] = places[plain]
        return pa.concat_arrays([units, coded.dictionary]), out, count

    def pretokens(self, units: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pre-tokens of all units one after the other, and how many each unit has."""
        plain = np.asarray(pc.match_substring_regex(units, PLAIN).to_pylist(), bool)
        at = np.flatnonzero(plain)
        runs = pc.split_pattern(pc.replace_substring_regex(units.take(pa.array(at)), RUN, "\\1\0"), "\0")
        sizes = np.zeros(len(units), np.int64)
        sizes[at] = np.asarray(pc.list_value_length(runs), np.int64) - 1  # each run is followed by a mark
        flat = runs.flatten()
        flat = flat.filter(pc.not_equal(flat, ""))
        cut, others, rest = self.library.pre_tokenizer.pre_tokenize_str, [], np.flatnonzero(~plain)
        for i, unit in zip(rest.tolist(), units.take(pa.array(rest)).to_pylist(), strict=True):
            before = len(others)
            others += [unit[a:b] for _, (a, b) in cut(unit)]
            sizes[i] = len(others) - before
        order = np.argsort(np.r_[np.repeat(at, sizes[at]), np.repeat(rest, sizes[rest])], kind="stable")
        return pa.concat_arrays([flat, pa.array(others, pa.string())]).take(pa.array(order)), sizes


class Counter:
    """Counts texts' tokens with a table and a cache of two halves: the older is dropped when the younger is full."""

    def __init__(self, cutter: Cutter, table: LengthTable, keep: int = KEEP) -> None:
        self.cutter, self.table, self.keep = cutter, table, keep
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def lengths(self, tokens: list[str]) -> np.ndarray:
        """Lengths of distinct pre-tokens."""
        out = self.table.find([t.encode() for t in tokens])
        misses = []
        for i in np.flatnonzero(out < 0).tolist():
            known = self.young.get(tokens[i])
            if known is None:
                known = self.old.get(tokens[i])
                if known is None:
                    misses.append(i)
                    continue
                self.young[tokens[i]] = known
            out[i] = known
        for at in range(0, len(misses), 10_000):
            part = misses[at: at + 10_000]
            texts = [tokens[i] for i in part]
            sizes = [len(e.ids) for e in self.cutter.library.encode_batch_fast(texts, add_special_tokens=False)]
            out[part] = sizes
            if len(self.young) > self.keep:
                self.old, self.young = self.young, {}
            self.young.update(zip(texts, sizes, strict=True))
        return out

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        segments, owner, marks = self.cutter.segments(texts)
        units, places, sizes = self.cutter.units(segments)
        tokens, own = self.cutter.pretokens(units)
        coded = tokens.dictionary_encode()
        each = self.lengths(coded.dictionary.to_pylist())[np.asarray(coded.indices, np.int64)]
        total = np.r_[0, each.cumsum()]
        ends = own.cumsum()
        per_unit = total[ends] - total[ends - own]
        running = np.r_[0, per_unit[places].cumsum()]
        stop = sizes.cumsum()
        out = marks.copy()
        np.add.at(out, owner, running[stop] - running[stop - sizes])
        return out


def _trimmed(counts: dict[str, int], most: int) -> dict[str, int]:
    """The ``most`` largest counts; of equal ones the first by text."""
    if len(counts) <= most:
        return counts
    return dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:most])


def _summary_row(number: int, counts: dict[str, int], most: int) -> pa.RecordBatch:
    kept = _trimmed(counts, most)
    return pa.record_batch([pa.array([number], pa.int64()), binary_column([pack_texts([t.encode() for t in kept])]), binary_column([np.array(list(kept.values()), np.int64).tobytes()])],
                           ["number", "tokens", "counts"])


def frequent_table(docs: DataFrame, path: str, entries: int = ENTRIES) -> LengthTable:
    """The table of the most frequent pre-tokens of all texts with their lengths; one row of bounded size reaches the driver."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, counts = Cutter(path), {}
        for batch in text_batches(batches, 0, BATCH):
            units, places, _ = cutter.units(batch.column(0).fill_null(""))
            often = np.bincount(places, minlength=len(units))
            tokens, own = cutter.pretokens(units)
            coded = tokens.dictionary_encode()
            total = np.bincount(np.asarray(coded.indices, np.int64), np.repeat(often, own), len(coded.dictionary)).astype(np.int64)
            short = pc.less_equal(pc.binary_length(coded.dictionary), LONGEST)
            for token, n in zip(coded.dictionary.filter(short).to_pylist(), total[np.asarray(short.to_pylist(), bool)].tolist(), strict=True):
                counts[token] = counts.get(token, 0) + n
            if len(counts) > 16 * SUMMARY:
                counts = _trimmed(counts, 4 * SUMMARY)
        if counts:
            yield _summary_row(TaskContext.get().partitionId(), counts, SUMMARY)

    def join(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        for batch in batches:
            for tokens, often in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for token, n in zip(unpack_texts(tokens), np.frombuffer(often, np.int64).tolist(), strict=True):
                    token = token.decode()
                    counts[token] = counts.get(token, 0) + n
                if len(counts) > 4 * most:
                    counts = _trimmed(counts, 2 * most)
        if counts:
            yield _summary_row(TaskContext.get().partitionId(), counts, most)

    kinds = "number long, tokens binary, counts binary"
    found = columns(docs, "text").mapInArrow(local, kinds)
    tasks = max(1, input_bytes(docs) >> 20)  # at most: a task reads a MB or more
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        found = found.repartitionById(tasks, F.pmod("number", F.lit(tasks)).cast("int")).mapInArrow(lambda b: join(b, entries), kinds)
    last = found.repartition(1).mapInArrow(lambda b: join(b, entries), kinds).collect()
    tokens = [t for row in last for t in unpack_texts(bytes(row["tokens"]))]
    cutter = Cutter(path)
    return LengthTable.of(tokens, [len(e.ids) for e in cutter.library.encode_batch_fast([t.decode() for t in tokens], add_special_tokens=False)])


_READY: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 512, entries: int = ENTRIES) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` (more tokens than ``limit``).

    Counts are those of the tokenizers library with its defaults: without begin
    and end tokens, and a string of an added token inside a text is that token.
    Null and empty texts have no bytes and no tokens; rows without doc_id and
    repeated rows are counted each. Very long texts are a batch of their own.
    Other columns are ignored; an empty table gives an empty result. Vocabularies
    whose pre-tokens depend on more than the text (a normaliser, a prefix space) are refused.
    """
    docs = columns(docs, "doc_id", "text")
    table, key = docs.sparkSession.sparkContext.broadcast(frequent_table(docs, path, entries)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _READY:
            _READY.clear()
            _READY[key] = Counter(Cutter(path), table.value)
        for batch in text_batches(batches, 1, BATCH):
            texts = batch.column(1).fill_null("")
            counts = _READY[key].count(texts)
            yield pa.record_batch([batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(counts), pa.array(counts > limit)],
                                  ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
