"""Whole-text encoding with the tokenizers library, each distinct unit once.

A unit is what lies between two spaces that are each followed by a character
that is not white space, with its leading space. No pre-token of the two JSON
vocabularies crosses such a place, so encoding units apart gives the ids of the
whole text. Arrow splits and numbers the units of a batch; its distinct ones
are looked up in a store that is itself a pair of Arrow arrays, and those not
seen before are cut further into parts (a word and the mark or line feed after
it), of which the library encodes the new ones: joined into long strings, with
a separator of one id between them. No Python object is made for a unit.

A text where a space precedes white space goes to the library whole, unless
the vocabulary drops white space: then every space and line feed is such a place.

Strings of special tokens inside a text are ordinary text, as the description
of the vocabularies has it (``encode_special_tokens``): a document that quotes
an end mark must not end a training sequence.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOOSE = r" ([\t\n\x0b\x0c\r\x{85}\p{Z}]|\z)|\x00"
#: Between a Latin letter that neither normalisation nor lower case turns into several characters, and a mark.
MARK = r"([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}])([.,;:!?]+)"
FEED = r"([^\s\p{Z}\x{85}\x0b])\n([^\s\p{Z}\x{85}\x0b])"
CUT = "\0"
JOIN = 256
SIGNS = "❤★§±|~="
BATCH_BYTES = 12 << 20


def _binary(ids: np.ndarray, ends: np.ndarray, begins: np.ndarray | None = None) -> pa.Array:
    """Slices of ``ids`` as a binary array; without ``begins`` they follow one another."""
    raw = np.ascontiguousarray(ids, np.uint32)
    if begins is not None:
        size = ends - begins
        total = size.cumsum()
        raw = raw[np.repeat(begins - (total - size), size) + np.arange(int(total[-1]) if len(total) else 0)]
        ends = total
    offsets = (4 * np.r_[0, ends]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def regrouped(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    """Consecutive binary values joined, ``sizes`` of them each."""
    values = pa.concat_arrays([values])
    _, offsets, data = values.buffers()
    edges = np.frombuffer(offsets, np.int32, len(values) + 1)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(edges[np.r_[0, sizes.cumsum()]].copy()), data])


class UnitEncoder:
    """Encode texts to uint32 ids, keeping a store of about ``keep`` units: those used last."""

    def __init__(self, path: str, keep: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.spaceless = "Lowercase" in repr(self.library.normalizer)  # lower case, white space only separates
        self.keep = keep
        self.units = pa.array([], pa.string())
        self.ids = pa.array([], pa.binary())
        self.used = np.zeros(0, np.int64)
        self.turn = 0
        self.sign, self.sign_id = self._separator()
        self.feed_id = None if self.spaceless else self._encoded(["\n"])[0].ids[0]

    def _encoded(self, texts: list[str]) -> list:
        return self.library.encode_batch_fast(texts, add_special_tokens=False)

    def _separator(self) -> tuple[str, int]:
        """A character that makes a single id after a space; it tells joined units apart."""
        for sign in SIGNS:
            ids = self._encoded([" " + sign])[0].ids
            if len(ids) == 1:
                return sign, ids[0]
        raise ValueError("no separator in this vocabulary")

    def _alone(self, texts: list[str]) -> pa.Array:
        found = [np.array(e.ids, np.uint32) for e in self._encoded(texts)]
        return _binary(np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64).cumsum())

    def _joined(self, units: pa.Array, before: str, after: str, mark: int) -> pa.Array:
        """Ids of units that each stand between ``before`` and ``after``, which ends in the id ``mark``."""
        out = []
        for i in range(0, len(units), JOIN * 32):
            part = units.slice(i, JOIN * 32)
            edges = pa.array(np.r_[np.arange(0, len(part), JOIN), len(part)].astype(np.int32))
            lines = pc.binary_join(pa.ListArray.from_arrays(edges, pc.binary_join_element_wise(before, part, after, "")), "")
            ids = np.array(list(chain.from_iterable(e.ids for e in self._encoded(lines.to_pylist()))), np.uint32)
            ends = np.flatnonzero(ids == mark)
            if len(ends) != len(part):
                raise RuntimeError("a unit was not encoded apart")
            out.append(_binary(ids, ends, np.r_[0, ends[:-1] + 1]))
        return pa.concat_arrays(out) if out else pa.array([], pa.binary())

    def _spelt(self, parts: pa.Array) -> pa.Array:
        """Ids of distinct parts, by the library."""
        if not len(parts):
            return pa.array([], pa.binary())
        clear = pc.invert(pc.match_substring(parts, self.sign))
        if self.spaceless:
            kinds = [(clear, " ", f" {self.sign}", self.sign_id)]
        else:
            spaced = pc.starts_with(parts, " ")
            bare = pc.and_(pc.invert(spaced), pc.match_substring_regex(parts, r"^[A-Za-z0-9.,;:!?]+$"))
            kinds = [(pc.and_(clear, spaced), "", f" {self.sign}", self.sign_id), (bare, "", "\n", self.feed_id)]
        order, found, rest = [], [], np.ones(len(parts), bool)
        for own, before, after, mark in kinds:
            at = np.flatnonzero(np.asarray(own.to_pylist(), bool))
            order.append(at)
            rest[at] = False
            found.append(self._joined(parts.take(pa.array(at)), before, after, mark))
        order.append(np.flatnonzero(rest))
        found.append(self._alone(parts.filter(pa.array(rest)).to_pylist()))
        return pa.concat_arrays(found).take(pa.array(np.argsort(np.concatenate(order), kind="stable")))

    def _found(self, units: pa.Array) -> np.ndarray:
        """Places of units in the store, or -1."""
        return np.asarray(pc.fill_null(pc.index_in(units, value_set=self.units), -1), np.int64)

    def _known(self, units: pa.Array) -> np.ndarray:
        """Places in the store of distinct units, after those not yet there have been encoded."""
        self.turn += 1
        if len(self.used) > 2 * self.keep:
            last = np.sort(np.argpartition(-self.used, self.keep)[: self.keep])
            self.units, self.ids, self.used = self.units.take(pa.array(last)), self.ids.take(pa.array(last)), self.used[last]
        at = self._found(units)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = units.take(pa.array(missing))
            cut = pc.replace_substring_regex(new, MARK, r"\1" + CUT + r"\2")
            if not self.spaceless:
                cut = pc.replace_substring_regex(cut, FEED, r"\1" + CUT + "\n" + CUT + r"\2")
            lists = pc.split_pattern(cut, CUT)
            sizes = np.asarray(pc.list_value_length(lists), np.int64)
            coded = lists.flatten().dictionary_encode()
            codes = np.asarray(coded.indices, np.int64)
            place = self._found(coded.dictionary)
            fresh = np.flatnonzero(place < 0)
            place[fresh] = len(self.used) + np.arange(len(fresh))
            parts = coded.dictionary.take(pa.array(fresh))
            ids = pa.concat_arrays([self.ids, self._spelt(parts)])
            several = np.flatnonzero(sizes > 1)
            at[missing] = place[codes[sizes.cumsum() - sizes]]
            at[missing[several]] = len(ids) + np.arange(len(several))
            inside = np.repeat(sizes > 1, sizes)
            self.ids = pa.concat_arrays([ids, regrouped(ids.take(pa.array(place[codes[inside]])), sizes[several])])
            self.units = pa.concat_arrays([self.units, parts, new.take(pa.array(several))])
            self.used = np.r_[self.used, np.full(len(self.units) - len(self.used), self.turn)]
        self.used[at] = self.turn
        return at

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, each text's followed by ``end_id``, and the bounds of the texts; null counts as empty."""
        texts = texts.fill_null("")
        n = len(texts)
        if self.spaceless:
            texts = pc.replace_substring(pc.ascii_lower(texts), "\n", " ")
            loose = pc.match_substring(texts, CUT)
        else:
            loose = pc.match_substring_regex(texts, LOOSE)
        whole = np.flatnonzero(np.asarray(loose.to_pylist(), bool))
        lists = pc.split_pattern(pc.if_else(loose, "", texts), " ")
        coded = lists.flatten().dictionary_encode()
        count = np.asarray(pc.list_value_length(lists), np.int64)
        first = count.cumsum() - count
        codes = np.asarray(coded.indices, np.int64)
        units = coded.dictionary
        if not self.spaceless:  # a text's first unit has no leading space
            heads = pc.unique(units.take(pa.array(codes[first])))
            begin = np.asarray(pc.index_in(units.take(pa.array(codes[first])), value_set=heads), np.int64)
            rest, seen = np.ones(len(codes), bool), np.zeros(len(units), bool)
            rest[first] = False
            seen[codes[rest]] = True
            used = np.flatnonzero(seen)
            number = np.zeros(len(units), np.int64)
            number[used] = np.arange(len(used))
            codes = number[codes]
            codes[first] = len(used) + begin
            units = pa.concat_arrays([pc.binary_join_element_wise(" ", units.take(pa.array(used)), ""), heads])
        at = self._known(units)
        k = len(self.ids)
        values = pa.concat_arrays([self.ids, _binary(np.array([end_id], np.uint32), np.array([1])), self._alone(texts.take(pa.array(whole)).to_pylist())])
        codes = at[codes]
        codes[first[whole]] = k + 1 + np.arange(len(whole))
        codes = np.insert(codes, first + count, k)
        out = values.take(pa.array(codes))
        _, offsets, data = out.buffers()
        stop = np.frombuffer(offsets, np.int32, len(codes) + 1) // 4
        return np.frombuffer(data, np.uint32, int(stop[-1])), stop[np.r_[0, first + count + np.arange(1, n + 1)]].astype(np.int64)


def text_batches(batches: Iterator[pa.RecordBatch], column: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, at least a row each."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
        group = (sizes.cumsum() - sizes) // most
        edges = [*np.flatnonzero(np.r_[True, group[1:] != group[:-1]]).tolist(), batch.num_rows] if batch.num_rows else []
        for i, j in zip(edges, edges[1:], strict=False):
            yield batch.slice(i, j - i)


_READY: dict[str, UnitEncoder] = {}


def give_back() -> None:
    """Hand to the system what Arrow and the C library keep of freed memory; a worker's encoder stays."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


def forget() -> None:
    """Drop the worker's encoder, where a stage needs the memory for other things, and give back what Arrow keeps unused."""
    _READY.clear()
    pa.default_memory_pool().release_unused()


def encoder(path: str) -> UnitEncoder:
    """The worker's encoder for a vocabulary file; tasks of one worker share its store."""
    if path not in _READY:
        _READY.clear()
        _READY[path] = UnitEncoder(path)
    return _READY[path]
