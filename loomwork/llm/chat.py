r"""Chat formatting by columnar byte assembly.

A turn becomes ``### role: text</turn>`` and a line feed. Inside texts the
backslash, and the first character of each control string (``###``, ``</turn>``),
are preceded by a backslash; roles escape the colon too. Taking each
backslash away and keeping the character after it gives the text back.

A batch of turns is assembled without a loop over turns: segment lengths (header,
text, end) are summed to offsets, offsets become gather indices, and one
take copies all bytes into a preallocated Arrow buffer. The loss mask is kept
as byte spans of the escaped assistant texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .encoder import text_batches
from .shared import columns, new_path, parts_for

HEAD, COLON, END = b"### ", b": ", b"</turn>\n"
IN_TEXT = re.compile(rb"\\|#(?=##)|<(?=/turn>)")
IN_ROLE = re.compile(rb"\\|#(?=##)|<(?=/turn>)|:")
ESCAPED = re.compile(rb"\\(.)", re.DOTALL)
TURN = re.compile(rb"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)
LEARNT = "assistant"
FORMAT_BYTES = 4 << 20  # of text that is assembled at a time; its indices take sixteen times as much
PARTS = "conv_id long, part long, n_turns long, formatted string, loss_spans array<array<long>>"


def escape(text: bytes) -> bytes:
    return IN_TEXT.sub(rb"\\\g<0>", text)


def unescape(text: bytes) -> bytes:
    return ESCAPED.sub(rb"\1", text)


def header(role: str) -> bytes:
    return HEAD + IN_ROLE.sub(rb"\\\g<0>", role.encode()) + COLON


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray]:
    """The formatted bytes of the turns one after the other; where each turn begins (and the end); each text's span."""
    texts = texts.fill_null("").cast(pa.binary())
    control = pc.match_substring_regex(texts, r"\\|###|</turn>")
    if pc.any(control).as_py():
        texts = pc.replace_with_mask(texts, control, pa.array([escape(t) for t in texts.filter(control).to_pylist()], pa.binary()))
    texts = pa.concat_arrays([texts])  # offsets from 0
    n = len(texts)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32, n + 1, 4 * texts.offset).astype(np.int64)
    coded = pc.dictionary_encode(roles.fill_null(""))
    kinds = np.asarray(coded.indices, np.int64)
    heads = [header(r) for r in coded.dictionary.to_pylist()]
    head_size = np.array([len(h) for h in heads], np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    source = np.concatenate([np.frombuffer(b"".join([*heads, END]), np.uint8), body])
    fixed = int(head_size.sum())
    begin = np.stack([(head_size.cumsum() - head_size)[kinds], fixed + len(END) + bounds[:-1], np.full(n, fixed)], axis=1).ravel()
    size = np.stack([head_size[kinds], np.diff(bounds), np.full(n, len(END))], axis=1).ravel()
    stop = size.cumsum()
    total = int(stop[-1]) if n else 0
    out = pa.allocate_buffer(total)
    np.take(source, np.repeat(begin - (stop - size), size) + np.arange(total), out=np.frombuffer(out, np.uint8), mode="clip")
    starts = np.r_[0, stop[2::3]]
    return out, starts, np.stack([stop[0::3], stop[1::3]], axis=1)


def format_conversations(turns: DataFrame) -> DataFrame:
    """Format ``turns(conv_id, turn, role, text)`` into parts of conversations.

    Turns are ordered by (turn, role, text), nulls first. Null roles and texts count as
    empty. Rows without conv_id form a conversation of their own; repeated
    rows stay. The turns are dealt out by ranges of (conv_id, turn), so a
    very long conversation is formatted by several tasks; it has several
    parts, ascending in ``part``. ``loss_spans`` holds byte spans [begin, end)
    of the escaped assistant texts in ``formatted``. Other columns are ignored;
    an empty table gives an empty result.
    """
    keys = ["conv_id", "turn", "role", "text"]
    turns = columns(turns, *keys)
    ranged = turns.repartitionByRange(parts_for(turns), *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for batch in text_batches(batches, 3, FORMAT_BYTES):
            buffer, starts, spans = assemble(batch.column(2), batch.column(3))
            has = np.asarray(batch.column(0).is_valid().to_pylist(), bool)
            conv = np.asarray(batch.column(0).fill_null(0), np.int64)
            first = np.flatnonzero(np.r_[True, (conv[1:] != conv[:-1]) | (has[1:] != has[:-1])])
            last = np.r_[first[1:], len(conv)]
            edges = np.r_[starts[first], starts[-1]]
            learnt = np.asarray(pc.fill_null(pc.equal(batch.column(2), LEARNT), False).to_pylist(), bool)
            own = np.flatnonzero(learnt)
            base = np.repeat(starts[first], last - first)
            spans = (spans - base[:, None])[own]
            cuts = np.searchsorted(own, first)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[cuts, len(own)].astype(np.int32)), pa.ListArray.from_arrays(
                pa.array(np.arange(0, 2 * len(own) + 1, 2, dtype=np.int32)), pa.array(spans.ravel())))
            formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(edges.astype(np.int32).tobytes()), buffer)
            yield pa.record_batch([
                pa.array(conv[first], mask=~has[first]), pa.array(part + np.arange(len(first))), pa.array(last - first), formatted, lists,
            ], [c.split()[0] for c in PARTS.split(", ")])
            part += len(first)

    return ranged.mapInArrow(run, PARTS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(parts: DataFrame) -> DataFrame:
    """Parse formatted parts again and digest each conversation: the columns of ``DIGESTS``.

    A conversation's parts stream through in order, with a running digest as the
    only state. SHA-256 is sequential, so one conversation's digest is one task's
    work however long it is (rows without conv_id are one conversation).
    """
    ordered = parts.repartition(parts_for(parts), "conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, done = None, None, []
        for batch in text_batches(batches, 3, FORMAT_BYTES):
            for conv, n, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n_turns", "formatted", "loss_spans")), strict=True):
                if state is None or conv != at:
                    if state is not None:
                        done.append(_digest(at, state))
                    at, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                raw, end = text.encode(), 0
                for turn in TURN.finditer(raw):
                    if turn.start() != end:
                        raise ValueError(f"conversation {conv}: no turn at byte {end}")
                    end = turn.end()
                    state[0] += 1
                    state[1].update(unescape(turn[1]) + b"\n" + unescape(turn[2]) + b"\n")
                if end != len(raw):
                    raise ValueError(f"conversation {conv}: no turn at byte {end}")
                for i, j in spans:
                    learnt = unescape(raw[i:j])
                    state[2] += len(learnt.decode())
                    state[3].update(learnt)
                state[4] += len(text)
            if len(done) > 1000:
                yield _digests(done)
                done = []
        if state is not None:
            done.append(_digest(at, state))
        if done:
            yield _digests(done)

    return ordered.mapInArrow(run, DIGESTS)


def _digest(conv: int | None, state: list) -> tuple:
    return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]


def _digests(done: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], [c.split()[0] for c in DIGESTS.split(", ")])


def write_formatted(turns: DataFrame) -> DataFrame:
    """Write the formatted parts into the shared folder and return the table that reads them."""
    path = new_path(turns.sparkSession, "chat")
    format_conversations(turns).write.parquet(path)
    return turns.sparkSession.read.schema(PARTS).parquet(path)
