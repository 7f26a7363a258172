"""Conversation repair of least cost, by cost layers over grammar states.

A repaired conversation's role initials are ``(s?(ua)+)?``. Its automaton has four
states: nothing yet, after s, after u, after a. For each place between turns a
bitset says which states can still be accepted from there, a nibble for each
increasing cost (Wu and Manber's layers of errors, from the last turn to the
first). A row shifts the layers by what its edits cost: keeping 0, rerole 2,
deletion 3, and one more for a truncated row that stays; insertions (2) close
the set. Costs of states that can be accepted differ by less than ``LAYERS``, so a
place keeps that many layers above its cheapest one, and steps are looked up.
The first accepting layer is the cost; following set bits from the first
place, the ASCII-least letter first, is the least audit of that cost.

Most conversations lie within one task and are repaired there. Those that
a task's range of rows begins or ends in, and very long ones, are left in parts
of bounded size: a part's costs between states are a 4 x 4 table, the tables of
a conversation meet in one scan of a few numbers for each part, every part is
then traced from each state at once, and the traces that fit are joined.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .encoder import text_batches
from .shared import columns, cut, parts_for

LAYERS = 16
NIBBLES = (1 << 4 * LAYERS) - 1
EVERY = NIBBLES // 15  # bit 0 of each layer
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTS = 1 << START | 1 << ASSISTANT
#: From which states an initial may follow, and where it leads.
BEFORE = {"s": (1 << START, SYSTEM), "u": (1 << START | 1 << SYSTEM | 1 << ASSISTANT, USER), "a": (1 << USER, ASSISTANT)}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # what an inserted or reroled turn makes of a state
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
FAR = 1 << 40
PART_ROWS, PART_BYTES = 512, 64 << 10  # Parquet's reader holds some thousand parts at a time
BLANK = re.compile(r"[^\x20\x09-\x0D]")
END = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")


def spread(layers: int, state: int, onto: int) -> int:
    """Per layer: the states ``onto``, where ``state`` is set."""
    return (layers >> state & EVERY) * onto


def turned(layers: int) -> int:
    """Per layer: the states from which an inserted or reroled turn leads to a set one."""
    return spread(layers, *(BEFORE["u"][::-1])) | spread(layers, *(BEFORE["a"][::-1]))


def closed(layers: int) -> int:
    """With what insertions reach."""
    while (more := (layers | turned(layers) << 4 * INSERT) & NIBBLES) != layers:
        layers = more
    return layers


def lowest(layers: int, base: int) -> tuple[int, int]:
    """The layers from the first that is not empty on; those above the kept ones are as the last."""
    while layers and not layers & 15:
        layers, base = layers >> 4 | layers & 15 << 4 * (LAYERS - 1), base + 1
    return layers, base


@cache
def stepped(layers: int, kind: str, truncated: int) -> tuple[int, int]:
    """The layers before a row, given those after it: ``kind`` is its initial if one of s, u, a, "-" if it must go, else "?"."""
    found = layers << 4 * DELETE
    if kind != "-":
        stay = turned(layers) << 4 * REROLE
        if kind in BEFORE:
            before, after = BEFORE[kind]
            stay |= spread(layers, after, before)
        found |= stay << 4 * truncated
    return lowest(closed(found & NIBBLES), 0)


def layers_of(costs: list[int]) -> tuple[int, int]:
    """Layers and base of the cost that each state has (``FAR``: none)."""
    base, out = min(costs), 0
    for state, cost in enumerate(costs):
        if cost - base < LAYERS:
            out |= (EVERY << state) & (NIBBLES << 4 * (cost - base)) & NIBBLES
    return out, base


def costs_of(layers: int, base: int) -> list[int]:
    """The cost of each state (inverse of :func:`layers_of`)."""
    out = []
    for state in range(4):
        bits = layers >> state & EVERY
        out.append(base + ((bits & -bits).bit_length() - 1) // 4 if bits else FAR)
    return out


FINAL = costs_of(*lowest(closed(layers_of([0 if ACCEPTS >> s & 1 else FAR for s in range(4)])[0]), 0))


Code = tuple[str, int]


def backward(codes: list[Code], end: list[int]) -> list[tuple[int, int]]:
    """Layers and base at each place before, between and after the rows, given each state's cost at the end."""
    layers, base = layers_of(end)
    places = [(layers, base)]
    for kind, truncated in reversed(codes):
        layers, more = stepped(layers, kind, truncated)
        base += more
        places.append((layers, base))
    return places[::-1]


def between(codes: list[Code]) -> list[list[int]]:
    """The least cost from each state at the beginning (rows) to each state at the end (columns)."""
    return [list(c) for c in zip(*(costs_of(*backward(codes, [0 if s == t else FAR for s in range(4)])[0]) for t in range(4)), strict=True)]


def trace(codes: list[Code], places: list[tuple[int, int]], state: int, last: bool) -> tuple[str, int]:
    """The least audit from ``state`` on, and the state at its end; insertions at the end belong to the ``last`` part."""
    out, at = [], 0
    cost = costs_of(*places[0])[state]

    def can(place: int, to: int, left: int) -> bool:
        layers, base = places[place]
        return left >= base and bool(layers >> 4 * min(left - base, LAYERS - 1) + to & 1)

    while True:
        kind, truncated = codes[at] if at < len(codes) else ("", 0)
        to = NEXT[state]
        if at < len(codes) and can(at + 1, state, cost - DELETE):
            letter, cost, at = "D", cost - DELETE, at + 1
        elif (at < len(codes) or last) and can(at, to, cost - INSERT):
            letter, cost, state = "I", cost - INSERT, to
        elif at == len(codes):
            return "".join(out), state
        elif kind in BEFORE and BEFORE[kind][0] >> state & 1 and can(at + 1, BEFORE[kind][1], cost - truncated):
            letter, cost, state, at = "K", cost - truncated, BEFORE[kind][1], at + 1
        elif kind != "-" and can(at + 1, to, cost - REROLE - truncated):
            letter, cost, state, at = "R", cost - REROLE - truncated, to, at + 1
        else:
            raise RuntimeError("no edit has the cost that the layers promise")
        out.append(letter)


def repaired(rows: list[tuple[str, str]], audit: str, state: int) -> list[bytes]:
    """The repaired ``role:text`` of each row that stays or is inserted."""
    out, at = [], 0
    for letter in audit:
        if letter == "I":
            state = NEXT[state]
            out.append(f"{ROLE[state]}:".encode())
            continue
        role, text = rows[at]
        at += 1
        if letter == "R":
            state = NEXT[state]
            out.append(f"{ROLE[state]}:{text}".encode())
        elif letter == "K":
            state = BEFORE[role[0]][1]
            out.append(f"{role}:{text}".encode())
    return out


def digest(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


@dataclass
class Part:
    """A run of a conversation's rows after damage: (turn, role, text), by turn."""

    turns: list[int | None] = field(default_factory=list)
    rows: list[tuple[str, str]] = field(default_factory=list)
    size: int = 0

    def faults(self, earlier: set[bytes]) -> tuple[list[Code], list[int]]:
        """A code for each row, and how many are blank, duplicate and truncated; ``earlier`` parts hold these digests."""
        codes, counts, seen = [], [0, 0, 0], set()
        for role, text in self.rows:
            if not BLANK.search(text):
                counts[0] += 1
                codes.append(("-", 0))
                continue
            own = digest(role, text)
            if own in seen or own in earlier:
                counts[1] += 1
                codes.append(("-", 0))
                continue
            seen.add(own)
            truncated = int(END.search(text)[1] not in ".!?")
            counts[2] += truncated
            codes.append((role[:1] if role[:1] in BEFORE else "?", truncated))
        return codes, counts

    def illegal(self) -> int:
        first = [role[:1] for role, _ in self.rows]
        return sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))

    def numbers(self) -> tuple[int | None, int | None, int]:
        """Smallest, largest and how many distinct turns."""
        own = {t for t in self.turns if t is not None}
        return min(own, default=None), max(own, default=None), len(own)


def gaps(low: int | None, high: int | None, distinct: int) -> int:
    return 0 if low is None else high - low + 1 - distinct


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
PARTS = "part long, turns array<long>, roles array<string>, texts array<string>"
FACTS = "conv_id long, part long, n long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string, costs array<array<long>>"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}

    def kind(name: str) -> pa.DataType:
        return pa.list_(kind(name[6:-1])) if name.startswith("array<") else kinds[name]

    fields = [f.strip().split(" ") for f in schema.split(", ")]
    return pa.record_batch([pa.array([r[i] for r in rows], kind(k)) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def whole(conv: int | None, part: Part) -> tuple:
    """The result of a conversation that is one part."""
    codes, counts = part.faults(set())
    places = backward(codes, FINAL)
    audit, _ = trace(codes, places, START, True)
    text = b"\n".join(repaired(part.rows, audit, START))
    return conv, gaps(*part.numbers()), *counts, part.illegal(), costs_of(*places[0])[START], audit, hashlib.sha256(text).hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage, and how many of each there are (0: dropped, so that its conversation stays known).

    What happens to a row follows from its conv_id and turn alone. A null counts as one space.
    """
    rows = columns(conversations, "conv_id", "turn", "role", "text")

    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(fate.isin(0, 1), "").when(fate == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    role = F.when(fate == 0, "").when(fate == 4, "user").otherwise(filled("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).cast("long").alias("n"))


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch as one, with their number: many copies of one row travel as few."""
    names = ["conv_id", "turn", "role", "text"]
    for batch in batches:
        if batch.num_rows:
            found = pa.Table.from_batches([batch]).group_by(names, use_threads=False).aggregate([("n", "sum")]).rename_columns([*names, "n"])
            yield from found.combine_chunks().to_batches()


def scanned(rows: DataFrame) -> DataFrame:
    """Results of the conversations that lie within a task, and the parts of all others (``part`` is null in results)."""
    keys = ["conv_id", "turn", "role", "text"]
    fewer = rows.mapInArrow(together, rows.schema)
    ranges = [*keys[:3], F.substring("text", 1, 32)]  # begins of texts order as the texts do, and samples of them stay small
    ranged = fewer.repartitionByRange(parts_for(rows), *ranges).sortWithinPartitions(*keys)
    result = ", ".join(RESULT.split(", ")[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        part, conv, first, done, parts = Part(), None, True, [], []

        def left() -> None:
            nonlocal number
            parts.append((conv, *[None] * 8, number, part.turns, [r for r, _ in part.rows], [t for _, t in part.rows]))
            number += 1

        held = 0
        for batch in text_batches(batches, 3, 4 << 20):
            for i, (own, turn, role, text, n) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if held and own != conv:
                    if first:  # a task before may hold the beginning
                        left()
                    else:
                        done.append((*whole(conv, part), *[None] * 4))
                    part, first, held = Part(), False, 0
                conv, held = own, held + 1
                while n > 0:
                    if len(part.rows) >= PART_ROWS or part.size >= PART_BYTES:
                        left()
                        part, first = Part(), True
                    take = min(n, PART_ROWS - len(part.rows))
                    part.turns += [turn] * take
                    part.rows += [(role, text)] * take
                    part.size += len(text)
                    n -= take
                if i % 1000 == 999 and (len(done) > 1000 or len(parts) > 1):
                    yield _batch(done + parts, f"conv_id long, {result}, {PARTS}")
                    done.clear()
                    parts.clear()
        if held:
            left()  # the next task may go on with it
        if done or parts:
            yield _batch(done + parts, f"conv_id long, {result}, {PARTS}")

    return ranged.mapInArrow(run, f"conv_id long, {result}, {PARTS}")


def repeated_in_parts(parts: DataFrame) -> DataFrame:
    """``conv_id``, ``part`` and the digests of its rows that an earlier part of the conversation holds (at most as many as its rows)."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, number, roles, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = {digest(r, t) for r, t in zip(roles, texts, strict=True) if BLANK.search(t)}
                yield _batch([(conv, number, d) for d in found], "conv_id long, part long, digest binary")

    rows = cut(parts.select("conv_id", "part", "roles", "texts").mapInArrow(digests, "conv_id long, part long, digest binary"), "repair-digests")
    first = rows.groupBy("conv_id", "digest").agg(F.min("part").alias("first"), F.count("*").alias("times")).filter("times > 1").toDF("c", "d", "first", "times")
    later = rows.join(first, rows["conv_id"].eqNullSafe(first["c"]) & (rows["digest"] == first["d"]) & (rows["part"] > first["first"]))
    return later.groupBy("conv_id", "part").agg(F.collect_set("digest").alias("earlier")).toDF("c", "p", "earlier")


def joined(parts: DataFrame) -> DataFrame:
    """The results of the conversations that are left in parts."""
    again = repeated_in_parts(parts)
    known = parts.join(again, parts["conv_id"].eqNullSafe(again["c"]) & (parts["part"] == again["p"]), "left").select("conv_id", "part", "turns", "roles", "texts", "earlier")
    known = cut(known, "repair-parts")

    def read(batches: Iterator[pa.RecordBatch], start: int = 0) -> Iterator[tuple]:
        for batch in batches:
            for conv, number, turns, roles, texts, earlier, *more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = Part(turns, list(zip(roles, texts, strict=True)))
                yield conv, number, part, *part.faults(set(earlier or ())), *more

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, number, part, codes, counts in read(batches):
            first = [role[:1] for role, _ in part.rows]
            yield _batch([(conv, number, len(first), *part.numbers(), *counts, part.illegal(), first[0] if first else None, first[-1] if first else None, between(codes))], FACTS)

    facts = cut(known.mapInArrow(describe, FACTS), "repair-facts")
    width = parts_for(facts)

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From each conversation's last part to its first: what each state costs from a part's end on."""
        at, costs = None, None
        for batch in batches:
            out = []
            for conv, number, table in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                last = costs is None or conv != at
                if last:
                    at, costs = conv, FINAL
                out.append((conv, number, costs, last))
                costs = [min(FAR, *(table[s][t] + costs[t] for t in range(4))) for s in range(4)]
            yield _batch(out, "conv_id long, part long, after array<long>, last boolean")

    back = facts.select("conv_id", "part", "costs").repartition(width, "conv_id").sortWithinPartitions("conv_id", F.desc("part"))
    after = back.mapInArrow(ahead, "conv_id long, part long, after array<long>, last boolean").toDF("c", "p", "after", "last")
    TRACES = "conv_id long, part long, audits array<string>, ends array<long>, texts array<binary>, cost long"

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A part's trace and repaired bytes from each state that can be accepted."""
        for conv, number, part, codes, _, ends, last in read(batches):
            places = backward(codes, ends)
            costs = costs_of(*places[0])
            found = [trace(codes, places, s, last) if costs[s] < FAR else ("", s) for s in range(4)]
            texts = [b"\n".join(repaired(part.rows, audit, s)) + b"\n" * any(x != "D" for x in audit) for s, (audit, _) in enumerate(found)]
            yield _batch([(conv, number, [a for a, _ in found], [e for _, e in found], texts, costs[START])], TRACES)

    traces = known.join(after, known["conv_id"].eqNullSafe(after["c"]) & (known["part"] == after["p"])).select("conv_id", "part", "turns", "roles", "texts", "earlier", "after", "last")
    traces = cut(traces.mapInArrow(follow, TRACES), "repair-traces")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A conversation's traces in order, each from where the one before ended; its digest streams."""
        at, state = None, None

        def result() -> pa.RecordBatch:
            return _batch([(at, state[0], "".join(state[2]), state[3].hexdigest())], "conv_id long, cost long, audit string, repaired_sha256 string")

        for batch in batches:
            for conv, _, audits, ends, texts, cost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != at:
                    if state is not None:
                        yield result()
                    at, state = conv, [cost, START, [], hashlib.sha256(), b""]
                s = state[1]
                state[2].append(audits[s])
                if texts[s]:  # the line feed after a part's last turn is written when another turn follows
                    state[3].update(state[4] + texts[s][:-1])
                    state[4] = b"\n"
                state[1] = ends[s]
        if state is not None:
            yield result()

    ordered = traces.repartition(parts_for(traces), "conv_id").sortWithinPartitions("conv_id", "part")
    audits = ordered.mapInArrow(chosen, "conv_id long, cost long, audit string, repaired_sha256 string").toDF("c", "cost", "audit", "repaired_sha256")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A conversation's counts, with the pairs and turns that meet where two parts do."""
        at, state = None, None
        schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long"

        def result() -> pa.RecordBatch:
            low, high, distinct, blank, duplicate, truncated, illegal, _ = state
            return _batch([(at, gaps(low, high, distinct), blank, duplicate, truncated, illegal)], schema)

        for batch in batches:
            for conv, _, n, low, high, turns, blank, duplicate, truncated, illegal, first, last, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != at:
                    if state is not None:
                        yield result()
                    at, state = conv, [None, None, 0, 0, 0, 0, 0, None]
                if not n:
                    continue
                if low is not None:
                    state[2] += turns - (state[1] == low)
                    state[0], state[1] = low if state[0] is None else state[0], high
                for i, x in ((3, blank), (4, duplicate), (5, truncated), (6, illegal)):
                    state[i] += x
                state[6] += state[7] is not None and state[7] + first not in ("su", "ua", "au")
                state[7] = last
        if state is not None:
            yield result()

    counts = facts.repartition(width, "conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(edges, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long")
    return counts.join(audits, counts["conv_id"].eqNullSafe(audits["c"])).select(*[c.split()[0] for c in RESULT.split(", ")])


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conversation, damaged and repaired: the columns of ``RESULT``.

    Rows of equal turn are taken in the order of (role, text) after damage. Rows
    without conv_id are one conversation (conv_id null); null turns come first
    and have no part in gaps; null roles and texts count as one space. Repeated
    rows are duplicates of the first. A conversation that loses all rows
    has zeros, an empty audit and the hash of an empty string. Other columns are
    ignored; an empty table gives an empty result. A long conversation's rows are
    worked on by many tasks; only its digest and audit are joined by one, streaming.
    """
    found = cut(scanned(damaged(conversations)), "repair")
    names = [c.split()[0] for c in RESULT.split(", ")]
    parts = found.filter("part is not null").select("conv_id", "part", "turns", "roles", "texts")
    return found.filter("part is null").select(*names).union(joined(parts))
