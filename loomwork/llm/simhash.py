"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2h bits exactly if some 64-bit value lies
within h bits of both. So every distinct fingerprint emits its ball of radius
h (2,081 variants for h = 2), equal variants meet, and colliding fingerprints
are linked. All that meet at one variant are within 2h of each other by the
triangle inequality, so a star to the smallest of them carries every link of
the group; no pairs within a group are listed.

The ball is shuffled in compressed form. A variant belongs to the bucket named
by its leading bits, and the ball around a fingerprint touches only the buckets
within h bits of its own prefix (37 for 8 bits). The fingerprint travels once
to each of these, and the bucket unfolds just the variants that are its own.
Inside a bucket the same split goes on, bit group by bit group, until at most
``unfold`` variants are in memory at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .encoder import forget
from .shared import binary_column, columns, cut, discard, fixed, fresh, local_roots, mix64, slices, text_bytes, words_of

SEED = 42


def shingle_hashes(text: bytes, width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every ``width``-word shingle of the A-Z-lowered text, big-endian bytes (n, 8).

    A text of fewer words is one shingle; a text without words has none.
    """
    words = words_of(text.lower())
    n = len(words)
    if not n:
        return np.zeros((0, 8), np.uint8)
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if n <= width:
        return np.frombuffer(digest(joined, seed), np.uint8).reshape(1, 8)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = sizes.cumsum() + np.arange(n)
    begins = (ends - sizes)[: n - width + 1].tolist()
    return np.frombuffer(
        b"".join([digest(joined[i:j], seed) for i, j in zip(begins, ends[width - 1:].tolist(), strict=True)]), np.uint8
    ).reshape(-1, 8)


def majority(hashes: np.ndarray) -> bytes:
    """The 8 bytes whose bits are set in over half of the hashes (none: zero)."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        total += np.unpackbits(hashes[at: at + (1 << 14)], axis=1).sum(axis=0, dtype=np.uint16)
    return np.packbits(total * 2 > len(hashes)).tobytes()


def simhash(text: bytes, width: int, seed: int = SEED) -> bytes:
    return majority(shingle_hashes(text, width, seed))


def fingerprints(docs: DataFrame, width: int, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``fp`` (the 64 bits as a signed long) of every whole text; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = b"".join(simhash(t, width, seed) for t in text_bytes(batch.column(1)))
            values = np.frombuffer(fps, ">u8").astype(np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(values)], ["doc_id", "fp"])

    return columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def masks(bits: int, radius: int) -> np.ndarray:
    """All values with at most ``radius`` of the low ``bits`` bits set, by ascending weight."""
    out = [sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(range(bits), k)]
    return np.array(out, np.uint64)


def meetings(keys: np.ndarray, index: np.ndarray, slack: np.ndarray, low: int, unfold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(variant, index) of the keys whose variants meet, by ascending variant and index.

    ``slack`` is what is left of each key's half radius on its ``low`` low bits.
    """
    if len(keys) < 2:
        return
    sizes = np.array([len(masks(low, r)) if low else 1 for r in range(int(slack.max()) + 1)])
    if sizes[slack].sum() > unfold and low > 0:
        step = min(4, low)
        group = ((keys >> np.uint64(low - step)) & np.uint64((1 << step) - 1)).astype(np.int64)
        for value in range(1 << step):
            left = slack - np.bitwise_count(group ^ value)
            ours = left >= 0
            yield from meetings(keys[ours], index[ours], left[ours], low - step, unfold)
        return
    keep = np.uint64((1 << low) - 1)
    owners, variants = [], []
    for r in range(len(sizes)):
        own = np.flatnonzero(slack == r)
        if len(own):
            ball = masks(low, r)
            owners.append(np.repeat(own, len(ball)))
            variants.append(((keys[own] & keep)[:, None] ^ ball[None, :]).ravel())
    owner, variant = np.concatenate(owners), np.concatenate(variants)
    ordered = np.sort(variant)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return
    seen = np.zeros(1 << 20, bool)  # most variants stand alone: a bitmap of the repeated ones sheds them
    seen[(mix64(twice) >> np.uint64(44)).astype(np.int64)] = True
    some = np.flatnonzero(seen[(mix64(variant) >> np.uint64(44)).astype(np.int64)])
    variant, member = variant[some], index[owner[some]]
    order = np.lexsort((member, variant))
    yield variant[order], member[order]


def collisions(fps: np.ndarray, slack: np.ndarray, low: int, unfold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stars (smallest, member) of the fingerprints whose variants meet; ``fps`` ascend."""
    for variant, member in meetings(fps, np.arange(len(fps)), slack, low, unfold):
        first = np.flatnonzero(np.r_[True, variant[1:] != variant[:-1]])
        smallest = np.repeat(member[first], np.diff(np.r_[first, len(variant)]))
        real = smallest != member
        if real.any():
            pairs = np.unique(np.stack([smallest[real], member[real]]), axis=1)
            yield fps[pairs[0]], fps[pairs[1]]


BUCKET_BYTES = 32 << 20


def prefix_for(total: int, bits: int, half: int, least: int) -> int:
    """How many leading bits name a bucket, so that the rows sent to one hold about ``BUCKET_BYTES`` of all ``total`` bytes."""
    prefix = least
    while prefix < bits - 8 and len(masks(prefix, half)) * total > BUCKET_BYTES << prefix:
        prefix += 1
    return prefix


def by_prefix(home: np.ndarray, near: np.ndarray, rows: np.ndarray, first_bucket: int = 0) -> pa.RecordBatch:
    """``rows`` as one blob per bucket within reach of each row's own prefix ``home``."""
    to = (home[:, None] ^ near[None, :]).ravel()
    order = np.argsort(to, kind="stable")
    at = to[order]
    buckets, first = np.unique(at, return_index=True)
    sent = order // len(near)
    blobs = [rows[sent[i:j]].tobytes() for i, j in zip(first.tolist(), [*first[1:].tolist(), len(at)], strict=True)]
    return pa.record_batch([pa.array(first_bucket + buckets), binary_column(blobs)], ["bucket", "rows"])


def bucketed(sent: DataFrame, buckets: int, total: int) -> DataFrame:
    """``sent(bucket, rows)`` with a bucket's rows one after the other; a task may have several buckets, one in memory at a time."""
    return sent.repartition(bucket_tasks(sent, buckets, total), "bucket").sortWithinPartitions("bucket")


def bucket_tasks(sent: DataFrame, buckets: int, total: int) -> int:
    width = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(buckets, max(width, buckets // 4 if buckets <= 1024 else 256, -(-total // BUCKET_BYTES)))


def each_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, all its rows' words) of rows that are sorted by bucket."""
    at, held = None, []
    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if bucket != at:
                if held:
                    yield at, np.frombuffer(b"".join(held), np.uint64)
                at, held = bucket, []
            held.append(blob)
    if held:
        yield at, np.frombuffer(b"".join(held), np.uint64)


def ball_links(distinct: DataFrame, radius: int, unfold: int = 1 << 21) -> DataFrame:
    """Links ``a``, ``b`` that connect all fingerprints within ``radius`` bits of one another.

    ``distinct`` has a long column ``fp`` without repeats. Each bucket returns
    the spanning stars of what it found, so at most as many rows as fingerprints
    that it was sent. Links are verified: no link spans more than ``radius`` bits.
    ``radius`` must be even (half of it is the ball's). The number of buckets
    follows the number of fingerprints, so a bucket fits in memory at any size.
    """
    if radius % 2 or radius < 0:
        raise ValueError("the radius must be even")
    half, total = radius // 2, 8 * distinct.count()
    prefix = prefix_for(total, 64, half, 8)
    near = masks(prefix, half).astype(np.int64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max(64, (1 << 22) // len(near))):
            fps = np.asarray(batch.column(0)).view(np.uint64)
            if len(fps):
                yield by_prefix((fps >> np.uint64(64 - prefix)).astype(np.int64), near, fps)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, fps in each_bucket(batches):
            fps = np.unique(fps)
            slack = half - np.bitwise_count((fps >> np.uint64(64 - prefix)).astype(np.int64) ^ bucket).astype(np.int64)
            found = list(collisions(fps, slack, 64 - prefix, unfold))
            if not found:
                continue
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            true = np.bitwise_count(a ^ b) <= radius
            if true.any():
                vertex, root = local_roots(a[true], b[true])
                own = vertex != root
                yield pa.record_batch(
                    [pa.array(root[own].view(np.int64)), pa.array(vertex[own].view(np.int64))], ["a", "b"])

    sent = columns(distinct, "fp").mapInArrow(send, "bucket long, rows binary")
    return bucketed(sent, 1 << prefix, len(near) * total).mapInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, radius: int = 4, seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest doc_id that is reachable over fingerprints
    at most ``radius`` bits apart, the document's own included.

    Null and empty texts have fingerprint zero and are linked like any other.
    A row without doc_id keeps its fingerprint and gets the smallest doc_id
    of its component (null if that has none). Repeated rows each return a row.
    Other columns are ignored. An empty table gives an empty result.
    """
    prints = cut(fingerprints(docs, width, seed), "simhash-fp")
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    links = cut(ball_links(distinct, radius), "simhash-links")
    roots = connected_components(links)
    discard(links)
    joined = distinct.join(roots, distinct["fp"] == roots["v"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = cut(joined.join(lowest, "root").select("fp", "component_id"), "simhash-labels")
    return prints.join(labels, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")



LANES = 4
TABLES = 6  # 32-bit tables, the halves of the first three lanes


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    return np.unique(shingle_hashes(text, width).view(">u8").ravel().astype(np.uint64))


def wide_simhash(shingles: np.ndarray) -> bytes:
    """256 majority bits over a set of shingles, each counted once: its hash is mixed anew for each 64-bit lane."""
    lanes = [mix64(shingles + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) for k in range(LANES)]
    return b"".join(majority(lane.astype(">u8").view(np.uint8).reshape(-1, 8)) for lane in lanes)


def estimated_bits(similarity: float) -> float:
    """Expected differing bits of 256 for two shingle sets of equal size with this Jaccard similarity."""
    return 64 * LANES * float(np.arccos(2 * similarity / (1 + similarity))) / np.pi


def bit_limits(similarity: float) -> tuple[int, int]:
    """(tight, loose): the expected differing bits at ``similarity``, less 1.5 and plus 3 standard deviations."""
    bits = estimated_bits(similarity)
    deviation = float(np.sqrt(bits * (1 - bits / (64 * LANES))))
    return int(bits - 1.5 * deviation), int(bits + 3 * deviation)


class Groups:
    """Union-find over 0 to n - 1, a batch of edges at a time; the smallest member names its group."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        root = self.parent[x]
        while not np.array_equal(up := self.parent[root], root):
            root = up
        self.parent[x] = root
        return root

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            vertex, root = local_roots(self.find(a), self.find(b))
            self.parent[vertex] = root


def spanning(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Which of the edges a-b make a spanning forest of least weight (Boruvka; the earlier of equal edges)."""
    order = np.argsort(weight, kind="stable")
    a, b, groups, chosen = a[order], b[order], Groups(n), []
    left = np.arange(len(a))
    while len(left):
        u, v = groups.find(a[left]), groups.find(b[left])
        apart = u != v
        left, u, v = left[apart], u[apart], v[apart]
        if not len(left):
            break
        best = np.full(n, len(a))
        np.minimum.at(best, u, left)
        np.minimum.at(best, v, left)
        new = np.unique(best[best < len(a)])
        chosen.append(new)
        groups.union(a[new], b[new])
    return order[np.concatenate(chosen)] if chosen else order[:0]


class Forest:
    """The pairs of a bucket within ``loose`` bits, kept as a spanning forest of fewest bits.

    ``tight`` groups what is connected by pairs of at most the tight limit; a
    pair inside such a group need not be looked at, as every other way between
    its ends is shorter.
    """

    def __init__(self, n: int, tight: int, loose: int, pending: int = 1 << 21):
        self.n, self.least, self.loose, self.pending = n, tight, loose, pending
        self.tight = Groups(n)
        self.held = [(np.zeros(0, np.int64),) * 3]
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray, bits: np.ndarray) -> None:
        own = (bits <= self.loose) & (a != b)
        a, b, bits = a[own], b[own], bits[own].astype(np.int64)
        if len(a):
            near = bits <= self.least
            self.tight.union(a[near], b[near])
            self.held.append((a, b, bits))
            self.size += len(a)
            if self.size > self.pending:
                self.edges()

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        a, b, bits = (np.concatenate(x) for x in zip(*self.held, strict=True))
        stay = spanning(self.n, a, b, bits)
        self.held, self.size = [(a[stay], b[stay], bits[stay])], 0
        return a[stay], b[stay]


def compare(forest: Forest, prints: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 1 << 19) -> None:
    """Add all pairs of members of ``a`` and ``b`` but those that are in one tight group.

    Of two members in different groups, one is outside the largest group; only these are rows.
    """
    groups = forest.tight
    name, count = np.unique(groups.find(np.concatenate([a, b])), return_counts=True)
    largest = name[count.argmax()]
    for rows, others in ((a[groups.find(a) != largest], b), (b[groups.find(b) != largest], a[groups.find(a) == largest])):
        step = max(1, block // max(1, len(others)))
        for at in range(0, len(rows), step):
            for to in range(0, len(others), block):
                own, them = rows[at: at + step], others[to: to + block]
                bits = np.zeros((len(own), len(them)), np.uint16)
                for lane in range(prints.shape[1]):
                    bits += np.bitwise_count(prints[own, lane][:, None] ^ prints[them, lane][None, :])
                x, y = np.nonzero(bits <= forest.loose)
                forest.add(own[x], them[y], bits[x, y])


def company(forest: Forest, keys: np.ndarray, slack: np.ndarray, prints: np.ndarray, bucket: int, prefix: int, unfold: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``forest`` keeps of the pairs of a bucket with keys within 4 bits and prints within the loose limit.

    Distinct keys meet, each for all members that share it. Pairs of keys in one
    group of ``forest.tight`` are passed over; of the others, first members are compared, then all.
    A pair of keys meets in several buckets; the one of its middle does the
    last, and a key's own bucket compares the members that share the key.
    Full comparison is quadratic in what stays apart at one key.
    """
    order = np.argsort(keys, kind="stable")
    distinct, first, size = np.unique(keys[order], return_index=True, return_counts=True)
    head = order[first]
    groups = forest.tight

    def near(a: np.ndarray, b: np.ndarray) -> None:
        forest.add(a, b, np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1))

    star = np.repeat(head, size)
    near(star, order)
    shift = np.uint64(32 - prefix)
    pure = np.bitwise_and.reduceat(groups.find(star) == groups.find(order), first)
    for k in np.flatnonzero(~pure & (distinct >> shift == bucket)).tolist():
        own = order[first[k]: first[k] + size[k]]
        compare(forest, prints, own, own)
    done: set[int] = set()
    for variant, member in meetings(distinct, np.arange(len(distinct)), slack[head], 32 - prefix, unfold):
        for ahead in range(1, len(member)):
            at = np.flatnonzero(variant[ahead:] == variant[:-ahead])
            if not len(at):
                break
            if ahead & ahead - 1 == 0:  # groups that are one by now are passed over as a whole
                begins = np.flatnonzero(np.r_[True, variant[1:] != variant[:-1]])
                name = groups.find(head[member])
                same = pure[member] & (name == np.repeat(name[begins], np.diff(np.r_[begins, len(variant)])))
                stay = np.repeat(~np.bitwise_and.reduceat(same, begins), np.diff(np.r_[begins, len(variant)]))
                variant, member = variant[stay], member[stay]
                if len(member) <= ahead:
                    break
                at = np.flatnonzero(variant[ahead:] == variant[:-ahead])
            pair = np.unique(member[at] * len(distinct) + member[at + ahead])
            a, b = pair // len(distinct), pair % len(distinct)
            apart = groups.find(head[a]) != groups.find(head[b])
            pair, a, b = (x[apart | ~pure[a] | ~pure[b]] for x in (pair, a, b))
            near(head[a], head[b])
            apart = groups.find(head[a]) != groups.find(head[b])
            bits = distinct[a] ^ distinct[b]
            rest = bits & (bits - np.uint64(1))
            weight = np.bitwise_count(bits)
            middle = distinct[a] ^ np.where(weight > 1, bits ^ rest, np.uint64(0)) ^ np.where(weight > 3, rest & ~(rest - np.uint64(1)), np.uint64(0))
            for k in np.flatnonzero((size[a] * size[b] > 1) & (apart | ~pure[a] | ~pure[b]) & (middle >> shift == bucket)).tolist():
                if int(pair[k]) not in done:
                    done.add(int(pair[k]))
                    compare(forest, prints, *(order[first[x]: first[x] + size[x]] for x in (int(a[k]), int(b[k]))))
    return forest.edges()


def similar_links(rows: DataFrame, limits: tuple[int, int], unfold: int = 1 << 21) -> DataFrame:
    """Distinct ``a``, ``b``: pairs of ids of ``rows(id, fp)`` whose 256-bit fingerprints differ in at most the loose limit's bits.

    Candidates come from six tables of 32 bits with radius 4, by the same balls
    of half the radius as :func:`ball_links`. Every pair that meets in a table
    is compared, unless pairs within the tight limit join it already. Buckets
    return spanning forests of fewest bits, so at most an edge per row.
    """
    total = 8 * (LANES + 1) * rows.count()
    prefix = prefix_for(total, 32, 2, 4)
    near = masks(prefix, 2).astype(np.int64)

    def words(prints: np.ndarray, table: int) -> np.ndarray:
        return (prints[:, table // 2] >> np.uint64(32 * (1 - table % 2))) & np.uint64(0xFFFFFFFF)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, max(64, (1 << 20) // len(near))):
            if not batch.num_rows:
                continue
            prints = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u8").astype(np.uint64).reshape(-1, LANES)
            own = np.concatenate([np.asarray(batch.column(0), np.int64).view(np.uint64)[:, None], prints], axis=1)
            for table in range(TABLES):
                yield by_prefix((words(prints, table) >> np.uint64(32 - prefix)).astype(np.int64), near, own, table << prefix)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, own in each_bucket(batches):
            own = own.reshape(-1, LANES + 1)
            own = own[np.lexsort(own.T[::-1])]  # the order of arrival must not matter
            ids, prints = np.ascontiguousarray(own[:, 0]).view(np.int64), own[:, 1:]
            keys = words(prints, bucket >> prefix)
            slack = 2 - np.bitwise_count((keys >> np.uint64(32 - prefix)).astype(np.int64) ^ (bucket & (1 << prefix) - 1)).astype(np.int64)
            x, y = company(Forest(len(ids), *limits), keys, slack, prints, bucket & (1 << prefix) - 1, prefix, unfold)
            if len(x):
                yield pa.record_batch([pa.array(np.minimum(ids[x], ids[y])), pa.array(np.maximum(ids[x], ids[y]))], ["a", "b"])

    sent = columns(rows, "id", "fp").mapInArrow(send, "bucket long, rows binary")
    return bucketed(sent, TABLES << prefix, TABLES * len(near) * total).mapInArrow(meet, "a long, b long").filter("a <> b").distinct()


def sets_of(pairs: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """``row``, ``id``, ``shingles`` (set of 64-bit hashes) of the documents in ``pairs(a, b)``; rows that share a doc_id are a row each."""
    asked = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            blobs = [shingle_set(t, width).tobytes() for t in text_bytes(batch.column(1))]
            yield pa.record_batch([batch.column(0), binary_column(blobs)], ["id", "shingles"])

    made = docs.join(asked, "doc_id", "left_semi").mapInArrow(sets, "id long, shingles binary")
    return cut(made.withColumn("row", F.monotonically_increasing_id()), "simhash-shingles")


def verified(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """The distinct ``pairs`` (a, b) of ids whose sets in ``held(id, shingles)`` have this Jaccard similarity or more.

    Shingles are told apart by their 64-bit hashes. A text without words is an empty set, and two
    of them are alike; rows that share an id are each compared.
    """
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            own = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_py(), np.uint64) for c in (2, 3))
                both = np.concatenate([x, y])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                own.append(same >= similarity * (len(both) - same))
            kept = pa.array(own, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["a", "b"])

    left, right = (held.select(F.col("id").alias(end), F.col("shingles").alias(name)) for end, name in (("a", "x"), ("b", "y")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long").distinct()


def prefixes(held: DataFrame, similarity: float) -> DataFrame:
    """``token``, ``id``, ``n``, ``back``: the shingles that can be the rarest which a set of ``held`` shares with a similar one.

    In an order of all shingles by how many sets have them, a set's ``back`` last
    ones (of ``n``) begin with the token. What two sets share is no more than
    what either has from their first common shingle on, so with a similarity s
    that has ``back`` of s * n or more. Shingles of one set alone come first and are left out.
    """
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 100):
            sets = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
            n = np.array([len(x) for x in sets], np.int64)
            if n.sum():
                row, own = (np.repeat(np.asarray(batch.column(i), np.int64), n) for i in (0, 1))
                yield pa.record_batch([pa.array(x) for x in (row, own, np.repeat(n, n), np.concatenate(sets))], ["row", "id", "n", "token"])

    flat = held.select("row", "id", "shingles").mapInArrow(each, "row long, id long, n long, token long")
    often = flat.groupBy("token").count().filter("count > 1")
    last = Window.partitionBy("row").orderBy(F.desc("count"), F.desc("token"))
    ordered = flat.join(often, "token").withColumn("back", F.row_number().over(last).cast("long"))
    return ordered.filter(F.col("back") >= similarity * F.col("n") - 1e-6).select("token", "id", "n", "back")


def sharing(cell: np.ndarray, side: np.ndarray, split: np.ndarray, group: np.ndarray, n: np.ndarray, back: np.ndarray, similarity: float, block: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs x, y of rows of one cell and different groups that can have this similarity by size and ``back``, and ``large``: which rows are of their cell's largest group.

    In a ``split`` cell these are pairs of rows of different sides. ``n`` of y is that of x or less.
    """
    share = similarity / (1 + similarity)
    top = np.floor(back / share - n + 1e-6).astype(np.int64)  # the most that the other's n can be
    order = np.lexsort((group, cell))
    first = np.flatnonzero(np.r_[True, (cell[order][1:] != cell[order][:-1]) | (group[order][1:] != group[order][:-1])])
    many = np.diff(np.r_[first, len(order)])
    largest = np.zeros(int(cell.max()) + 1, np.int64)
    ascending = np.argsort(many, kind="stable")
    largest[cell[order[first]][ascending]] = group[order[first]][ascending]  # the last one written stays
    large = group == largest[cell]
    key = ((cell * 2 + side) * 2 + large << 32) + n
    index = np.flatnonzero(top >= n)
    index = index[np.argsort(key[index], kind="stable")]
    for kind in (0, 1):
        probe = np.flatnonzero(~large) if kind else np.arange(len(cell))
        base = (cell[probe] * 2 + (side ^ split)[probe]) * 2 + kind << 32
        low = np.searchsorted(key[index], base + np.ceil(similarity * n[probe] - 1e-6).astype(np.int64))
        high = np.searchsorted(key[index], base + np.minimum(n, top)[probe], "right")
        some = np.flatnonzero(high > low)
        probe, low, count = probe[some], low[some], (high - low)[some]
        ends = count.cumsum()
        at = 0
        while at < len(probe):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] - count[at] + block, "right")))
            own = count[at: to]
            x = np.repeat(probe[at: to], own)
            y = index[np.repeat(low[at: to] - (own.cumsum() - own), own) + np.arange(len(x))]
            apart = (group[x] != group[y]) & (top[y] >= n[x])
            yield x[apart], y[apart], large
            at = to


def whole_cells(batches: Iterator[pa.RecordBatch], least: int = 1 << 16) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about ``least`` rows that end between cells, and the number of each row's cell; a cell is rows with equal first three columns."""
    def numbered(table: pa.Table) -> np.ndarray:
        names = [np.asarray(table.column(i)) for i in range(3)]
        return np.r_[0, np.logical_or.reduce([x[1:] != x[:-1] for x in names]).cumsum()]

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(x.num_rows for x in held) >= least:
            table = pa.Table.from_batches(held)
            cell = numbered(table)
            ends = int(np.searchsorted(cell, cell[-1]))
            if ends:
                yield table.slice(0, ends), cell[:ends]
            held = table.slice(ends).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, numbered(table)


CELL_ROWS = 4096


def crowd_pairs(found: DataFrame, rows: DataFrame, past: DataFrame, most: int, similarity: float, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Pairs ``a``, ``b`` of ids of ``rows(id, label, fp)`` that meet at one of their prefixes ``found`` and have different labels, without those in ``past``.

    A row asks for the ``most`` of fewest bits, unless its group is the largest that meets there.
    There are none only if no two rows of different labels can have this similarity but those in ``past``.
    A token of more than ``cell_rows`` rows is compared block by block, each pair of blocks a cell.
    """
    failed = past.groupBy(F.col("a").alias("id")).agg(F.collect_list("b").alias("past"))
    sent = rows.join(failed, "id", "left").withColumn("past", F.coalesce("past", F.array().cast("array<long>")))
    met = found.join(rows, "id").groupBy("token").agg(F.ceil(F.count("*") / cell_rows).alias("blocks"), F.min("label").alias("low"), F.max("label").alias("high"))
    met = met.filter("low <> high").select("token", "blocks")
    dealt = found.join(met, "token").withColumn("own", F.pmod(F.xxhash64("id"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = dealt.join(sent, "id").select(
        "token", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("long").alias("side"),
        "id", "label", "n", "back", "fp", "past")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cell in whole_cells(batches):
            side, ids, label, n, back = (np.asarray(table.column(i), np.int64) for i in range(3, 8))
            split = (np.asarray(table.column(1)) != np.asarray(table.column(2))).astype(np.int64)
            prints = np.frombuffer(b"".join(table.column(8).to_pylist()), ">u8").astype(np.uint64).reshape(-1, LANES)
            names, first, doc = np.unique(ids, return_index=True, return_inverse=True)
            lists = table.column(9).take(pa.array(first)).combine_chunks()
            gone = np.asarray(lists.flatten(), np.int64)
            at = np.searchsorted(names, gone)
            known = names[np.minimum(at, len(names) - 1)] == gone
            lost = np.unique((np.repeat(np.arange(len(names)), np.asarray(lists.value_lengths())) * len(names) + at)[known])
            held, size = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], 0

            def best() -> tuple[np.ndarray, np.ndarray]:
                pair, bits = (np.concatenate(x) for x in zip(*held, strict=True))
                pair, once = np.unique(pair, return_index=True)
                order = np.lexsort((pair, bits[once], pair // len(names)))
                asker = pair[order] // len(names)
                begin = np.flatnonzero(np.r_[True, asker[1:] != asker[:-1]])[: len(asker)]
                rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.r_[begin, len(order)]))
                own = order[rank < most]
                return pair[own], bits[once][own]

            for x, y, large in sharing(cell, side, split, np.unique(label, return_inverse=True)[1], n, back, similarity):
                a, b = np.minimum(doc[x], doc[y]), np.maximum(doc[x], doc[y])
                open_ = (a != b) & ~np.isin(a * len(names) + b, lost)
                x, y = x[open_], y[open_]
                bits = np.bitwise_count(prints[x] ^ prints[y]).sum(axis=1).astype(np.int64)
                for asker, other in ((x, y), (y, x)):
                    asks = ~large[asker]
                    held.append((doc[asker[asks]] * len(names) + doc[other[asks]], bits[asks]))
                    size += int(asks.sum())
                if size > 1 << 21:
                    held, size = [best()], 0
            pair, bits = best()
            if len(pair):
                yield pa.record_batch([pa.array(names[pair // len(names)]), pa.array(names[pair % len(names)]), pa.array(bits)], ["asker", "other", "bits"])

    width = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), found.count() >> 19)
    cells = cells.repartition(width, "token", "low", "high").sortWithinPartitions("token", "low", "high")
    asked = cells.mapInArrow(meet, "asker long, other long, bits long").distinct()
    rank = F.row_number().over(Window.partitionBy("asker").orderBy("bits", "other"))
    return asked.withColumn("rank", rank).filter(F.col("rank") <= most).select(F.least("asker", "other").alias("a"), F.greatest("asker", "other").alias("b")).distinct()


def similar_groups(distinct: DataFrame, named: DataFrame, width: int, similarity: float) -> DataFrame:
    """``id``, ``label``: the group of every row of ``distinct(id, fp)``, named by its smallest id, over verified links.

    First a spanning forest of the candidates of each bucket is verified. A group
    that none of its links that failed leads out of has no candidate outside. Between
    the others every pair that can have this similarity is compared: the rows whose shingle sets
    share a token of their :func:`prefixes` meet there, and ask in rounds for ever more
    of those in other groups that have not failed, of fewest bits first, until none is left.
    So most rows of a crowd are joined after a few comparisons, and what is never
    joined has failed with every row that it could be like.
    """
    found = cut(similar_links(distinct, bit_limits(similarity)), "simhash-candidates")
    held = sets_of(found, named, width)
    links = cut(verified(found, held, similarity), "simhash-similar")
    roots = connected_components(links)
    labels = cut(distinct.join(roots, distinct["id"] == roots["v"], "left").select("id", F.coalesce("root", "id").alias("label")).distinct(), "simhash-labels")
    past = cut(between(found.join(links, ["a", "b"], "left_anti"), labels), "simhash-failed")
    if past.isEmpty():
        return labels
    asking = past.select(F.col("x").alias("label")).union(past.select("y")).distinct()
    rows = cut(distinct.groupBy("id").agg(F.min("fp").alias("fp")).join(labels, "id").join(asking, "label", "left_semi").select("id", "label", "fp"), "simhash-open")
    held = cut(held.join(rows, "id", "left_semi"), "simhash-open-shingles")
    tokens = cut(prefixes(held, similarity), "simhash-prefixes")
    past = past.select("a", "b")
    moves: list[DataFrame] = []
    most = 8
    while not (found := cut(crowd_pairs(tokens, rows, past, most, similarity), "simhash-candidates")).isEmpty():
        good = cut(verified(found, held, similarity), "simhash-similar")
        past = cut(past.union(found.join(good, ["a", "b"], "left_anti")), "simhash-failed")
        if not good.isEmpty():
            merged = connected_components(between(good, rows).select(F.col("x").alias("a"), F.col("y").alias("b")))
            moves.append(merged)
            rows = cut(rows.join(merged, rows["label"] == merged["v"], "left").select("id", F.coalesce("root", "label").alias("label"), "fp"), "simhash-open")
        most *= 4
    for merged in moves:
        labels = labels.join(merged, labels["label"] == merged["v"], "left").select("id", F.coalesce("root", "label").alias("label"))
    return labels


def between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends have different labels, and these (x, y)."""
    ends = labels.select("id", "label")
    both = pairs.join(ends.toDF("a", "x"), "a").join(ends.toDF("b", "y"), "b")
    return both.filter("x <> y").select("a", "b", "x", "y")


def keep_one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, unchanged, whose doc_id is the smallest of its group of near-duplicates.

    Documents that meet in a table and whose 256-bit fingerprints on sets of
    ``width``-word shingles are within three standard deviations of what
    ``similarity`` makes expected are candidates. A candidate link holds if the
    sets of shingles have that Jaccard similarity, and groups are connected over
    links. Where links failed, every pair of the rows that these lead to is
    compared, unless it is in one group already (see :func:`similar_groups`).
    Only equal sets (by 128-bit hashes) are links without a comparison.

    Texts without words form one group. Null texts count as empty. Rows
    without doc_id cannot be told apart and all stay; so do all rows that share
    the smallest doc_id, and rows that share a doc_id are one document, alike to
    what any of them is alike to. Other columns are kept; an empty table gives
    an empty result. The result does not depend on the order of rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches):
            sets = [shingle_set(t, width) for t in text_bytes(batch.column(1))]
            yield pa.record_batch([batch.column(0), binary_column([wide_simhash(x) for x in sets]), binary_column([xxhash.xxh3_128_digest(x.tobytes()) for x in sets])], ["doc_id", "fp", "own"])

    docs = fixed(docs, "doc_id", "text")
    named = docs.select("doc_id", "text").filter("doc_id is not null")
    prints = cut(named.mapInArrow(run, "doc_id long, fp binary, own binary"), "simhash-wide")
    distinct = cut(prints.groupBy("fp", "own").agg(F.min("doc_id").alias("id")), "simhash-wide-distinct")
    groups = similar_groups(distinct.select("id", "fp"), named, width, similarity)
    labels = cut(distinct.join(groups, "id").groupBy("own").agg(F.min("label").alias("root")), "simhash-groups")
    gone = prints.join(labels, "own").groupBy("doc_id").agg(F.min("root").alias("root")).filter("root < doc_id").select("doc_id")
    own = fresh(docs, "gone")
    return docs.join(gone.toDF(own), F.col(own) == docs["doc_id"], "left_anti")
