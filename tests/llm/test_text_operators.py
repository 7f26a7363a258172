"""SimHash, lines, substrings, chat and fingerprints against plain versions, with awkward rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from loomwork.llm import chat, lines, lzprint, simhash, substrings, tokenfile
from loomwork.llm.components import connected_components
from loomwork.llm.encoder import text_batches
from loomwork.llm.queries import op2_chat

from ..conftest import SF

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, `Bucket` string, kind string, v string"


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    words = ["Alpha", "beta", "γάμμα", "delta,", "the", "of", "x", "é", "Zed."]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(30, 90))) for _ in range(12)]
    out = [*base, *base[:3], base[0].replace("the", "a", 1), base[1] + " more", None, "", "   ", "one", "\n\n", "x " * 3000]
    passage = "\n".join(" ".join(rnd.choice(words) for _ in range(9)) for _ in range(12))
    out += [f"start {i}\nintro {i}\n{passage}\nend {i}\nbye {i}" for i in range(5)]
    return list(enumerate(out)) + [(3, base[3]), (4, "other text of row four"), (None, base[0]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(d, t, "b", "k", "v") for d, t in texts], SCHEMA).repartition(3).cache()


def plain_simhash(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    grams = [" ".join(words[i: i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash_components(docs, texts):
    prints = [(d, plain_simhash(t, 4)) for d, t in texts]
    group = list(range(len(prints)))
    for _ in prints:
        group = [min(group[j] for j in range(len(prints)) if (prints[i][1] ^ prints[j][1]).bit_count() <= 4) for i in range(len(prints))]
    lowest = {g: min((prints[i][0] for i in range(len(prints)) if group[i] == g and prints[i][0] is not None), default=None) for g in group}
    expected = sorted(((d, f"{p:016x}", lowest[group[i]]) for i, (d, p) in enumerate(prints)), key=str)
    found = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, 4, 4).collect()), key=str)
    assert found == expected


def test_ball_links_find_all_pairs_within_the_radius(spark):
    rnd = np.random.default_rng(0)
    seeds = rnd.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = [int(s) for s in seeds]
    for s in seeds[:20]:
        for n in range(1, 8):
            fps.append(int(s) ^ sum(1 << int(b) for b in rnd.choice(64, n, replace=False)))
    fps = sorted({f - (1 << 64) if f >= 1 << 63 else f for f in fps})
    for unfold in (1 << 21, 5000):
        links = simhash.ball_links(spark.createDataFrame([(f,) for f in fps], "fp long"), 4, unfold=unfold)
        roots = {r.v: r.root for r in connected_components(links).collect()}
        label = {f: f for f in fps}
        for _ in fps:
            label = {f: min(label[g] for g in fps if ((f ^ g) & ((1 << 64) - 1)).bit_count() <= 4) for f in fps}
        groups = lambda of: {frozenset(f for f in fps if of(f) == x) for x in {of(f) for f in fps}}
        assert groups(lambda f, r=roots: r.get(f, f)) == groups(label.get)


def test_similar_texts_keep_one_of_each(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(4000)]
    base = [[rnd.choice(words) for _ in range(300)] for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base[:20]):  # a few words changed: similarity of about 0.9; others share a third only
        near = list(w)
        for at in rnd.sample(range(300), 3):
            near[at] = "changed"
        rows.append((100 + i, " ".join(near)))
        rows.append((200 + i, " ".join(w[:100] + [rnd.choice(words) for _ in range(200)])))
    rows += [(300, ""), (301, None), (302, " "), (None, rows[0][1]), (0, rows[0][1])]
    table = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, FP string").repartition(3)
    kept = simhash.keep_one_of_each(table)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == table.columns and ids.count(0) == 2 and ids.count(None) == 1
    assert set(range(40)) | {200 + i for i in range(20)} | {300} <= set(ids) and not {301, 302} & set(ids)
    assert len([d for d in ids if d is not None and 100 <= d < 200]) <= 1
    assert simhash.keep_one_of_each(table.limit(0)).count() == 0


def test_similar_links_compare_all_that_meet_in_a_crowd(spark):
    rnd = np.random.default_rng(5)
    crowd = rnd.integers(0, 1 << 63, (400, 4), dtype=np.uint64) * np.uint64(2) + rnd.integers(0, 2, (400, 4), dtype=np.uint64)
    crowd[:, 0] &= np.uint64(0xFFFFFFFF)  # one 32-bit word is shared; pairs at distance 42 meet there alone
    pairs = crowd[:100].copy()
    for row in pairs:
        for word in range(1, 8):
            row[word // 2] ^= np.uint64(sum(1 << int(b) for b in rnd.choice(32, 6, replace=False)) << 32 * (1 - word % 2))
    pairs[50:, 0] ^= np.uint64(0b111 << 40)  # three bits apart in the word
    pairs[50:, 3] ^= crowd[50:100, 3] ^ pairs[50:, 3]
    pairs[50:, 3] ^= np.uint64(0b1111111)
    prints = np.concatenate([crowd, pairs, crowd[:30] ^ np.uint64(1)])
    ids = rnd.permutation(len(prints))
    distance = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    table = spark.createDataFrame([(int(i), p.astype(">u8").tobytes()) for i, p in zip(ids, prints)], "id long, fp binary").repartition(3)
    label = np.arange(len(prints))
    for _ in range(6):
        label = np.array([label[near].min() for near in distance <= 44])
    assert len(set(label.tolist())) < len(prints) - 100
    for unfold in (1 << 21, 5000):
        roots = {r.v: r.root for r in connected_components(simhash.similar_links(table, (44, 44), unfold=unfold)).collect()}
        groups = lambda of: {frozenset(i for i in range(len(ids)) if of(i) == x) for x in {of(i) for i in range(len(ids))}}
        assert groups(lambda i, r=roots: r.get(int(ids[i]), int(ids[i]))) == groups(lambda i: int(label[i]))


def test_links_do_not_depend_on_the_order_of_arrival(spark):
    """Four rows that meet at one word; only b and d are near."""
    rnd = np.random.default_rng(8)
    four = rnd.integers(0, 1 << 63, (4, 4), dtype=np.uint64)
    four[:, 0] = four[0, 0]
    four[3] = four[1]
    for word in range(2, 8):
        four[3, word // 2] ^= np.uint64(0b1111110 << 32 * (1 - word % 2))
    for order in ([0, 1, 2, 3], [1, 3, 0, 2], [3, 2, 1, 0]):
        table = spark.createDataFrame([(int(i), four[i].astype(">u8").tobytes()) for i in order], "id long, fp binary").coalesce(1)
        assert {frozenset((r.a, r.b)) for r in simhash.similar_links(table, (10, 44)).collect()} == {frozenset((1, 3))}


def test_buckets_follow_the_number_of_rows():
    assert simhash.prefix_for(1 << 20, 64, 2, 8) == 8 and simhash.prefix_for(1 << 20, 32, 2, 4) == 4
    for total in (1 << 36, 1 << 40):
        prefix = simhash.prefix_for(total, 64, 2, 8)
        assert len(simhash.masks(prefix, 2)) * total >> prefix <= simhash.BUCKET_BYTES


def test_spanning_forest_is_the_least():
    rnd = np.random.default_rng(2)
    for n, m in ((1, 0), (30, 60), (40, 30)):
        a, b, w = rnd.integers(0, n, m), rnd.integers(0, n, m), rnd.integers(0, 9, m)
        group, total = list(range(n)), 0
        for i in sorted(range(m), key=lambda i: w[i]):
            x, y = group[a[i]], group[b[i]]
            if x != y:
                total += w[i]
                group = [x if g == y else g for g in group]
        own = a != b
        stay = simhash.spanning(n, a[own], b[own], w[own])
        assert w[own][stay].sum() == total and len(stay) == n - len(set(group))


def test_recall_at_the_threshold(spark):
    """Lone pairs of a Jaccard similarity of just 0.8 or more are found nine times of ten; those below it never."""
    rnd = random.Random(12)
    alike, below = [], []

    def jaccard(v, w):
        p, q = ({tuple(x[i: i + 5]) for i in range(len(x) - 4)} for x in (v, w))
        return len(p & q) / len(p | q)

    for p in range(300):
        words = [f"{p}w{i}" for i in range(300)]
        other, best = list(words), list(words)
        for spot in rnd.sample(range(300), 12):
            other[spot] = f"{p}new{spot}"
            if jaccard(words, other) < 0.8:
                break
            best = list(other)
        alike += [(2 * p, " ".join(words)), (2 * p + 1, " ".join(best))]
        below += [(2 * p, " ".join(words)), (2 * p + 1, " ".join(other))]
    schema = "doc_id long, text string"
    kept = [r.doc_id for r in simhash.keep_one_of_each(spark.createDataFrame(alike, schema).repartition(4)).collect()]
    assert sum(d % 2 for d in kept) <= 0.1 * 300 and sum(d % 2 == 0 for d in kept) == 300
    assert simhash.keep_one_of_each(spark.createDataFrame(below, schema)).count() == 600


def brute_groups(texts, width=5, similarity=0.8):
    """Which texts go, by all pairs of shingle sets."""
    grams = [{tuple(w[i: i + width]) for i in range(len(w) - width + 1)} or {tuple(w)} for w in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(grams[i] & grams[j])
            if label[i] != label[j] and both >= similarity * (len(grams[i]) + len(grams[j]) - both):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return {i for i, x in enumerate(label) if x != i}


@pytest.mark.parametrize("groups, size", [(40, 6), (8, 40), (2, 200)])
def test_groups_at_the_threshold(spark, groups, size):
    """Pairs of a group lie around 0.8: links that fail hide none that hold, and nothing else goes."""
    rnd = random.Random(size)
    texts = []
    for g in range(groups):
        base = [f"{g}w{i}" for i in range(300)]
        for n in range(size):
            own = list(base)
            for at in rnd.sample(range(300), 4 if size > 6 else rnd.choice([3, 4])):
                own[at] = f"{g}x{n}y{at}"
            texts.append(own)
    due = brute_groups(texts)
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(3)
    went = set(range(len(texts))) - {r.doc_id for r in simhash.keep_one_of_each(table).collect()}
    assert went <= due and len(went) >= 0.9 * len(due) > 0


def test_equal_fingerprints_of_different_texts_are_verified(spark):
    """A repeated phrase that fills a text's shingles does not make it like another; nor do equal prints."""
    phrase = "buy now and save a lot today "
    texts = [phrase * 200 + " ".join(f"{d}own{i}" for i in range(60)) for d in range(2)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.keep_one_of_each(table).count() == 2
    prints = spark.createDataFrame([(i, b"\1" * 32) for i in range(4)], "id long, fp binary")
    named = spark.createDataFrame([(0, "a b c d e f"), (1, "g h i j k l"), (2, "a b c d e f"), (3, "m n o p q r")], "doc_id long, text string")
    assert {r.id: r.label for r in simhash.similar_groups(prints, named, 5, 0.8).collect()} == {0: 0, 1: 1, 2: 0, 3: 3}


def test_similar_texts_in_a_crowd_with_a_shared_template(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    template = [rnd.choice(words) for _ in range(200)]
    texts = [template + [rnd.choice(words) for _ in range(120)] for _ in range(150)]
    for w in texts[:50]:
        near = list(w)
        for at in rnd.sample(range(320), 2):
            near[at] = "changed"
        texts.append(near)
    rnd.shuffle(texts)
    grams = [{tuple(w[i: i + 5]) for i in range(len(w) - 4)} for w in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(table).collect()) == sorted(set(label))


def test_no_link_is_lost_among_many_that_fail(spark):
    """A link outside the 40 nearest by bits at both ends is found, and a token of more rows than a block is compared whole."""
    rnd = random.Random(21)
    base = [f"w{i}" for i in range(100)]
    texts = [base[:88] + [f"{n}own{i}" for i in range(12)] for n in range(60)]  # a similarity of 0.78 with one another
    texts += [["x"] * (n % 2) + base[:91] + [f"{n}new{i}" for i in range(8)] + ["end"] for n in range(2)]
    due = brute_groups(texts)
    assert due == {61}
    far = np.zeros((62, 4), np.uint64)
    far[60, 1], far[61, 2] = np.uint64((1 << 20) - 1), np.uint64((1 << 20) - 1)  # the others are nearer to both
    table = spark.createDataFrame([(i, p.astype(">u8").tobytes()) for i, p in enumerate(far)], "id long, fp binary").repartition(3)
    named = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert {r.id for r in simhash.similar_groups(table, named, 5, 0.8).filter("id <> label").collect()} == due
    held = simhash.sets_of(spark.createDataFrame([(i, i) for i in range(62)], "a long, b long"), named, 5)
    rows, none = table.withColumn("label", F.col("id")), spark.createDataFrame([], "a long, b long")
    tokens = simhash.prefixes(held, 0.75).cache()
    pairs = {frozenset((r.a, r.b)) for r in simhash.crowd_pairs(tokens, rows, none, 100, 0.75).collect()}
    assert pairs == {frozenset((r.a, r.b)) for r in simhash.crowd_pairs(tokens, rows, none, 100, 0.75, cell_rows=7).collect()}
    assert len(pairs) == 62 * 61 // 2  # all have 0.75


def test_long_chain_is_one_component(spark):
    n = 300
    edges = spark.range(n).select(((F.col("id") * 7919) % n).alias("a"), (((F.col("id") + 1) * 7919) % n).alias("b")).filter("id < 299")
    assert connected_components(edges).select("root").distinct().count() == 1
    assert connected_components(edges.limit(0)).count() == 0


def plain_chunks(text, window=2, mean=2):
    """Chunks by the definition: a chunk of two lines or more ends after a line where the hash of the last ``window`` lines is divisible by ``mean``."""
    parts = text.encode().split(b"\n")
    chunks, own = [], []
    for i, line in enumerate(parts):
        own.append(line)
        if i >= window - 1 and i < len(parts) - 1 and len(own) > 1:
            rolled = 0
            for before in parts[i - window + 1: i + 1]:
                rolled = (rolled * 0x9E3779B97F4A7C15 + xxhash.xxh3_64_intdigest(before)) % (1 << 64)
            x = rolled  # SplitMix64's finaliser
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
            x = (x ^ x >> 27) * 0x94D049BB133111EB % (1 << 64)
            if (x ^ x >> 31) % mean == 0:
                chunks.append(own)
                own = []
    return [*chunks, own]


def plain_line_dedup(texts):
    """What stays of (doc_id, text) rows: every run of a chunk and lines beside it, up to its neighbours' ends, is compared as bytes with all earlier ones."""
    seen, out = {}, {}
    for d, t in sorted(texts):
        parts, at, runs = t.encode().split(b"\n"), 0, []
        bounds = [0]
        for own in plain_chunks(t):
            bounds.append(bounds[-1] + len(own))
        for k, (i, j) in enumerate(zip(bounds, bounds[1:])):
            if j - i > 1 and b"".join(parts[i:j]).strip():
                runs.append(((i, j), "chunk", b"\n".join(parts[i:j]), i))
                runs += [((x, j), i - x, b"\n".join(parts[x:j]), x) for x in range(bounds[k - 1] if k else 0, i)]
                runs += [((i, x + 1), j - 1 - x, b"\n".join(parts[i: x + 1]), x) for x in range(j, bounds[k + 2] if k + 2 < len(bounds) else j)]
        gone = set()
        for (i, j), kind, body, at in sorted(runs, key=lambda r: (r[3], str(r[1]))):
            if (kind, body) in seen:
                gone |= set(range(i, j))
            seen.setdefault((kind, body), (d, at))
        out[d] = (b"\n".join(x for i, x in enumerate(parts) if i not in gone).decode(), len(gone))
    return out


def test_lines(docs, texts):
    rows = [(d, t) for d, t in texts if d is not None and t is not None]
    single = [(d, t) for d, t in rows if [x for x, _ in rows].count(d) == 1]
    found = {(r.doc_id, r.text): r for r in lines.dedup_lines(docs).collect()}
    assert len(lines.dedup_lines(docs).collect()) == len(texts)
    expected = plain_line_dedup(single)
    others = [t for d, t in rows if (d, t) not in single]
    shared = {x for t in others for x in t.split("\n")}
    for d, t in single:
        if not shared & set(t.split("\n")):  # rows of one doc_id are ordered by a hash of their texts
            assert (d, expected[d][0]) in found
    assert any(r.n_removed_lines for r in found.values())


def test_chunks_of_one_hash_are_told_apart_by_their_bytes(spark):
    """In the meeting bucket only bytes decide: all chunks are sent there under one hash."""
    rows = [(i, f"a {i % 4}\nb {i % 4}") for i in range(12)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_sub", F.lit(0).cast("long")).repartition(3)
    one = lines.repeated_chunks(table.select("doc_id", "text", "_sub"), 2, 2, 1)
    marked = [d for r in one.collect() for d in lines.unpack(r.blob, 3)[0].tolist()]
    assert sorted(set(marked)) == list(range(4, 12))


@pytest.mark.parametrize("kind", ["lines", "substrings", "simhash"])
def test_clashing_names_and_hot_missing_ids(spark, kind):
    rows = [(i, "\n".join(f"line {i % 7} {j} of some words" for j in range(6)), "T", 1, 2, "g") for i in range(60)]
    rows += [(None, rows[0][1], "T", 1, 2, "g")] * 40 + [(5, "another text of this id", "T", 1, 2, "g")]
    table = spark.createDataFrame(rows, "doc_id long, text string, TEXT string, _again int, _sub int, gone string").repartition(5)
    run = {"lines": lines.dedup_lines, "substrings": substrings.dedup_substrings, "simhash": simhash.keep_one_of_each}[kind]
    found = run(table)
    assert found.columns[:6] == ["doc_id", "text", "TEXT_", "_again", "_sub", "gone"]
    out = found.collect()
    assert sum(r.doc_id is None and r.text.split() == rows[0][1].split() for r in out) == 40 and {(r["TEXT_"], r["_again"], r["_sub"], r["gone"]) for r in out} == {("T", 1, 2, "g")}
    kept = {r.doc_id for r in out if r.text and r.doc_id is not None}
    assert kept - {5} == set(range(7)) - {5}
    assert (5, "another text of this id") in {(r.doc_id, r.text) for r in out}


def test_line_boundaries_do_not_shift():
    body = [b"line %d" % i for i in range(200)]
    a, b = lines.chunk_edges(body, 2, 3), lines.chunk_edges([b"new"] * 7 + body, 2, 3)
    assert len({x + 7 for x in a[1:]} & set(b)) >= len(a) - 2


def test_repeated_chunks_grow_to_whole_runs(spark, monkeypatch):
    rnd = random.Random(9)
    runs = [[f"run {r} line {i}" for i in range(2 + r % 14)] for r in range(60)]
    rows = []
    for d in range(200):
        body = [f"own {d} before {i}" for i in range(rnd.randint(0, 4))]
        for r in rnd.sample(range(60), 2):
            body += runs[r] + ["", f"own {d} after {r}"] * rnd.randint(0, 1)
        rows.append((d, "\n".join(body)))
    rows += [(260, "a\na\na"), (261, "x\n\n\ny"), (262, "z\n\n\nw"), (263, "")]
    table = spark.createDataFrame([*rows, (264, None)], "doc_id long, text string").repartition(3)
    found = {r.doc_id: (r.text, r.n_removed_lines) for r in lines.dedup_lines(table).collect()}
    assert found.pop(264) == (None, 0) and found == plain_line_dedup(rows)
    alone = {r.doc_id: (r.text, r.n_removed_lines) for r in lines.dedup_lines(table, grow=False).collect()}
    assert 0 < sum(n for _, n in alone.values()) < sum(n for _, n in found.values())
    text = [(d, t.split("\n")) for d, t in rows]
    first, due = {}, 0  # lines that lie in repeats of two lines or more
    for d, parts in text:
        again = set()
        for i, pair in enumerate(zip(parts, parts[1:])):
            if pair in first and any(pair):
                again |= {i, i + 1}
            first.setdefault(pair, d)
        due += len(again)
    assert sum(n for _, n in found.values()) >= 0.8 * due
    monkeypatch.setattr(lines, "chunk_edges", lambda own, window, mean: list(range(len(own) + 1)))  # no chunk of several lines
    assert sum(1 for _ in lines.chunk_units("a\nb\nc".encode(), 2, 2, True)) == 0


def test_a_text_of_many_short_lines_is_flushed_inside(spark, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK_BYTES", 1 << 10)
    body = "\n".join(f"{i % 5000}" for i in range(10_000))
    found = {r.doc_id: r.n_removed_lines for r in lines.dedup_lines(spark.createDataFrame([(1, body), (2, body)], "doc_id long, text string")).collect()}
    assert found[2] == 10_000 and 4900 < found[1] <= 5000


def plain_windows(texts, width):
    first = {}
    for d, t in texts:
        words = WORD.findall(t or "")
        for i in range(len(words) - width + 1):
            key = tuple(words[i: i + width])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    for d, t in texts:
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            if d is not None and first[tuple(words[i: i + width])] < d:
                gone[i: i + width] = [True] * width
        yield d, t, words, gone


@pytest.mark.parametrize("width", [5, 13])
def test_substrings(docs, texts, width):
    expected = sorted(((d, None if t is None else " ".join(w for w, g in zip(words, gone) if not g), len(words), sum(gone)) for d, t, words, gone in plain_windows(texts, width)), key=str)
    found = substrings.dedup_substrings(docs, width)
    assert sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in found.collect()), key=str) == expected
    assert found.columns == ["doc_id", "text", "Bucket", "kind", "v", "n_words", "n_removed", "spans"]
    for r in found.collect():
        assert sum(j - i for i, j in r.spans) == r.n_removed and all(a[1] < b[0] for a, b in zip(r.spans, r.spans[1:]))


def test_layout_is_kept(docs):
    for r in substrings.dedup_substrings(docs, 13, keep_layout=True).join(docs.select("doc_id", F.col("text").alias("was")), "doc_id").collect():
        if r.n_removed == 0 and r.doc_id not in (3, 4):
            assert r.text == r.was


def test_window_hashes_are_those_of_the_window_alone():
    words = substrings.word_hashes([b"w%d" % (i % 50) for i in range(500)])
    whole = substrings.window_hashes(words, 13)
    assert all(substrings.window_hashes(words[i: i + 13], 13)[0] == whole[i] for i in range(0, 480, 37))
    assert len(set(whole[:50].tolist())) == 50 and (whole[:50] == whole[50:100]).all()


def test_windows_of_one_hash_are_told_apart_by_the_second():
    hashes, checks = np.array([5, 3, 5, 5, 3, 9, 5], np.uint64), np.array([1, 0, 2, 1, 0, 4, 2])
    order, fresh = substrings.grouped(hashes, checks)
    groups = [sorted(g.tolist()) for g in np.split(order, np.flatnonzero(fresh)[1:])]
    assert groups == [[1, 4], [0, 3], [2, 6], [5]]
    order, fresh = substrings.grouped(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    assert len(order) == len(fresh) == 0


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert simhash.near_duplicates(none).count() == lines.dedup_lines(none).count() == substrings.dedup_substrings(none).count() == lzprint.edit_likeness(none).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "\\\\", "###", "####", "</turn>", "\\</turn>", "### a: b</turn>\n", "a\\", "<</turn>", "#\\#", "é</turn"])
def test_chat_escape_round_trip(text):
    raw = text.encode()
    assert chat.unescape(chat.escape(raw)) == raw
    one = chat.header("ro:le\\") + chat.escape(raw) + chat.END
    found = list(chat.TURN.finditer(one * 2))
    assert [f.span() for f in found] == [(0, len(one)), (len(one), 2 * len(one))] and chat.unescape(found[0][2]) == raw and chat.unescape(found[0][1]) == b"ro:le\\"


def test_chat_awkward_rows(spark):
    rows = [(1, 1, "assistant", "a</turn>###"), (1, 0, "user", None), (1, 1, "assistant", "a</turn>###"), (None, 0, "assistant", "é"), (2, None, None, ""), (-7, 0, "a:b", "x\\")]
    table = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, part string")
    found = {r.conv_id: r for r in chat.read_back(chat.write_formatted(table)).collect()}
    assert found[1].n_turns == 3 and found[1].loss_sha256 == hashlib.sha256(b"a</turn>###" * 2).hexdigest() and found[1].loss_chars == 22
    assert found[1].turns_sha256 == hashlib.sha256(b"user\n\n" + b"assistant\na</turn>###\n" * 2).hexdigest()
    assert found[None].loss_chars == 1 and found[2].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest() and found[-7].loss_chars == 0
    assert chat.read_back(chat.write_formatted(table.limit(0))).count() == 0


def test_batches_are_bound_by_bytes_and_a_row():
    sizes = [3, 50, 7, 900, 2, 2, 2]
    batch = pa.record_batch([pa.array(range(7)), pa.array(range(7)), pa.array(["r"] * 7), pa.array(["x" * n for n in sizes])], ["a", "b", "c", "d"])
    parts = list(text_batches([batch], 3, 100))
    assert [p.num_rows for p in parts] == [4, 3] and pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))


def test_chat_of_many_long_turns(spark):
    """5,000 turns of 100 KB in one conversation, in a worker's usual memory."""
    turns = spark.range(5000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                     F.concat(F.lit("</turn>"), F.repeat(F.lit("0123456789"), 10_000)).alias("text"))
    found = chat.read_back(chat.write_formatted(turns)).first()
    assert found.n_turns == 5000 and found.loss_chars == 2500 * 100_007


def test_chat_query_round_trip(spark):
    data = spark.read.parquet(f"{SF}/conversations.parquet").toPandas().sort_values(["conv_id", "turn"])
    found = {r.conv_id: r for r in op2_chat(spark, SF).collect()}
    assert len(found) == data.conv_id.nunique() + 1 and found[-7].loss_chars == 26
    for conv, own in data.groupby("conv_id"):
        text = "".join(f"{r}\n{t}\n" for r, t in zip(own.role, own.text))
        assert found[conv].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()


def plain_phrases(data):
    known, at, end = set(), 0, 1
    while end <= len(data):
        if data[at:end] in known:
            end += 1
        else:
            known.add(data[at:end])
            at, end = end, end + 1
    return known


def test_phrases_and_likeness(texts):
    for _, t in texts:
        data = (t or "").encode()
        assert set(lzprint.parse(data, 0, len(data), set())[1]) == plain_phrases(data)
    for x in texts[:8]:
        for y in texts[:8]:  # plain Jaccard estimate: of the smallest hashes of the union, those in both
            p, q = ({int.from_bytes(xxhash.xxh3_64_digest(w)[:4], "big") for w in plain_phrases(z[1].encode())} for z in (x, y))
            p, q = set(sorted(p)[:128]), set(sorted(q)[:128])
            low = sorted(p | q)[:128]
            assert lzprint.likeness(*(lzprint.fingerprint(z[1].encode()) for z in (x, y))) == sum(h in p and h in q for h in low) / len(low)
    a, b = (lzprint.fingerprint(x.encode()) for x in (texts[0][1], texts[1][1]))
    assert lzprint.likeness(a, a) == 1.0 > lzprint.likeness(a, b) >= 0.0 and lzprint.likeness(lzprint.fingerprint(b""), lzprint.fingerprint(b"")) == 1.0


def test_edit_likeness_of_hot_missing_ids(spark):
    rows = [(None, "same text of many")] * 3000 + [(None, None)] * 2 + [(7, "a b c d e f")] * 3 + [(7, "other words here"), (9, "last")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    out = lzprint.edit_likeness(table).collect()
    low = -(1 << 63)
    order = sorted(((low if d is None else d, (xxhash.xxh64_intdigest((t or "").encode(), 42) + (1 << 63)) % (1 << 64), t or "", d) for d, t in rows), reverse=True)
    tie = lambda d: d != 9
    order = sorted([(k, s if tie(d) else 0, t, d) for k, s, t, d in order], reverse=True)
    expected = []
    for (_, _, t, d), (_, _, nt, _) in zip(order, order[1:] + order[:1]):
        third = len(t) // 3
        expected.append((d, t[: len(t) - third] + nt[:third], lzprint.likeness(lzprint.fingerprint(t.encode()), lzprint.fingerprint(nt.encode()))))
    assert sorted(((r.doc_id, r.edited, r.near_next) for r in out), key=str) == sorted(expected, key=str)


def test_edit_likeness(docs, texts):
    low = -(1 << 63)
    rows = sorted([(low if d is None else d, t or "", d) for d, t in texts], reverse=True)
    unique = {d for d, _ in texts if [x for x, _ in texts].count(d) == 1}
    found = {r.doc_id: r for r in lzprint.edit_likeness(docs).collect()}
    assert len(lzprint.edit_likeness(docs).collect()) == len(texts)
    for (d, t, own), (nd, nt, following) in zip(rows, rows[1:] + rows[:1]):
        if own in unique and following in unique:
            third = len(t) // 3
            edited = t[: len(t) - third] + nt[:third]
            p, e, n = (lzprint.fingerprint(x.encode()) for x in (t, edited, nt))
            r = found[own]
            assert (r.n_chars, r.edited, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == (len(t), edited, lzprint.spell(p), lzprint.spell(e), lzprint.likeness(p, e), lzprint.likeness(p, n))


@pytest.mark.parametrize("kind", ["lines", "substrings", "tokens"])
def test_rows_without_id_are_dealt_alike_when_tasks_run_again(spark, kind):
    """The rows that are dealt by their place have been written, so a task that runs again reads them in the same order."""
    rows = [(None if i % 3 else i, f"text {i}\nof some lines\nand {i % 5}") for i in range(90)] + [(3, "again")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    if kind == "tokens":
        path = tokenfile.new_path(spark, "again")
        tokenfile.write_tokens(table, path, public_tokenizers.path("word_bpe_49k.json"), 1)
        assert spark.read.parquet(path).count() == 91
        return
    keyed = lines.with_sub(table)
    assert "Scan parquet" in keyed._jdf.queryExecution().executedPlan().toString() and keyed.count() == 91
    out = (lines.dedup_lines if kind == "lines" else substrings.dedup_substrings)(table)
    assert out.count() == 91
