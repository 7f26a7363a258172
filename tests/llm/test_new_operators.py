"""Conversation repair, token counts and ranked search against brute force and the library."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict
from math import floor, log

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from loomwork.llm import lexical, queries, repair, tokencounts

from ..conftest import SF
from ..test_queries import rows

BYTE = public_tokenizers.path("byte_bpe_50k.json")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def damage(turns):
    """Rows after damage by conversation, and all conversations."""
    out = defaultdict(list)
    for conv, turn, role, text in turns:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        held = out[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def brute(turns):
    """Dijkstra over (place, state) in the order of (cost, audit)."""
    moves = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    found = []
    for conv, held in damage(turns).items():
        codes, seen = [], set()
        for _, role, text in held:
            body = text.strip(SPACE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            codes.append(fault)
        heap, done = [(0, "", 0, "", ())], set()
        while heap:
            cost, audit, at, state, lines = heapq.heappop(heap)
            if (at, state) in done:
                continue
            done.add((at, state))
            if at == len(held) and state in ("", "a"):
                break
            for new, name in (("u", "user"), ("a", "assistant")):
                if new in moves[state]:
                    heapq.heappush(heap, (cost + 2, audit + "I", at, new, (*lines, f"{name}:")))
            if at < len(held):
                heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state, lines))
                _, role, text = held[at]
                if codes[at] in ("", "truncated"):
                    more = codes[at] == "truncated"
                    if role[:1] in moves[state]:
                        heapq.heappush(heap, (cost + more, audit + "K", at + 1, role[:1], (*lines, f"{role}:{text}")))
                    for new, name in (("u", "user"), ("a", "assistant")):
                        if new in moves[state]:
                            heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, new, (*lines, f"{name}:{text}")))
        own = [t for t, _, _ in held if t is not None]
        first = [r[:1] for _, r, _ in held]
        found.append((conv, max(own) - min(own) + 1 - len(set(own)) if own else 0, *(codes.count(f) for f in ("blank", "duplicate", "truncated")),
                      sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(found, key=repr)


def talk(seed, convs, longest):
    rnd = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "unknown", "USER"]
    texts = ["Yes.", "No", "Why? ", "", " \n", None, "Done!\n", "So. ", "again.", "then", "\x1c"]
    return [(c if c else None, rnd.choice([None, t, t + 1, t]), rnd.choice(roles[: rnd.choice([2, 3, 10])]), rnd.choice(texts) if rnd.random() < 0.6 else f"text {rnd.random()}.")
            for c in range(convs) for t in range(rnd.choice([1, 2, 3, longest]))]


SCHEMA = "conv_id long, turn long, role string, text string"


def ours(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_repair_equals_brute_force(spark, seed):
    turns = talk(seed, 120, 12)
    df = spark.createDataFrame([(*t, "x") for t in turns], SCHEMA + ", CONV_ID2 string").repartition(3)
    assert ours(repair.repair(df)) == brute(turns)


def test_repair_of_a_conversation_in_many_parts(spark, monkeypatch):
    rnd = random.Random(5)
    turns = [(7, i, rnd.choice(["user", "assistant", "assistant", "system"]), rnd.choice(["Same.", "", f"own {i}.", f"own {i}"])) for i in range(700)]
    turns += [(8, None, "user", "copied.")] * 900 + [(9, i // 3, "user", f"{i % 50}!") for i in range(400)] + talk(11, 30, 5)
    df = spark.createDataFrame(turns, SCHEMA).repartition(4)
    monkeypatch.setattr(repair, "PART_ROWS", 37)
    assert ours(repair.repair(df)) == brute(turns)


def test_repair_sql_and_query(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{SF}/conversations.parquet')")
    assert rows(queries.op11_repair(spark, SF).toPandas()) == rows(con.sql(queries.oracle_sql()["op11_repair"]).df())


def test_repair_of_nothing(spark):
    df = repair.repair(spark.createDataFrame([], SCHEMA))
    assert df.collect() == [] and [f"{n} {t}" for n, t in df.dtypes] == [c.replace(" long", " bigint") for c in repair.RESULT.split(", ")]


def test_every_state_is_within_the_layers():
    """Costs of states that can be accepted differ by less than the layers that are kept."""
    rnd = random.Random(3)
    for _ in range(200):
        codes = [(rnd.choice("sua?-"), rnd.randint(0, 1)) for _ in range(rnd.randint(0, 40))]
        codes = [(k, 0 if k == "-" else t) for k, t in codes]
        costs = list(repair.FINAL)
        for kind, cut in reversed(codes):
            new = [c + 3 for c in costs]
            for s in range(4):
                if kind != "-":
                    new[s] = min(new[s], costs[repair.NEXT[s]] + 2 + cut)
                    if kind in repair.BEFORE and repair.BEFORE[kind][0] >> s & 1:
                        new[s] = min(new[s], costs[repair.BEFORE[kind][1]] + cut)
            for _ in range(4):
                new = [min(new[s], new[repair.NEXT[s]] + 2) for s in range(4)]
            costs = new
        assert repair.costs_of(*repair.backward(codes, repair.FINAL)[0]) == costs


BITS = [" ", "  ", "\n", "\t", "a", "b.", "'s", "It's", "é", "漢", "12", "!", "...", "🙂", "<|endoftext|>", "　", "Σ", "\x1c", "İ", "́", "word, ", "\x00", "\x85", "'", "", "<|endof", "​", "_x"]


def test_counts_are_those_of_the_library(spark):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 30))) for _ in range(400)] + [None, "", "the " * 5000, "a" * 3000, None]
    library = Tokenizer.from_file(BYTE)
    rowed = [(None if i == 7 else i % 390, t, "n") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rowed, "doc_id long, text string, Text string" if spark.conf.get("spark.sql.caseSensitive") == "true" else "doc_id long, text string, n_tokens string").repartition(3)
    got = Counter(map(tuple, tokencounts.token_counts(df, BYTE, limit=20, entries=64).collect()))
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rowed]
    assert got == Counter((*w, w[2] > 20) for w in want)
    assert tokencounts.token_counts(df.limit(0), BYTE).collect() == []


def test_counts_of_the_query(spark):
    library = Tokenizer.from_file(BYTE)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in docs}
    assert {r.doc_id: r.n_tokens for r in queries.op12_token_counts(spark, SF).collect()} == want


def test_table_and_small_cache():
    table = tokencounts.LengthTable.of([b"a", b"bc", b" d"], [1, 2, 3])
    assert table.find([b" d", b"x", b"a", b"", b"bc"]).tolist() == [3, -1, 1, -1, 2]
    counter, library = tokencounts.Counter(tokencounts.Cutter(BYTE), table.of([], []), keep=3), Tokenizer.from_file(BYTE)
    texts = ["one two three four five", "two six\n\nseven", "one"] * 3
    assert counter.count(pa.array(texts)).tolist() == [len(library.encode(t).ids) for t in texts]
    assert len(counter.young) <= 3 + len({w for t in texts for w in t.split()})


def test_vocabularies_with_other_rules_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        tokencounts.Cutter(public_tokenizers.path("word_bpe_49k.json"))


def ranked(docs, items, k=10):
    term = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    bags = [(i, Counter(term(t))) for i, t in docs]
    n, length = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(term(t))
    out = []
    for item, own in asked.items():
        scores = []
        for doc, bag in bags:
            size = sum(bag.values())
            m = 10 + 90 * size * n // max(1, length)
            score = sum(floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in own if bag[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return sorted(out, key=repr)


def test_search_equals_brute_force(spark, monkeypatch):
    rnd = random.Random(4)
    words = [*(f"w{i}" for i in range(60)), "É", "é", "漢字", "The", "the", "x1", "--", "\x7f", "a_b"]
    docs = [(None if i % 40 == 0 else i % 270, rnd.choice([None, "", " . "]) if rnd.random() < 0.05 else " ".join(rnd.choices(words, [1 / (j + 1) for j in range(len(words))], k=rnd.randint(1, 60)))) for i in range(300)]
    docs += [docs[5]] * 3 + [(500, "w1 " * 4000)]
    items = [(i if i else None, " ".join(rnd.choices(words, k=rnd.randint(1, 12)))) for i in range(12)] + [(3, "w7 w7 the"), (90, None), (91, "!"), (92, "nowhere")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, rank string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = ranked(docs, items)
    assert ours(lexical.search(df, asked)) == want
    monkeypatch.setattr(lexical, "RANGE", 16)  # many looks at the limit
    assert ours(lexical.search(df, asked, most=20)) == want  # several blocks of items
    assert lexical.search(df.limit(0), asked).collect() == [] and lexical.search(df, asked.limit(0)).collect() == []


def test_probing_leaves_documents_out():
    """Ranges after the first look only at documents that an essential term holds."""
    n = 5000
    ids = pa.array(range(n))
    doc = [*range(n), *range(0, n, 100)]
    term = [0] * n + [1] * len(range(0, n, 100))
    b = lexical.Builder()
    import numpy as np
    b.add(ids, np.full(n, 5), np.array(doc), np.array(term), np.ones(len(doc), np.int64))
    row = b.shard()
    shard = lexical.Shard(*(row.column(i)[0].as_py() for i in (2, 3, 4)), np.array([1, 4000]), n, 5 * n)
    place, score = shard.best(np.array([0, 1]), 10)
    assert place.tolist() == list(range(0, 1000, 100)) and len(set(score.tolist())) == 1


def test_search_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    assert rows(queries.op13_search(spark, SF).toPandas()) == rows(con.sql(queries.oracle_sql()["op13_search"]).df())
