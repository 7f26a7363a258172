"""Encoding, packing, token files, BPE, the classifier, neighbours and the pipeline."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loomwork.llm import bpe, hnsw, packing, quality, tokenfile
from loomwork.llm.encoder import UnitEncoder
from loomwork.llm.shared import new_path

from ..conftest import SF

BYTE, WORDS, RANKS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(9)
    bits = [" ", "  ", "\n", "\t", "a", "b.", "'s", "It's", "é", "漢", "12", "!", "...", "🙂", "<|endoftext|>", "\u3000", "Σ", "\x1c", "İ", "\u0301", "word, ", "Word. "]
    out = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))) for _ in range(150)]
    return [*out, None, "", "the " * 5000, out[0]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3 % 151 if i < 150 else i + 100, t, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "no id", "x", 1), (7, "again", "x", 1)], "doc_id long, text string, Length string, part int").repartition(3).cache()


def library(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_units_give_the_library_ids(path, texts):
    encode, ours = library(path), UnitEncoder(path, keep=50)
    for _ in range(3):
        flat, bounds = ours.encode(pa.array(texts, pa.string()), 2)
        assert [flat[i:j].tolist() for i, j in zip(bounds, bounds[1:])] == [[*encode(t), 2] for t in texts]
    assert ours.encode(pa.array([], pa.string()), 2)[1].tolist() == [0]


@pytest.mark.parametrize("seed", range(6))
def test_plan_fills_sequences_without_gaps(seed):
    rnd = random.Random(seed)
    lengths = Counter(rnd.choice([rnd.randint(1, 64), 64, 33, 3]) for _ in range(rnd.randint(1, 400)))
    places = {}
    for length, rank, count, first, offset, per in packing.plan(dict(lengths), 64):
        for r in range(count):
            places.setdefault(first + r // per, []).append((offset + r % per * length, length))
            lengths[length] -= 1
    assert not any(lengths.values())
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    rooms = []  # plain best-fit decreasing, item by item
    for length in sorted((length for own in places.values() for _, length in own), reverse=True):
        fitting = [r for r in rooms if r >= length]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - length)
        else:
            rooms.append(64 - length)
    assert len(places) == len(rooms)


def test_packing_gives_memory_back(monkeypatch):
    """A worker that has encoded tens of MB of text for packing keeps its encoder, and little of what the batches took."""

    class Table:
        columns = ["doc_id", "text"]
        select = lambda self, *names: self
        mapInArrow = lambda self, run, schema: run  # noqa: E731, N815

    class Task:
        partitionId = staticmethod(lambda: 0)  # noqa: N815

    def anonymous():
        with open("/proc/self/status") as status:
            return next(int(x.split()[1]) for x in status if x.startswith("RssAnon")) / 1024

    rnd = np.random.default_rng(4)
    words = np.array(["".join(w) for w in rnd.choice(list("etaoinshrdlu"), (40_000, 6))])
    text = [" ".join(words[rnd.integers(0, len(words), 400)]) for _ in range(4000)]  # 11 MB
    monkeypatch.setattr(packing.TaskContext, "get", staticmethod(Task))
    run = packing.pieces(Table(), BYTE, 2, 1024)
    batch = pa.record_batch([pa.array(range(len(text))), pa.array(text)], ["doc_id", "text"])
    list(run(iter([batch.slice(0, 1)])))
    before = anonymous()
    done = sum(b.num_rows for b in run(iter([batch, batch, batch])))
    assert done >= 3 * len(text) and anonymous() - before < 40


def test_packing(spark, docs):
    encode, rows = library(BYTE), packing.pack_documents(docs, BYTE, capacity=256).toPandas()
    expected = []
    for d in docs.select("doc_id", "text").collect():
        ids, start = [*encode(d.text), 2], 0
        for k in range(-(-len(ids) // 256)):
            size = (len(ids) - 1) % 256 + 1 if k == 0 else 256
            expected.append((d.doc_id, k, start, size, zlib.crc32(np.array(ids[start: start + size], "<u4").tobytes())))
            start += size
    found = [(None if np.isnan(d) else int(d), *r) for d, *r in rows[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert Counter(found) == Counter(expected)
    rows = rows.sort_values(["sequence_id", "offset"])
    assert (rows.offset == rows.groupby("sequence_id").length.cumsum() - rows.length).all() and rows.groupby("sequence_id").length.sum().max() <= 256
    assert packing.pack_documents(docs.limit(0), BYTE).count() == 0


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_file_round_trip(spark, docs, encoding):
    path, encode = new_path(spark, "t"), library(WORDS)
    tokenfile.write_tokens(docs, path, WORDS, 1, encoding=encoding)
    rows = tokenfile.read_tokens(spark, path).orderBy("start").collect()
    assert Counter((r.doc_id, tuple(r.tokens)) for r in rows) == Counter((d.doc_id, (*encode(d.text), 1)) for d in docs.collect())
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]]
    ids = [r.doc_id for r in rows]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    meta = tokenfile.read_tokens(spark, path, tokens=False)
    assert "tokens" not in meta.columns and meta.count() == len(rows)
    sums = {(r.start, r.ids_crc32) for r in tokenfile.token_checksums(tokenfile.read_tokens(spark, path)).collect()}
    assert sums == {(r.start, zlib.crc32(np.array(r.tokens, "<u4").tobytes())) for r in rows}


def test_bpe_round_trip(spark, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = bpe.encode_and_decode(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in found) == Counter((d.doc_id, tuple(plain.encode_ordinary(d.text or "")), (d.text or "").encode()) for d in docs.collect())
    assert bpe.encode_and_decode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_ranks_round_trip():
    rnd = np.random.default_rng(4)
    for high in (1, 224, 225, 6368, 6369, bpe.RANKS - 1, bpe.RANKS, 1 << 33):
        numbers = np.r_[rnd.integers(0, high, 500), [0, high - 1, high // 2]]
        assert (bpe.unpack_ranks(bpe.pack_ranks(numbers)) == numbers).all()
    assert len(bpe.unpack_ranks(bpe.pack_ranks(np.zeros(0, np.int64)))) == 0


def test_bpe_of_repeated_blocks_and_shuffled_rows(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    huge = "some words, and more\nof them 12 " * 400_000  # two of these make blocks that are equal
    rows = [(i, "the same text") for i in range(64)] + [(64, huge), (65, huge), (None, None), (None, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(16).repartition(8, F.rand())
    found = bpe.encode_and_decode(table, RANKS, public_tokenizers.PATTERN)
    digests = found.select("doc_id", F.sha2("decoded", 256).alias("d"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("i"))
    own = {t: (hashlib.sha256(t.encode()).hexdigest(), hashlib.sha256(",".join(map(str, plain.encode_ordinary(t))).encode()).hexdigest()) for t in {t or "" for _, t in rows}}
    assert Counter(tuple(r) for r in digests.collect()) == Counter((d, *own[t or ""]) for d, t in rows)


def test_token_file_of_hot_missing_ids(spark):
    rows = [(None, "no id")] * 900 + [(None, f"{i}") for i in range(50)] + [(4, "four")] * 500 + [(4, "vier"), *((i, f"text {i}") for i in range(300))]
    path, encode = new_path(spark, "t"), library(WORDS)
    tokenfile.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), path, WORDS, 1)
    found = tokenfile.read_tokens(spark, path).orderBy("start").collect()
    assert Counter((r.doc_id, tuple(r.tokens)) for r in found) == Counter((d, (*encode(t), 1)) for d, t in rows)
    assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1]]
    ids = [r.doc_id for r in found]
    assert ids[:950] == [None] * 950 and ids[950:] == sorted(ids[950:])
    assert len({r.shard for r in found if r.doc_id is None}) > 1


def test_quality_stage_keeps_what_scores_half(spark, docs):
    sf = SF.replace("0.001", "0.01")
    labels, rows = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/documents.parquet").withColumn("_score", F.lit("x"))
    good = {r.doc_id for r in quality.quality_scores(rows, labels).filter("predicted = 1").collect()}
    kept = quality.keep_good(rows, labels)
    assert kept.columns == rows.columns and {r.doc_id for r in kept.collect()} == good
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.keep_good(docs, none).count() == docs.count() and quality.keep_good(docs.limit(0), none).count() == 0


def test_quality_on_held_out_labels(spark):
    sf = SF.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.quality_scores(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_quality_without_labels_and_with_awkward_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {(r.score, r.predicted) for r in quality.quality_scores(docs, none).collect()} == {(0.5, 1)}
    odd = spark.createDataFrame([(0, 1), (0, 0), (None, 1), (3, None), (6, 1), (9, 0)], "doc_id long, quality int")
    assert quality.quality_scores(docs, odd).count() == docs.count() and quality.quality_scores(docs.limit(0), odd).count() == 0


def test_isotonic():
    out = quality.isotonic(np.array([1.0, 2, 1, 1]), np.array([0.0, 2, 0, 1]))
    assert out.tolist() == pytest.approx([0, 2 / 3, 2 / 3, 1]) and (np.diff(out) >= 0).all()


def test_neighbours(spark):
    rnd = np.random.default_rng(3)
    vectors = rnd.normal(size=(3000, 16)).astype(np.float32)
    vectors[1000:1400] = vectors[7]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    odd = [(3001, None, "x"), (3002, [0.0] * 16, "x"), (3003, [float("nan")] + [1.0] * 15, "x"), (3004, [None] + [1.0] * 15, "x"), (None, [1.0] * 16, "x"), (3100, [1.0, 2.0], "x"), (3101, [1.0, 3.0], "x")]
    table = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>, rank string").repartition(4)
    found = hnsw.search(table, table.filter("vec_id % 100 = 0"), 10, shard_rows=1000).toPandas()
    hits = total = 0
    for q in range(0, 3000, 100):
        dist = np.sqrt(((vectors.astype(float) - vectors[q].astype(float)) ** 2).sum(axis=1))
        dist[q] = np.inf
        best = np.lexsort((np.arange(3000), dist))[:10]
        own = found[found.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and own.score.tolist() == dist[own.vec_id].tolist()
        hits, total = hits + len(set(best) & set(own.vec_id)), total + 10
    assert hits / total >= 0.9
    assert found[found.query_id == 3100].vec_id.tolist() == [3101] and set(found.query_id) == {*range(0, 3000, 100), 3100}
    assert hnsw.search(table.limit(0), table, 10).count() == 0


@pytest.mark.parametrize("kind", ["offset", "far", "tiny", "huge", "clusters", "outlier", "double"])
def test_neighbours_of_shifted_and_scaled_vectors(kind):
    rnd = np.random.default_rng(6)
    x = rnd.normal(size=(1500, 12))
    x = {"offset": 100 + 0.05 * x, "far": 1000 + 0.01 * x, "tiny": 1e-25 * x, "huge": 1e20 * x, "clusters": np.repeat(x[:30] * 10, 50, axis=0) + 1e-3 * x,
         "outlier": np.r_[x[1:], np.full((1, 12), 1e30)], "double": 1e200 * x}[kind]
    x = x if kind == "double" else x.astype(np.float32)
    own = np.arange(0, 1500, 25)
    found = {}
    for query, rows, dist in hnsw.Index(np.arange(1500), x).search(own, x[own], 10):
        for q, r, d in zip(query.tolist(), rows.tolist(), dist.tolist()):
            found.setdefault(q, []).append((d, r))
    hits = 0
    for i, o in enumerate(own.tolist()):
        gap = x.astype(np.float64) - x[o].astype(np.float64)
        scale = np.abs(gap).max()
        dist = np.sqrt(((gap / scale) ** 2).sum(axis=1))
        dist[o] = np.inf
        hits += len(set(np.lexsort((np.arange(1500), dist))[:10].tolist()) & {r for _, r in found[i]})
        assert len(found[i]) == 10 and found[i] == sorted(found[i]) and np.allclose([d / scale for d, _ in found[i]], dist[[r for _, r in found[i]]])
    assert hits >= 0.9 * 10 * len(own)


def test_neighbours_returns_all_candidates_where_they_are_few(spark):
    rows = [(i, [float(i), 1.0]) for i in range(7)] + [(i, [3.0, 1.0]) for i in range(100, 104)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = hnsw.search(table, table.filter("vec_id = 100"), 20, shard_rows=4).collect()
    assert [r.vec_id for r in sorted(found, key=lambda r: r.rank)] == [3, 101, 102, 103, 2, 4, 1, 5, 0, 6]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF).cache()
        assert kept.columns == list(corpus_pipeline.COLUMNS), name
        assert 0 < kept.count() <= docs.count() and kept.filter("n_chars <> length(text)").isEmpty()
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert pieces.select("doc_id").distinct().count() == kept.count()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "simhash_near_dedup", "substring_dedup", "best_fit_packing"]
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0").collect()}
    assert not bad & {r.doc_id for r in kept.select("doc_id").collect()}


def test_digests_follow_operators(spark):
    text = "the cat"
    row = bpe.encode_and_decode(spark.createDataFrame([(1, text)], "doc_id long, text string"), RANKS, public_tokenizers.PATTERN).first()
    assert hashlib.sha256(bytes(row.decoded)).hexdigest() == hashlib.sha256(text.encode()).hexdigest()
