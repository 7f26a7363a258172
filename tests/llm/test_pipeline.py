"""Each stage of the pipeline on its own input against a plain version, and run() against its stages."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from loomwork.llm.quality import quality_scores

from ..conftest import SF
from .test_text_operators import WORD, plain_line_dedup, plain_windows


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before the first stage and after each one, and the last frame."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [{r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == list(corpus_pipeline.COLUMNS) and docs.filter("n_chars <> length(text)").isEmpty()
        out.append({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    return out, corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()


def test_quality_stage(spark, stages):
    before, after = stages[0][0], stages[0][1]
    good = {r.doc_id for r in quality_scores(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1").collect()}
    assert after == {d: t for d, t in before.items() if d in good}
    assert not {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0").collect()} & set(after)


def test_line_stage(stages):
    before, after = stages[0][1], stages[0][2]
    assert after == {d: text for d, (text, _) in plain_line_dedup(list(before.items())).items()}


def test_near_duplicate_stage(stages):
    """What goes is linked to a smaller doc_id by pairs of a similarity of 0.8; of what should go, nine tenths do."""
    before, after = stages[0][2], stages[0][3]
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    grams = {}
    for d, t in before.items():
        words = WORD.findall(lower(t))
        grams[d] = {tuple(words[i: i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())
    label = {d: d for d in before}
    for a in sorted(before):
        for b in sorted(before):
            both = len(grams[a] & grams[b])
            if a < b and both >= 0.8 * (len(grams[a]) + len(grams[b]) - both):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {d: new if x == old else x for d, x in label.items()}
    due = {d for d in before if label[d] != d}
    went = set(before) - set(after)
    assert went <= due and len(went) >= 0.9 * len(due) and due and all(after[d] == before[d] for d in after)


def test_substring_stage(stages):
    before, after = stages[0][3], stages[0][4]
    for d, text, words, gone in plain_windows(list(before.items()), 50):
        assert WORD.findall(after[d]) == [w for w, g in zip(words, gone) if not g]
        assert any(gone) or after[d] == text


def test_packing_stage_and_run(spark, stages):
    kept, pieces = stages[0][4], stages[1]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    expected = Counter()
    for d, t in kept.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        edges = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        expected.update((d, k, i, j - i, zlib.crc32(np.array(ids[i:j], "<u4").tobytes())) for k, (i, j) in enumerate(zip(edges, edges[1:])))
    assert Counter(pieces[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == expected
    rows = pieces.sort_values(["sequence_id", "offset"])
    assert (rows.offset == rows.groupby("sequence_id").length.cumsum() - rows.length).all() and rows.groupby("sequence_id").length.sum().max() <= 1024
    whole = corpus_pipeline.run(spark, SF).toPandas()
    digest = lambda df: hashlib.sha256(repr(sorted(df[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))).encode()).hexdigest()
    assert digest(whole) == digest(pieces) and whole.sequence_id.nunique() == pieces.sequence_id.nunique()
