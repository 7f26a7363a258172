"""Extra columns, whatever their names, change no operator's result."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomwork.llm import bpe, hnsw, lexical, lzprint, packing, repair, tokencounts, tokenfile
from loomwork.llm.shared import new_path

BYTE, WORDS, RANKS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"))
EXTRA = ("TEXT", "_k", "_s", "_n", "_again", "shard", "ids", "sequence_id", "rank", "score", "part", "n", "digest", "bucket", "Length")


def tokens(spark, docs):
    path = new_path(spark, "clash")
    tokenfile.write_tokens(docs, path, WORDS, 1)
    return spark.read.parquet(path)


RUNS = {
    "packing": lambda s, d: packing.pack_documents(d, BYTE, end_id=2, capacity=16).drop("sequence_id", "offset"), "tokenfile": tokens,
    "bpe": lambda s, d: bpe.encode_and_decode(d, RANKS, public_tokenizers.PATTERN), "lzprint": lambda s, d: lzprint.edit_likeness(d),
    "tokencounts": lambda s, d: tokencounts.token_counts(d, BYTE, limit=5), "lexical": lambda s, d: lexical.search(d, d.filter("doc_id < 3").withColumn("item_id", F.col("doc_id"))),
    "repair": lambda s, d: repair.repair(d.withColumns({"conv_id": F.col("doc_id") % 3, "turn": F.col("doc_id"), "role": F.lit("user")}).withColumn("CONV_ID_", F.lit(9))),
    "hnsw": lambda s, d: hnsw.search(d.withColumns({"vec_id": F.col("doc_id"), "embedding": F.array(F.col("doc_id").cast("float") + 1, F.lit(1.0).cast("float"))}).filter("doc_id is not null"),
                                     d.filter("doc_id < 2").withColumns({"vec_id": F.col("doc_id"), "embedding": F.array(F.col("doc_id").cast("float") + 1, F.lit(1.0).cast("float"))}), k=2)}


@pytest.mark.parametrize("kind", sorted(RUNS))
def test_clashing_names(spark, kind):
    rows = [(i if i else None, " ".join(f"w{j % (i + 1)}" for j in range(i * 3))) for i in range(9)] + [(4, "again"), (7, None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    more = plain.select("*", *[F.lit(k).alias(n) for k, n in enumerate(EXTRA)])
    found = [sorted(repr(tuple(r)) for r in RUNS[kind](spark, df).collect()) for df in (plain, more.toDF("doc_id", "text", *EXTRA))]
    assert found[0] == found[1] and found[0]
