"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and all that its predecessor kept. All
but the last return the columns of documents; others are left out. Null texts
count as empty and stay null, rows without doc_id are never taken for a
duplicate, repeated rows are each kept or dropped like one, and empty tables
give empty results. The operators' docstrings have the details.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.lines import dedup_lines
from loomwork.llm.packing import pack_documents
from loomwork.llm.quality import keep_good
from loomwork.llm.shared import cut
from loomwork.llm.simhash import keep_one_of_each
from loomwork.llm.substrings import dedup_substrings

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _counted(docs: DataFrame) -> DataFrame:
    """The columns of documents, with ``n_chars`` as the text now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; empty texts are scored like any other, and without labels all stay."""
    return keep_good(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Content-defined chunks of lines that an earlier place holds go, with the lines around them that do too; a document may become empty."""
    return _counted(dedup_lines(docs.select(*COLUMNS)))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (linked by pairs of a Jaccard similarity of 0.8 or more) stays: the one of smallest doc_id."""
    return keep_one_of_each(docs.select(*COLUMNS))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document of smaller doc_id holds go; the rest keeps its layout."""
    return _counted(dedup_substrings(docs.select(*COLUMNS), width=50, keep_layout=True))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of at most 1024 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [(f.__name__, f) for f in (quality_classifier, line_dedup, simhash_near_dedup, substring_dedup, best_fit_packing)]

#: SQL has no expression for the classifier; tests hold each stage on its own input against a plain version, and run() against its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
