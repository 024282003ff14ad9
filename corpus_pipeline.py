"""A corpus pipeline of five stages: quality, exact copies, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; the first four
keep the columns of documents. ``run`` writes each result to the shared folder and reads it again for the next stage.

Rows are told apart by id and text: rows with a null id, or an id that several texts share, are judged by their own text, and
of rows that repeat both one stays. Null and empty texts go through the classifier like others (with its bias alone), are one
group of exact copies, no near copies, and pack as an end token. Long texts are read whole; extra columns, whatever their
names, are kept to the fourth stage. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberlane.llm import base, exact, jaccard, leaks, packing, quality


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is trained on labelled rows of the documents table."""
    return quality.keep_good(docs, base.table(spark, sf_dir, "labels"), base.table(spark, sf_dir, "documents"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the row with the smallest doc_id stays."""
    return jaccard.keep_one(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return leaks.remove_documents(docs, base.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces of token sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", drop_low_quality),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_passages),
    ("packing", pack),
]

#: Training, packing and the tokenizer are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = base.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
