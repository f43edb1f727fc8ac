"""A corpus from documents to tokens: quality, near duplicates, repeated passages, benchmarks, tokens.

Each stage takes what the one before kept, written as Parquet and read again. Which rows stay: documents that
the quality rules keep, one document of each group of near duplicates, and those that aren't contaminated.
Repeated passages are cut out of the texts of documents that stay. The last stage has a row for each of them.

The stages handle nulls, empty tables and repeated rows as the docstrings of their operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from isotherm.llm import op3_substring, op4_decontaminate, op5_bpe, op6_quality, op7_simhash, shared
from isotherm.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't depleted of lines of their own."""
    return op6_quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates."""
    return op7_simhash.keep(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that a document with a smaller doc_id has."""
    return op3_substring.clean(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more of the benchmark than the rule allows."""
    return op4_decontaminate.keep(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and ids of each document; decoded_sha256 is of the text that the ids give."""
    return op5_bpe.digests(docs, vocabulary(), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", bpe),
]

#: SQL has no byte-level BPE and no XXH64; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = shared.table_path(spark, f"pipeline-{name}")
        docs = shared.written(stage(spark, docs, sf_dir), name, path)
        if before:  # nothing reads it any more
            shared.emptied(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
