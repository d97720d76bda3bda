"""A corpus from raw documents to token ids: each stage's result is the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from retentio.llm import bpe, mixing, queries, rules, simhash, spans
from retentio.session import materialize, prepare


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality rules reject go; no text is changed."""
    return rules.accepted(docs)


def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies stays (SimHash)."""
    return simhash.deduplicated(docs, queries.SIMHASH_SHINGLE, queries.SIMHASH_BITS)


def repeated_spans(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Words of passages that repeat across documents go; texts without any stay as they are."""
    kept = spans.without_repeats(docs, queries.WINDOW).drop("n_words", "n_removed", "removed_spans")
    return queries.counted(kept).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in training order, repeated or left out as their source's target demands."""
    planned = materialize(mixing.plan(docs, queries.WEIGHTS, queries.CURRICULUM, queries.MAX_REPEATS), "mixture")
    return mixing.mix(docs, planned)


def token_ids(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of every document, and the byte offset at which each token ends."""
    return bpe.encode(docs, queries.RANKS).drop("text")


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("repeated_spans", repeated_spans),
    ("mixture", mixture),
    ("token_ids", token_ids),
]

# SimHash bits and byte pair merges have no SQL; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; between stages the documents are a written table."""
    docs = prepare(spark).read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
