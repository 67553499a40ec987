"""Cleaning pipeline of a training corpus: five stages over ``documents``, each over all that the one before kept.

Every stage's result is a Parquet table in the shared folder, read again by the
next, so no lineage is longer than a stage and a lost executor costs one stage
at most; it is deleted when the next one is written.  PII is scored iteratively,
which SQL can't express: ORACLE_SQL is None and the tests hold the pipeline
against brute force.

Defined cases: rows without text, or with nothing left of it, go in the first
stage; rows with a null doc_id are judged like others but by their own text only
(they have no near copies); rows that repeat a doc_id are documents of their
own; columns beyond doc_id and text are carried, whatever their names; an empty
table gives an empty result of the last stage's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from anamnesis.llm import bpe, decontamination, ngram_join, pii, quality_rules
from anamnesis.llm.frames import dropped, table, written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line rules; text is what is left of each."""
    return quality_rules.clean(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of similar ones."""
    return ngram_join.without_near_copies(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, identifiers replaced by their kind."""
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, tokens and round_trip of every document."""
    return bpe.bpe(docs)


STAGES = [
    ("quality_rules", rules),
    ("ngram_join", near_copies),
    ("decontamination", benchmark_leaks),
    ("pii", private_data),
    ("bpe", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            dropped(before)
        before = docs
    return docs
