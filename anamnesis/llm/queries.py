"""Queries of this subpackage over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontamination, language_id, license_scan, lm_scoring, ngram_join, pii, quality_classifier, quality_rules, token_counts
from .frames import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_quality_classifier": lambda s, d: quality_classifier.quality_classifier(table(s, d, "documents"), table(s, d, "labels")),
        "op2_ngram_join": lambda s, d: ngram_join.ngram_join(table(s, d, "documents")),
        "op3_decontamination": lambda s, d: decontamination.decontaminate(table(s, d, "documents"), table(s, d, "benchmark")),
        "op4_bpe": lambda s, d: bpe.bpe(table(s, d, "documents")),
        "op5_pii": lambda s, d: pii.pii(table(s, d, "documents")),
        "op6_quality_rules": lambda s, d: quality_rules.quality_rules(table(s, d, "documents")),
        "op7_lm_scoring": lambda s, d: lm_scoring.lm_scores(table(s, d, "documents")),
        "op8_license_scan": lambda s, d: license_scan.license_scan(table(s, d, "documents")),
        "op9_token_counts": lambda s, d: token_counts.token_counts(table(s, d, "documents")),
        "op10_language_id": lambda s, d: language_id.language_id(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_join": ngram_join.SQL, "op6_quality_rules": quality_rules.SQL}
