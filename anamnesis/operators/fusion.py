"""Reciprocal rank fusion of ranked lists (arm, id, rank from 0)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import schema as S
from ..functions.scores import rrf_term
from .arms import _rounded


def ranked(arms: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """All lists as one, without those of weight 0."""
    rows = None
    for name, df in arms.items():
        w = 1.0 if weights is None else weights.get(name, 1.0)
        if w == 0:
            continue
        part = df.select("memory_type", "id", F.lit(name).alias("arm"), rrf_term(F.col("rank"), w).alias("part"))
        rows = part if rows is None else rows.union(part)
    return rows


def rrf(arms: dict[str, DataFrame], k: int, weights: dict[str, float] | None = None, digits: int | None = None) -> DataFrame:
    """Top k of each type by the sum of weight / (60 + rank + 1), then id."""
    total = ranked(arms, weights).groupBy("memory_type", "id").agg(_rounded(F.sum("part"), digits).alias("score"))
    w = Window.partitionBy("memory_type").orderBy(F.desc("score"), "id")
    return total.withColumn("rank", (F.row_number().over(w) - 1).cast("int")).where(F.col("rank") < k)


def contributions(arms: dict[str, DataFrame], weights: dict[str, float] | None = None, digits: int | None = None) -> DataFrame:
    """What each arm adds to the fused score of a hit."""
    return ranked(arms, weights).groupBy("memory_type", "id").agg(
        _rounded(F.sum("part"), digits).alias("score"), F.map_from_entries(F.collect_list(F.struct("arm", _rounded(F.col("part"), digits)))).alias("parts")
    )


RRF_K = S.RRF_K
