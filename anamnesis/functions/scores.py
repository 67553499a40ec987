"""Scalar score functions of the graph and temporal arms, and the date cascades."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import schema as S


def entity_score(n: Column) -> Column:
    return F.tanh(n * 0.5)


def temporal_score(n: Column) -> Column:
    return 0.5 * F.tanh(n * 0.5)


def effective_ts() -> Column:
    return F.coalesce("occurred_start", "mentioned_at", "occurred_end")


def best_date() -> Column:
    """Midpoint of start and end, else start, else end, else mention."""
    both = F.expr("occurred_start + (occurred_end - occurred_start) div 2")
    return F.coalesce(both, F.col("occurred_start"), F.col("occurred_end"), F.col("mentioned_at"))


def proximity(date: Column, start: int, end: int) -> Column:
    """1 at the window's centre, 0 at its edges and beyond; an empty window gives 1."""
    if end <= start:
        return F.when(date.isNotNull(), 1.0)
    middle = start + (end - start) // 2
    return 1 - F.least(F.abs(date - middle) / ((end - start) / 2.0), F.lit(1.0))


def causal_boost(kind: Column) -> Column:
    return F.when(kind.isin("CAUSES", "CAUSED_BY"), 2.0).when(kind.isin("ENABLES", "PREVENTS"), 1.5).otherwise(1.0)


def propagate(own: Column, parent: Column, weight: Column, boost: Column) -> Column:
    return F.greatest(own, parent * weight * boost * S.DECAY)


def bucket_of(ts: Column, start: int, end: int) -> Column:
    if end <= start:
        return F.lit(0)
    raw = ((ts - start) / float(end - start) * S.BUCKETS).cast("int")
    return F.coalesce(F.least(F.greatest(raw, F.lit(0)), F.lit(S.BUCKETS - 1)), F.lit(0))


def rrf_term(rank: Column, weight: Column | float = 1.0, k: int = S.RRF_K) -> Column:
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return w / (k + rank + 1)


def uuid5(key: Column) -> Column:
    """Name-based identifier of a key in the OID namespace, lower-case text."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8129dad11d180b400c04fd430c8")), F.encode(key, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
