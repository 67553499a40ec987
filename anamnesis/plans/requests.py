"""Whole requests over a stored index: the arms asked for, merged, filtered and hydrated; and the calls built on them."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S
from ..functions.text import query_terms
from ..operators import arms, fusion, scan
from .index import Index, held


@dataclass(frozen=True)
class Request:
    """An arm runs if what it needs is given and its depth is above 0: dense a vector, text a text, graph a vector, temporal a vector and both bounds."""

    vector: list[float] | None = None
    text: str | None = None
    memory_types: list[int] = field(default_factory=list)
    start: int | None = None
    end: int | None = None
    dense_depth: int = S.DEFAULT_DEPTH
    text_depth: int = S.DEFAULT_DEPTH
    graph_depth: int = S.GRAPH_BUDGET
    temporal: bool = True
    seed_floor: float | None = S.SEED_FLOOR
    predicate: Column | None = None
    include_vector: bool = False
    include_edges: bool = False
    digits: int | None = None


def lists(index: Index, r: Request) -> dict[str, DataFrame]:
    """The ranked list of each arm that runs."""
    m = index.memories
    if r.memory_types:
        m = m.where(F.col("memory_type").isin(*r.memory_types))
    allowed = m if r.predicate is None else m.where(r.predicate)
    out: dict[str, DataFrame] = {}
    if r.vector is not None:
        nearest = held(arms.dense(allowed, r.vector, max(r.dense_depth, S.MAX_SEEDS), digits=r.digits))
        if r.dense_depth:
            out["dense"] = nearest.where(F.col("rank") < r.dense_depth)
        if r.graph_depth and r.dense_depth:
            seeds = held(arms.seeds_of(nearest, S.SEED_FLOOR if r.seed_floor is None else r.seed_floor))
            out["graph"] = arms.graph(m, index.edges_of(seeds), seeds, r.graph_depth, r.predicate, r.digits)
        if r.temporal and r.start is not None and r.end is not None:
            points = held(arms.entry_points(m, r.vector, r.start, r.end, r.predicate, r.digits))
            out["temporal"] = arms.temporal(m, index.edges_of(points), points, r.start, r.end, r.predicate, r.digits)
    if r.text and r.text_depth:
        terms = [t for f, t in query_terms(r.text) if f == "words"]
        condition = F.col("memory_type").isin(*r.memory_types) if r.memory_types else None
        if r.predicate is not None:
            condition = r.predicate if condition is None else condition & r.predicate
        out["text"] = index.text(terms, r.text_depth, condition, r.digits)
    return out


def hydrated(hits: DataFrame, memories: DataFrame, vector: bool = False, edges: bool = False) -> DataFrame:
    """Hits with their rows; hits whose row is gone fall out."""
    return hits.join(scan.payload(memories, vector, edges), ["memory_type", "id"])


def run(index: Index, r: Request) -> DataFrame:
    """Rows of all types together, in no order, with the score and rank that each arm gave them."""
    found = lists(index, r)
    if not found:
        raise ValueError("no arm has what it needs")
    return hydrated(arms.merge(found), index.memories, r.include_vector, r.include_edges)


def with_floors(hits: DataFrame, dense_min: float | None = None, text_min: float | None = None, temporal_min: float | None = None) -> DataFrame:
    """Hits of which an arm's score reaches its floor; a temporal hit goes if its dense score is known and below temporal_min."""
    kept = []
    if "dense_score" in hits.columns:
        kept.append(F.col("dense_score").isNotNull() if dense_min is None else F.col("dense_score") >= dense_min)
    if "text_score" in hits.columns:
        kept.append(F.col("text_score").isNotNull() if text_min is None else F.col("text_score") >= text_min)
    if "graph_score" in hits.columns:
        kept.append(F.col("graph_score").isNotNull())
    if "temporal_score" in hits.columns:
        own = F.col("temporal_score").isNotNull()
        if temporal_min is not None and "dense_score" in hits.columns:
            own = own & (F.col("dense_score").isNull() | (F.col("dense_score") >= temporal_min))
        kept.append(own)
    return hits.where(F.coalesce(reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), kept), F.lit(False))) if kept else hits


def search(index: Index, vector: list[float], text: str | None, limit: int, memory_types: list[int], dense_min: float = 0.0, text_min: float = 0.0, predicate: Column | None = None, digits: int | None = None) -> DataFrame:
    """Dense (at least 100 deep) and text lists of each type above their floors: (list, memory_type, id, rank, score), limit a list."""
    r = Request(vector, text, memory_types, dense_depth=max(5 * limit, 100), text_depth=limit, graph_depth=0, temporal=False, predicate=predicate, digits=digits)
    found, floor = lists(index, r), {"dense": dense_min, "text": text_min}
    parts = [df.where((F.col("score") >= floor[k]) & (F.col("rank") < limit)).select(F.lit(k).alias("list"), "memory_type", "id", "rank", "score") for k, df in found.items()]
    return reduce(lambda a, b: a.union(b), parts)


def temporal_search(index: Index, vector: list[float], start: int, end: int, limit: int, memory_types: list[int], dense_min: float = 0.1, digits: int | None = None) -> DataFrame:
    """The first rows of each type by the temporal arm, without those that the dense arm knows to be far from the query."""
    r = Request(vector, None, memory_types, start, end, dense_depth=max(5 * limit, 100), graph_depth=0, digits=digits)
    found = lists(index, r)
    far = found["dense"].where(F.col("score") < dense_min).select("memory_type", "id")
    near = found["temporal"].join(far, ["memory_type", "id"], "left_anti")
    return arms.top(near.select("memory_type", "id", "score"), limit)


def graph_search(index: Index, vector: list[float], limit: int, memory_types: list[int], predicate: Column | None = None, digits: int | None = None) -> DataFrame:
    """The first rows of each type by the graph arm, at least 50 deep before the filter."""
    r = Request(vector, None, memory_types, graph_depth=max(2 * limit, 50), temporal=False, digits=digits)
    found = lists(index, r)["graph"]
    if predicate is not None:
        found = found.join(index.memories.where(predicate).select("memory_type", "id"), ["memory_type", "id"], "left_semi")
    return arms.top(found.select("memory_type", "id", "score"), limit)


def fused(index: Index, r: Request, k: int, weights: dict[str, float] | None = None) -> DataFrame:
    """One list a type by reciprocal rank, with its rows."""
    return hydrated(fusion.rrf(lists(index, r), k, weights, r.digits), index.memories, r.include_vector, r.include_edges)
