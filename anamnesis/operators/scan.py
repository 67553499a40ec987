"""Point reads, pages and deletes on the live view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schema as S
from .predicates import Predicate, require_constraint


def get(memories: DataFrame, ids: list) -> DataFrame:
    """Rows by id in the order asked, absent ones missing."""
    spark = memories.sparkSession
    wanted = spark.createDataFrame(list(enumerate(ids)), ["pos", "id"]).select("pos", F.col("id").cast(memories.schema["id"].dataType).alias("id"))
    return memories.join(F.broadcast(wanted), "id").orderBy("pos")  # the ids of one call


def page(memories: DataFrame, limit: int = S.SCAN_DEFAULT, after: tuple | None = None, skip: int = 0, predicate: Column | None = None) -> DataFrame:
    """A page in (memory_type, id) order: a keyset cursor keeps deep pages as cheap as the first."""
    rows = memories if predicate is None else memories.where(predicate)
    if after is not None:
        t, i = after
        rows = rows.where((F.col("memory_type") > t) | ((F.col("memory_type") == t) & (F.col("id") > i)))
    rows = rows.orderBy("memory_type", "id")
    return (rows.offset(skip) if skip else rows).limit(min(limit, S.SCAN_MAX))


def key_range(memories: DataFrame, low, high, limit: int | None = None) -> DataFrame:  # type: ignore[no-untyped-def]
    """Rows with an id from low to high, both included, in order; the first of them with a limit.  The bounds reach the scan."""
    rows = memories.where(F.col("id").between(low, high)).orderBy("id")
    return rows if limit is None else rows.limit(limit)


def page_created(memories: DataFrame, limit: int = S.SCAN_DEFAULT, after: tuple | None = None, predicate: Column | None = None) -> DataFrame:
    """A page in (updated_at, id) order over all types; rows without updated_at are never returned."""
    rows = memories.where("updated_at IS NOT NULL")
    if predicate is not None:
        rows = rows.where(predicate)
    if after is not None:
        t, i = after
        rows = rows.where((F.col("updated_at") > t) | ((F.col("updated_at") == t) & (F.col("id") > i)))
    return rows.orderBy("updated_at", "id").limit(min(limit, S.SCAN_MAX))


def delete_eager(memories: DataFrame, predicate: Predicate, delete_all: bool = False) -> DataFrame:
    """Tombstones (id) of all rows that match, for the log."""
    require_constraint(predicate, delete_all)
    return memories.where(predicate.column()).select("id", F.lit("tombstone").alias("kind"))


def payload(memories: DataFrame, vector: bool = False, edges: bool = False) -> DataFrame:
    """All columns but, unless asked for, the vector and the edges."""
    hidden = ([] if vector else ["vector"]) + ([] if edges else ["semantic_out", "causal_out"])
    return memories.drop(*hidden)
