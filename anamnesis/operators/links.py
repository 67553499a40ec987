"""Links between memories: derivation by similarity, edges, and their pruning."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from .. import schema as S
from ..functions.vector import f16
from . import blocks


def _side(memories: DataFrame) -> DataFrame:
    return memories.where(F.size("vector") > 0).select(F.col("memory_type").cast("int").alias("grp"), "id", F.col("batch").cast("long").alias("batch"), "vector")


def _linkable(a, ba, b, bb):  # type: ignore[no-untyped-def]
    return (bb <= ba) & (a != b)


def derive_links(memories: DataFrame, threshold: float = S.LINK_THRESHOLD, most: int = S.MAX_LINKS, digits: int | None = None, new: DataFrame | None = None, block: int | None = None) -> DataFrame:
    """(memory_type, src, dst, weight): the nearest rows of the same type, from an earlier batch or the same, at half precision.

    Exact.  new: only these rows get links, to memories (which they are part of): what a write derives.  Both sides are
    multiplied in blocks, each of which returns ``most`` rows a source at most; a window keeps the best.
    """

    near = blocks.product(_side(memories if new is None else new), _side(memories), digits, threshold, most, _linkable, block)
    w = Window.partitionBy("grp", "a").orderBy(F.desc("s"), "b")
    kept = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return kept.select(F.col("grp").alias("memory_type"), F.col("a").alias("src"), F.col("b").alias("dst"), F.round(f16(F.col("s")), 9).alias("weight"))


def links_of(memories: DataFrame, ids: list, threshold: float = S.LINK_THRESHOLD, most: int = S.MAX_LINKS, digits: int | None = None) -> DataFrame:
    """Those of derive_links that go out of or into a few rows, without deriving the others.

    A row that has none of them among its first links to these rows and a share of all (which shrinks with the root of
    their number) has none among its first links to all rows; the few other rows get their links from all rows.
    """
    own = F.col("id").isin(ids)
    n = memories.where(F.size("vector") > 0).count()
    share = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(max(1, round(math.sqrt(n) / 16)))) == 0
    near = blocks.product(_side(memories), _side(memories.where(own | share)), digits, threshold, most, _linkable).where(F.col("b").isin(ids) & ~F.col("a").isin(ids))
    sources = near.select(F.col("grp").alias("memory_type"), F.col("a").alias("id"))
    some = memories.select(F.col("memory_type").cast("int"), "id", "batch", "vector")
    new = some.join(sources, ["memory_type", "id"], "left_semi").union(some.where(own))
    return derive_links(memories, threshold, most, digits, new).where(F.col("src").isin(ids) | F.col("dst").isin(ids))


def similar(memories: DataFrame, threshold: float, digits: int | None = None, block: int | None = None) -> DataFrame:
    """(src, dst, s), src < dst, of the rows of one type with a similarity of the threshold or more."""

    return blocks.product(_side(memories), _side(memories), digits, threshold, ok=lambda a, ba, b, bb: a < b, block=block).select(F.col("a").alias("src"), F.col("b").alias("dst"), "s")


def causal_edges(memories: DataFrame) -> DataFrame:
    return memories.select("memory_type", F.col("id").alias("src"), F.explode("causal_out").alias("e")).select(
        "memory_type", "src", F.col("e.target").alias("dst"), F.lit("causal").alias("kind"), F.col("e.link_type").alias("link_type"), F.col("e.weight").alias("weight")
    )


def semantic_edges(links: DataFrame) -> DataFrame:
    return links.select("memory_type", "src", "dst", F.lit("semantic").alias("kind"), F.lit(None).cast("string").alias("link_type"), F.col("weight").cast("double").alias("weight"))


def reverse_edges(edges: DataFrame) -> DataFrame:
    """Incoming edges of each target, gathered in order."""
    return edges.groupBy("dst").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.col("src").cast("string"))), ",").alias("sources"))


def prune_dangling(edges: DataFrame, live: DataFrame) -> DataFrame:
    return edges.join(live.select(F.col("id").alias("dst")), "dst", "left_semi")


def direct_links(edges: DataFrame, ids: DataFrame, limit: int = S.EDGE_LIMIT) -> DataFrame:
    """Edges with both ends in the set."""
    one = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    return one.join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").orderBy("src", "dst").limit(limit)
