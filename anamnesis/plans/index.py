"""What a write derives, stored: edges in both directions, postings and their statistics.

Queries read the few edges of their seeds and the postings of their terms from
sorted Parquet files, whose row groups are skipped by their ranges; nothing is
derived again per query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import schema as S
from ..operators import arms, links
from ..session import scratch


class Index:
    """Tables under a path: memories, out and in (edges by source and by target), postings, totals."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @property
    def memories(self) -> DataFrame:
        return self.table("memories")

    @property
    def edges(self) -> DataFrame:
        return self.table("out")

    @classmethod
    def build(cls, memories: DataFrame, path: str, threshold: float = S.LINK_THRESHOLD, digits: int | None = None, stem: bool = False, text: bool = True) -> Index:
        """Write all tables of a set of memories (without text, those of the edges only); links to rows that are not there are left out."""
        self = cls(memories.sparkSession, path)
        memories.repartitionByRange("memory_type", "id").sortWithinPartitions("memory_type", "id").write.mode("overwrite").parquet(f"{path}/memories")
        own = self.memories
        edges = links.causal_edges(own).unionByName(links.semantic_edges(links.derive_links(own, threshold, digits=digits)))
        edges.repartitionByRange("memory_type", "src").sortWithinPartitions("memory_type", "src", "dst").write.mode("overwrite").parquet(f"{path}/out")
        self.edges.repartitionByRange("memory_type", "dst").sortWithinPartitions("memory_type", "dst", "src").write.mode("overwrite").parquet(f"{path}/in")
        if text:
            self._text(own, stem)
        return self

    def add(self, new: DataFrame, threshold: float = S.LINK_THRESHOLD, digits: int | None = None) -> None:
        """Append new rows and their links to them and to what is there: the older rows get no new ones."""
        old = self.memories
        every = old.unionByName(new)
        edges = links.causal_edges(new).unionByName(links.semantic_edges(links.derive_links(every, threshold, digits=digits, new=new)))
        held = scratch(self.spark, "edges")
        edges.write.parquet(held)
        edges = self.spark.read.parquet(held)
        new.sortWithinPartitions("memory_type", "id").write.mode("append").parquet(f"{self.path}/memories")
        edges.sortWithinPartitions("memory_type", "src", "dst").write.mode("append").parquet(f"{self.path}/out")
        edges.sortWithinPartitions("memory_type", "dst", "src").write.mode("append").parquet(f"{self.path}/in")
        arms.postings(new).sortWithinPartitions("term", "memory_type", "id").write.mode("append").parquet(f"{self.path}/postings")
        arms.text_totals(new).write.mode("append").parquet(f"{self.path}/totals")

    def _text(self, own: DataFrame, stem: bool) -> None:
        arms.postings(own, stem).repartitionByRange("term", "memory_type").sortWithinPartitions("term", "memory_type", "id").write.mode("overwrite").parquet(f"{self.path}/postings")
        arms.text_totals(own, stem).write.mode("overwrite").parquet(f"{self.path}/totals")

    def warm(self, *names: str) -> Index:
        """Keep tables in memory and on disk; an Index made anew reads what has been added since."""
        for name in names or ("memories", "out", "in", "postings", "totals"):
            self.table(name).persist().count()
        return self

    def edges_of(self, rows: DataFrame) -> DataFrame:
        """Edges out of and into a few rows (memory_type, id), such as seeds: their ids reach the scans."""
        ids = [r.id for r in rows.select("id").distinct().collect()]  # seeds or entry points: some tens a type
        return self.table("out").where(F.col("src").isin(ids)).union(self.table("in").where(F.col("dst").isin(ids) & ~F.col("src").isin(ids)))


    def text(self, terms: list[str], k: int, condition: Column | None = None, digits: int | None = None) -> DataFrame:
        """The first k rows of each type by BM25, of those that meet the condition."""
        allowed = None if condition is None else self.memories.where(condition)
        return arms.bm25_from(self.table("postings"), self.table("totals"), terms, k, allowed, digits=digits)


class Rows(Index):
    """Memories alone, stored: what a request reads of the other tables is derived for its rows and terms.

    For a request or a few over rows that are not indexed: its edges and scores cost one pass each, where building
    the tables derives the links of all rows and the postings of all terms.
    """

    def __init__(self, spark: SparkSession, path: str, threshold: float = S.LINK_THRESHOLD, digits: int | None = None):
        super().__init__(spark, path)
        self.threshold, self.digits = threshold, digits

    @property
    def edges(self) -> DataFrame:
        own = self.memories
        return links.causal_edges(own).unionByName(links.semantic_edges(links.derive_links(own, self.threshold, digits=self.digits)))

    def edges_of(self, rows: DataFrame) -> DataFrame:
        ids = [r.id for r in rows.select("id").distinct().collect()]  # seeds or entry points: some tens a type
        causal = links.causal_edges(self.memories).where(F.col("src").isin(ids) | F.col("dst").isin(ids))
        found = causal.unionByName(links.semantic_edges(links.links_of(self.memories, ids, self.threshold, digits=self.digits)))
        path = scratch(self.spark, "edges")
        found.coalesce(1).write.parquet(path)  # few, and read in both directions
        return self.spark.read.parquet(path)

    def text(self, terms: list[str], k: int, condition: Column | None = None, digits: int | None = None) -> DataFrame:
        return arms.bm25(self.memories, terms, k, condition, digits=digits)


def held(df: DataFrame) -> DataFrame:
    """A small ranked list (k rows a type), computed once."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


_built: dict[tuple[str, ...], str] = {}


def _once(spark: SparkSession, key: str, kind: str, write) -> str:  # type: ignore[no-untyped-def]
    """Path of what write puts there on first use in an application."""
    name = (spark.sparkContext.applicationId, key, kind)
    if name not in _built:
        path = scratch(spark, kind)
        write(path)
        _built[name] = path
    return _built[name]


def stored(spark: SparkSession, key: str, memories, threshold: float, digits: int | None = None, text: bool = True) -> Index:  # type: ignore[no-untyped-def]
    """The index of a data set, built on first use in an application; memories makes its rows."""
    return Index(spark, _once(spark, key, "index" if text else "edges", lambda path: Index.build(memories(), path, threshold, digits, text=text)))


def rows(spark: SparkSession, key: str, memories, threshold: float, digits: int | None = None) -> Rows:  # type: ignore[no-untyped-def]
    """The rows of a data set, written on first use in an application, to be asked without an index."""
    return Rows(spark, _once(spark, key, "rows", lambda path: memories().write.parquet(f"{path}/memories")), threshold, digits)
