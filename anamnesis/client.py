"""The whole surface in one class: namespaces of memories under a path, written through a log, read through a stored index.

A read sees everything that was written: rows of the index' fold and the tail.
``query`` uses the index of the last fold; ``refresh`` folds and extends it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from . import schema as S
from .functions.text import config_hash
from .operators import curation, links, scan, stats
from .operators.predicates import Predicate
from .plans import requests
from .plans.index import Index
from .sources.log import Log, namespaces


class Client:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def log(self, namespace: str) -> Log:
        return Log(self.spark, self.root, namespace)

    # --- namespaces ---

    def create_namespace(self, namespace: str, declared: tuple[str, ...] = (), stem: bool = False) -> bool:
        return self.log(namespace).create(declared, config_hash(stem))

    def delete_namespace(self, namespace: str) -> int:
        log = self.log(namespace)
        log.files.delete(f"{self.root}/_index/{namespace}")
        return log.delete()

    def list_namespaces(self) -> list[str]:
        return namespaces(self.spark, self.root)

    # --- writes ---

    def write(self, namespace: str, ops: DataFrame, now_ms: int | None = None, expect_below: int | None = None, wait_for_index: bool = False) -> int:
        """One atomic entry of operations; its seq."""
        seq = self.log(namespace).append(ops, now_ms, expect_below)
        if wait_for_index:
            self.refresh(namespace)
        return seq

    def delete_by_predicate(self, namespace: str, predicate: Predicate, delete_all: bool = False, eager: bool = False) -> int | None:
        """A lazy delete of one entry, or (eager) tombstones of what matches now; the seq, None if nothing matches."""
        if not eager:
            return self.write(namespace, curation.delete_where(self.spark, predicate, delete_all))
        gone = scan.delete_eager(self.view(namespace), predicate, delete_all)
        return None if gone.isEmpty() else self.write(namespace, gone)

    # --- reads ---

    def view(self, namespace: str, as_of: int | None = None) -> DataFrame:
        """Current rows with all fields of a record, those never written as null (times, texts) or empty (lists)."""
        rows = self.log(namespace).view(as_of)
        for f in T._parse_datatype_string(S.RECORD).fields:
            if f.name not in rows.columns:
                rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType) if not isinstance(f.dataType, T.ArrayType) else F.array().cast(f.dataType))
        return rows

    def get(self, namespace: str, ids: list, vector: bool = False, edges: bool = False) -> DataFrame:
        return scan.payload(scan.get(self.view(namespace), ids), vector, edges)

    def scan(self, namespace: str, limit: int = S.SCAN_DEFAULT, after: tuple | None = None, skip: int = 0, predicate: Column | None = None, by_creation: bool = False) -> DataFrame:
        rows = self.view(namespace)
        return scan.page_created(rows, limit, after, predicate) if by_creation else scan.page(rows, limit, after, skip, predicate)

    def refresh(self, namespace: str) -> Index:
        """Fold the tail, and store the index of that generation."""
        log = self.log(namespace)
        log.fold()
        return self.index(namespace)

    def index(self, namespace: str, threshold: float = S.LINK_THRESHOLD) -> Index:
        """The index of the last fold, built if it isn't stored yet."""
        log = self.log(namespace)
        path = f"{self.root}/_index/{namespace}/{log.manifest()['generation']}"
        if not log.files.exists(f"{path}/totals/_SUCCESS"):
            rows = self.view(namespace, log.manifest()["cursor"]).withColumn("batch", F.col("write_seq"))
            return Index.build(rows, path, threshold)
        return Index(self.spark, path)

    def query(self, namespace: str, request: requests.Request) -> DataFrame:
        return requests.run(self.index(namespace), request)

    # --- statistics and inspection ---

    def stats(self, namespace: str) -> dict:
        counts = {r.memory_type: r.doc_count for r in stats.type_stats(self.view(namespace)).collect()}  # types are few
        return self.log(namespace).stats() | {"types": counts, "doc_count": sum(counts.values())}

    def entity_stats(self, namespace: str, ids: list | None = None) -> DataFrame:
        return stats.entity_stats(self.view(namespace), ids)

    def metadata_stats(self, namespace: str, key: str) -> DataFrame:
        return stats.metadata_stats(self.view(namespace), key, self.log(namespace).manifest()["declared"])

    def link_stats(self, namespace: str) -> DataFrame:
        return stats.link_stats(links.prune_dangling(self.index(namespace).edges, self.view(namespace)))

    def list_wal(self, namespace: str, start: int = 1, limit: int = 50) -> DataFrame:
        return self.log(namespace).entries(start, limit)

    def list_objects(self, namespace: str) -> DataFrame:
        return self.log(namespace).objects()

    def decode_object(self, namespace: str, path: str, limit: int = 100) -> list[str]:
        return self.log(namespace).decode(path, limit)

    def cache_stats(self) -> list[dict]:
        """What Spark holds of persisted tables: name, partitions, bytes in memory and on disk."""
        held = self.spark.sparkContext._jsc.sc().getRDDStorageInfo()
        return [{"name": r.name(), "partitions": r.numCachedPartitions(), "memory": r.memSize(), "disk": r.diskSize()} for r in held]
