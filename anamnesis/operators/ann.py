"""Clustered vector search: a speed structure with a recall contract.

Centroids come from a bounded training sample; rows are assigned in one narrow
map; a query reads only the clusters that can hold one of its first k rows, by
a bound on the scores, or a given number of nearest ones.  The bound makes no
miss; vectors without clusters make it read them all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .arms import asked_of, dense, top
from .blocks import product, unit

TRAIN_ROWS = 50_000


def centroid_count(n: int) -> int:
    return max(1, round(math.sqrt(n)))


def train(memories: DataFrame, k: int | None = None, seed: int = 7, iterations: int = 25, rows: int = TRAIN_ROWS) -> np.ndarray:
    """Lloyd's algorithm from spread-out seeds on the driver, over rows with the least hash (a documented bound)."""
    have = memories.where(F.size("vector") > 0)
    n = have.count()
    if not n:
        return np.zeros((0, 0))
    sample = np.array([r.vector for r in have.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(rows).collect()], np.float64)
    k = min(k or centroid_count(n), len(sample))
    rng = np.random.default_rng(seed)
    centres = [sample[rng.integers(len(sample))]]
    near = ((sample - centres[0]) ** 2).sum(1)
    for _ in range(k - 1):
        p = near / near.sum() if near.sum() > 0 else None
        centres.append(sample[rng.choice(len(sample), p=p)])
        near = np.minimum(near, ((sample - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(iterations):
        own = nearest(sample, c)
        count = np.bincount(own, minlength=k)
        new = np.zeros_like(c)
        np.add.at(new, own, sample)
        new = new / np.maximum(count, 1)[:, None]
        empty = np.flatnonzero(count == 0)
        if len(empty):  # an empty cluster starts again at the rows that lie farthest from theirs
            far = ((sample - c[own]) ** 2).sum(1)
            new[empty] = sample[np.argsort(-far, kind="stable")[: len(empty)]]
        if np.allclose(new, c):
            break
        c = new
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Index of the nearest centroid, the lower one on ties."""
    return ((c**2).sum(1)[None] - 2 * x @ c.T).argmin(1)


def local_split(assigned: DataFrame, centroids: np.ndarray, most: int, seed: int = 7) -> np.ndarray:
    """Centroids with each of a cluster of more than ``most`` rows replaced by two of a sample of its rows; assign again with them."""
    sizes = {r.cluster_id: r["count"] for r in assigned.where("cluster_id IS NOT NULL").groupBy("cluster_id").count().collect()}  # root of the rows
    out = []
    for k, c in enumerate(centroids):
        if sizes.get(k, 0) > most:
            out.extend(train(assigned.where(F.col("cluster_id") == k), 2, seed))
        else:
            out.append(c)
    return np.array(out)


def assign(memories: DataFrame, centroids: np.ndarray) -> DataFrame:
    """memories with cluster_id (null without vector)."""
    shared = memories.sparkSession.sparkContext.broadcast(centroids)  # root of TRAIN_ROWS rows at most
    schema = T.StructType([*memories.schema.fields, T.StructField("cluster_id", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(b.schema.get_field_index("vector")).to_pylist()
            have = [i for i, v in enumerate(vectors) if v]
            out: list[int | None] = [None] * len(vectors)
            if have and len(shared.value):
                for i, c in zip(have, nearest(np.array([vectors[i] for i in have]), shared.value)):
                    out[i] = int(c)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], names=[*b.schema.names, "cluster_id"])

    return memories.mapInArrow(run, schema)


def cells(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(memory_type, cluster_id, radius): the greatest distance of a row, scaled to length 1, from its centroid."""
    shared = assigned.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(1).to_numpy()
            x = np.array(b.column(2).to_pylist(), np.float64).reshape(len(own), -1)
            if len(own):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.sqrt(((unit(x) - shared.value[own]) ** 2).sum(1)))], ["memory_type", "cluster_id", "radius"])

    rows = assigned.where("cluster_id IS NOT NULL").select(F.col("memory_type").cast("int"), "cluster_id", "vector")
    return rows.mapInArrow(run, "memory_type int, cluster_id int, radius double").groupBy("memory_type", "cluster_id").agg(F.max("radius").alias("radius"))


def search_many(assigned: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """Top k of every query (query_id, query) by type, exact; rows without vector are none of them.

    A row u of a cluster with centroid c and a query q, both of length 1, have q u = q c + q (u - c) <= q c + radius:
    cells (a type's rows in a cluster) whose bound is below the k-th score so far can't hold a better row and are left
    out for the query.  What is left is multiplied in blocks.
    """
    radius = {(r.memory_type, r.cluster_id): r.radius for r in cells(assigned, centroids).collect()}  # types times the root of the rows
    rows = assigned.where("cluster_id IS NOT NULL").select(F.col("memory_type").cast("int").alias("grp"), "id", F.lit(0).cast("long").alias("batch"), F.col("cluster_id").alias("part"), "vector")
    found = product(asked_of(queries, sorted({t for t, _ in radius})), rows, digits, most=k, reach=(centroids, radius))
    return top(found.select(F.col("a").cast("long").alias("query_id"), F.col("b").alias("id"), F.col("grp").alias("memory_type"), F.col("s").alias("score")), k, ("query_id", "memory_type"))


def search(assigned: DataFrame, centroids: np.ndarray, vector: list[float], k: int, nprobe: int = 0, digits: int | None = None) -> DataFrame:
    """Top k by type: of nprobe nearest clusters, or (0) of all that the bound leaves; a table partitioned by cluster_id reads only those."""
    if not nprobe:
        one = assigned.sparkSession.createDataFrame([(0, [float(x) for x in vector])], "query_id long, query array<double>")
        return search_many(assigned, centroids, one, k, digits).drop("query_id")
    order = np.argsort(((centroids - np.array(vector)) ** 2).sum(1), kind="stable")[:nprobe]
    return dense(assigned, vector, k, F.col("cluster_id").isin(*map(int, order)), digits)
