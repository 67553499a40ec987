"""Compressed vectors and two-stage search: bounds of the scores decide which rows are read in full.

A code stands for a row's residual from its centroid: 8 bits a dimension, affine
(bounds are absolute), or one bit a dimension after a fixed rotation (bounds hold
up to ``EPSILON`` standard deviations).  Stage one scores codes, keeps those whose
upper bound reaches the k-th best lower bound; stage two rescores them exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.vector import cosine
from .arms import _rounded, top
from .blocks import unit

EPSILON = 5.0
CODE = "id {}, memory_type int, cluster_id int, code binary, low double, step double, rest double, norm double"


class Rotation:
    """Three rounds of permutation, signs and a fast Walsh-Hadamard transform over segments of powers of two: orthogonal, fixed by the seed."""

    def __init__(self, dim: int, seed: int = 7, rounds: int = 3):
        rng = np.random.default_rng(seed)
        self.steps = [(rng.permutation(dim), rng.choice([-1.0, 1.0], dim)) for _ in range(rounds)]
        self.segments, at = [], 0
        while at < dim:
            size = 1 << (dim - at).bit_length() - 1
            self.segments.append((at, at + size))
            at += size

    @staticmethod
    def hadamard(x: np.ndarray) -> np.ndarray:
        n, h = x.shape[1], 1
        while h < n:
            x = x.reshape(len(x), -1, 2, h)
            x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), 2).reshape(len(x), n)
            h *= 2
        return x / np.sqrt(n)

    def apply(self, x: np.ndarray) -> np.ndarray:
        for order, signs in self.steps:
            x = x[:, order] * signs
            x = np.concatenate([self.hadamard(x[:, a:b]) for a, b in self.segments], 1)
        return x


def encode(x: np.ndarray, centres: np.ndarray, kind: str, rotation: Rotation | None = None) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, low, step, rest, norm) of unit rows with their centroids: rest is the length of what the code leaves out."""
    r = x - centres
    if kind == "int8":
        low = r.min(1)
        step = np.maximum(r.max(1) - low, 1e-12) / 255
        q = np.rint((r - low[:, None]) / step[:, None]).clip(0, 255)
        back = low[:, None] + q * step[:, None]
        return [row.tobytes() for row in q.astype(np.uint8)], low, step, np.sqrt(((r - back) ** 2).sum(1)), np.sqrt((r**2).sum(1))
    assert rotation is not None
    y = rotation.apply(r)
    norm = np.sqrt((r**2).sum(1))
    bits = y > 0
    along = np.abs(y).sum(1) / np.sqrt(y.shape[1])  # of the residual along its signs
    return [row.tobytes() for row in np.packbits(bits, 1)], along, np.zeros(len(x)), np.sqrt(np.maximum(norm**2 - along**2, 0)), norm


def bounds(code: list[bytes], low: np.ndarray, step: np.ndarray, rest: np.ndarray, base: np.ndarray, query: np.ndarray, kind: str, rotation: Rotation | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of the rows' dot products with a unit query; base: that of their centroids."""
    n, dim = len(code), len(query)
    raw = np.frombuffer(b"".join(code), np.uint8).reshape(n, -1)
    if kind == "int8":
        guess = base + low * query.sum() + step * (raw.astype(np.float64) @ query)
        slack = rest  # Cauchy: what is left out meets a unit query in its length at most
        return guess - slack - 1e-9, guess + slack + 1e-9
    assert rotation is not None
    q = rotation.apply(query[None])[0]
    signs = np.unpackbits(raw, 1)[:, :dim].astype(np.float64) * 2 - 1
    guess = base + low / np.sqrt(dim) * (signs @ q)
    side = np.sqrt(max(0.0, float((q**2).sum()))) * rest
    slack = np.minimum(side, EPSILON * rest / np.sqrt(max(dim - 1, 1)))
    return guess - slack - 1e-9, guess + slack + 1e-9


def decode(code: list[bytes], low: np.ndarray, step: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Rows from 8-bit codes, as near as step / 2 a dimension."""
    raw = np.frombuffer(b"".join(code), np.uint8).reshape(len(code), -1)
    return centres + low[:, None] + raw * step[:, None]


def encoded(assigned: DataFrame, centroids: np.ndarray, kind: str = "int8", seed: int = 7) -> DataFrame:
    """Codes of all rows with a vector (ann.assign has given them their cluster)."""
    shared = assigned.sparkSession.sparkContext.broadcast(unit(centroids) if len(centroids) else centroids)  # root of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation = None
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(3)
            x = unit(v.flatten().to_numpy().reshape(b.num_rows, -1))
            if kind == "binary" and rotation is None:
                rotation = Rotation(x.shape[1], seed)
            code, *rest = encode(x, shared.value[b.column(2).to_numpy()], kind, rotation)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(code, pa.binary()), *map(pa.array, rest)], [f.split()[0] for f in CODE.split(", ")])

    rows = assigned.where("cluster_id IS NOT NULL").select("id", F.col("memory_type").cast("int"), "cluster_id", F.col("vector").cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, CODE.format(assigned.schema["id"].dataType.simpleString()))


def two_stage(assigned: DataFrame, codes: DataFrame, centroids: np.ndarray, vector: list[float], k: int, kind: str = "int8", predicate: Column | None = None, digits: int | None = None, seed: int = 7) -> DataFrame:
    """Top k by type of the rows with a vector: of codes the contenders, of contenders the exact cosine.

    Exact with 8-bit codes; with one bit a dimension up to the chance that a bound fails.  Contenders are not capped: all
    whose upper bound reaches the type's k-th best lower bound are rescored.
    """
    q = unit(np.array([vector], np.float64))[0]
    shared = assigned.sparkSession.sparkContext.broadcast(unit(centroids) if len(centroids) else centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation = Rotation(len(q), seed) if kind == "binary" else None
        for b in batches:
            if b.num_rows:
                base = (shared.value @ q)[b.column(2).to_numpy()]
                lo, hi = bounds(b.column(3).to_pylist(), *(b.column(i).to_numpy() for i in (4, 5, 6)), base, q, kind, rotation)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lo), pa.array(hi)], ["id", "memory_type", "lo", "hi"])

    scored = codes.mapInArrow(run, f"id {codes.schema['id'].dataType.simpleString()}, memory_type int, lo double, hi double")
    if predicate is not None:
        scored = scored.join(assigned.where(predicate).select("id"), "id", "left_semi")
    floor = top(scored.select("id", "memory_type", F.col("lo").alias("score")), k).groupBy("memory_type").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
    slack = 10.0**-digits if digits else 0.0
    near = scored.join(F.broadcast(floor), "memory_type").where(F.col("floor").isNull() | (F.col("hi") >= F.col("floor") - slack)).select("id")
    rows = assigned.join(near, "id", "left_semi")
    score = cosine(F.col("vector"), F.array(*(F.lit(float(x)) for x in vector)))
    return top(rows.select("id", "memory_type", _rounded(score, digits).alias("score")), k)


def merge_hits(*lists: DataFrame) -> DataFrame:
    """The best score of each row of several lists (memory_type, id, score)."""
    out = None
    for df in lists:
        part = df.select("memory_type", "id", "score")
        out = part if out is None else out.union(part)
    return out.groupBy("memory_type", "id").agg(F.max("score").alias("score"))


def sample_members(assigned: DataFrame, budget: int, clusters: int = 64) -> DataFrame:
    """Rows of at most so many clusters, at even stride, each giving its share of the budget, lowest ids first."""
    from pyspark.sql import Window

    own = [r.cluster_id for r in assigned.where("cluster_id IS NOT NULL").select("cluster_id").distinct().orderBy("cluster_id").collect()]  # root of the rows
    if not own:
        return assigned.limit(0)
    reads = min(clusters, len(own))
    chosen = [own[i * len(own) // reads] for i in range(reads)]
    w = Window.partitionBy("cluster_id").orderBy("id")
    return assigned.where(F.col("cluster_id").isin(chosen)).withColumn("r", F.row_number().over(w)).where(F.col("r") <= budget // reads).drop("r")


def principal_plane(rows: np.ndarray) -> np.ndarray:
    """The first two principal coordinates of a sample of vectors; the larger coefficients of each axis are positive."""
    x = rows - rows.mean(0)
    _, _, v = np.linalg.svd(x, full_matrices=False)
    v = v[:2] * np.sign(v[:2][np.arange(min(2, len(v))), np.abs(v[:2]).argmax(1)])[:, None]
    return x @ v.T
