"""Products of two sets of vectors in blocks: no pair becomes a row unless it is wanted.

Left rows of a group (such as a memory type) get a block by the hash of their
id; a task holds a block and reads all right rows of the group past it, a batch
at a time.  A group has ``BLOCKS`` blocks at most, more only where a block would
have over ``LARGEST`` values: so what is shuffled grows with the right rows, not
with the pairs, and memory doesn't grow with them either.

Single precision tells which pairs can reach a row's floor, which is the
threshold or the worst of the best right rows so far; only those are computed in
double precision, so the result is that of doing so for all.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLOCKS, SMALLEST, LARGEST = 24, 64, 1 << 23  # rows, values
TILE, WIDTH, FIRST = 1024, 4096, 256  # rows of the left and of the right that are multiplied at a time, at first fewer
PAIRS = 1 << 15  # in double precision at a time
#: of pairs, as arrays of equal length: ids (whole numbers or text) and batch of the left row, of the right row
Ok = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x**2).sum(1, keepdims=True))
    return x / np.where(n > 0, n, 1)


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    v = batch.column(batch.schema.get_field_index("vector"))
    size = v.value_lengths().to_numpy()
    if len(set(size.tolist())) > 1:
        raise ValueError("vector dimensions differ")
    return unit(v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(size), -1))


def _named(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column(batch.schema.get_field_index("id"))
    return ids.to_numpy() if pa.types.is_integer(ids.type) else np.array(ids.to_pylist()), batch.column(batch.schema.get_field_index("batch")).to_numpy(zero_copy_only=False)


class _Block:
    """A block of left rows and what it has found so far; reach: centroids and the radius of each of the group's parts."""

    def __init__(self, rows: pa.RecordBatch, digits: int | None, least: float | None, most: int | None, ok: Ok | None, reach: tuple[np.ndarray, dict[int, float]] | None):
        self.x, (self.ids, self.batches) = _vectors(rows), _named(rows)
        self.single = self.x.astype(np.float32)
        self.digits, self.most, self.ok, self.reach = digits, most, ok, reach
        self.floor = np.full(len(self.x), -np.inf if least is None else least)
        # twice the rounding error of a sum of so many products in single precision, and what rounding to digits lifts
        self.slack = 2.4e-7 * (self.x.shape[1] + 8) + (0 if digits is None else 10.0**-digits)
        self.seen = 0
        none = (np.zeros(0, np.int64), self.ids[:0], np.zeros(0))
        self.kept = {k: none for k in range(0, len(self.x), TILE)}

    def read(self, rows: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs (row of the block, right id, score) that are in the result whatever comes; with most, those are kept instead."""
        y, (ids, batches) = _vectors(rows), _named(rows)
        if y.shape[1] != self.x.shape[1]:
            raise ValueError("vector dimensions differ")
        single = y.astype(np.float32)
        part = None if self.reach is None else rows.column(rows.schema.get_field_index("part")).to_numpy()
        a = 0
        while a < len(y):
            b = min(len(y), a + min(WIDTH, max(FIRST, self.seen)))
            if part is not None:
                b = min(b, a + int(np.searchsorted(part[a:b], part[a], "right")))
            for k in self.kept:
                i, j, s = self._tile(k, y[a:b], single[a:b], ids[a:b], batches[a:b], None if part is None else int(part[a]))
                if not len(i):
                    continue
                if self.most is None:
                    yield i, ids[a + j], s
                else:
                    self._keep(k, i, ids[a + j], s)
            self.seen += b - a
            a = b

    def _tile(self, k: int, y: np.ndarray, single: np.ndarray, ids: np.ndarray, batches: np.ndarray, part: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = np.arange(k, min(k + TILE, len(self.x)))
        if part is not None:
            centres, radius = self.reach  # type: ignore[misc]
            rows = rows[self.x[rows] @ centres[part] + radius[part] >= self.floor[rows] - self.slack]
        near = (self.single[rows] if part is not None else self.single[k : k + TILE]) @ single.T
        low = self.floor[rows] - self.slack
        hit = np.flatnonzero(near >= low.astype(np.float32)[:, None])
        i, j = rows[hit // len(y)], hit % len(y)
        if self.ok is not None and len(hit):
            good = self.ok(self.ids[i], self.batches[i], ids[j], batches[j])
            hit, i, j = hit[good], i[good], j[good]
        if self.most is not None and len(hit) > 8 * self.most * len(rows) and len(y) > self.most:
            some = np.full(near.size, -np.inf, np.float32)  # the worst of this tile's best is a floor too
            some[hit] = near.ravel()[hit]
            worst = -np.partition(-some.reshape(near.shape), self.most - 1, 1)[:, self.most - 1]
            good = near.ravel()[hit] >= (worst - 2 * self.slack)[hit // len(y)]
            i, j = i[good], j[good]
        s = np.empty(len(i))
        for a in range(0, len(i), PAIRS):
            s[a : a + PAIRS] = np.einsum("ij,ij->i", self.x[i[a : a + PAIRS]], y[j[a : a + PAIRS]])
        s = np.clip(s, -1, 1)
        s = s if self.digits is None else np.round(s, self.digits)
        good = s >= self.floor[i]
        return i[good], j[good], s[good]

    def _keep(self, k: int, i: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        own_i, own_ids, own_s = self.kept[k]
        again = np.zeros(TILE, bool)
        again[i - k] = True
        old = again[own_i - k]
        i, ids, s = np.concatenate([own_i[old], i]), np.concatenate([own_ids[old], ids]), np.concatenate([own_s[old], s])
        order = np.lexsort((ids if ids.dtype.kind == "i" else np.unique(ids, return_inverse=True)[1], -s, i))
        i, ids, s = i[order], ids[order], s[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        last = place == self.most - 1  # type: ignore[operator]
        self.floor[i[last]] = s[last]
        best = place < self.most  # type: ignore[operator]
        self.kept[k] = np.concatenate([own_i[~old], i[best]]), np.concatenate([own_ids[~old], ids[best]]), np.concatenate([own_s[~old], s[best]])


def _sizes(rows: DataFrame, block: int | None) -> dict[int, int]:
    """Blocks of each group; groups are few (types)."""
    found = rows.groupBy("grp").agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dims")).collect()
    if block:
        return {r.grp: math.ceil(r.n / block) for r in found}
    return {r.grp: max(1, min(BLOCKS, r.n // SMALLEST), math.ceil(r.n * r.dims / LARGEST)) for r in found}


def product(left: DataFrame, right: DataFrame, digits: int | None = None, least: float | None = None, most: int | None = None, ok: Ok | None = None, block: int | None = None, reach: tuple[np.ndarray, dict[tuple[int, int], float]] | None = None) -> DataFrame:
    """(grp, a, b, s) of the pairs of a group that are ok and have a cosine s of least or more; with most, the first so many of each left row by s, then b.

    left, right: grp int, id (whole numbers or text), batch long, vector.  Vectors of one group have one dimension, else the task raises.
    reach: right also has part int, the nearest of the centroids; a part's rows are left out for the left rows whose cosine with
    its centroid plus its radius (by group and part) is below their floor.
    """
    types = [df.schema["id"].dataType.simpleString() for df in (left, right)]
    plain = "bigint" if all(t in ("tinyint", "smallint", "int", "bigint") for t in types) else "string"
    exact = "array<float>" if all(df.schema["vector"].dataType.simpleString() == "array<float>" for df in (left, right)) else "array<double>"
    n = _sizes(left, block)
    first = dict(zip(n, accumulate(n.values(), initial=0)))
    own = F.create_map(*(x for g in n for x in (F.lit(g), F.struct(F.lit(first[g]).alias("first"), F.lit(n[g]).alias("n")))))[F.col("grp")] if n else F.struct(F.lit(0).alias("first"), F.lit(1).alias("n"))

    def side(df: DataFrame, cell, number: int) -> DataFrame:  # type: ignore[no-untyped-def]
        part = F.col("part") if number and reach is not None else F.lit(0)
        some = df.withColumn("own", own).where("own IS NOT NULL")
        return some.select(cell.alias("cell"), F.lit(number).alias("side"), part.alias("part"), "grp", F.col("id").cast(plain).alias("id"), "batch", F.col("vector").cast(exact).alias("vector"))

    mine = F.col("own.first") + F.pmod(F.xxhash64(F.col("id").cast(plain)), F.col("own.n")).cast("int")
    every = F.explode(F.sequence(F.col("own.first"), F.col("own.first") + F.col("own.n") - 1))
    both = side(left, mine, 0).union(side(right, every, 1))
    kind = pa.int64() if plain == "bigint" else pa.string()
    shared = None if reach is None else left.sparkSession.sparkContext.broadcast(reach)  # centroids and a number for each part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
            i, b, s = found
            names = [pa.array(x if kind == pa.int64() else x.tolist(), kind) for x in (state.ids[i], b)]  # type: ignore[union-attr]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(i), grp, np.int32)), *names, pa.array(s)], ["grp", "a", "b", "s"])

        def done() -> Iterator[pa.RecordBatch]:
            if state is not None and most is not None:
                for k in state.kept:
                    if len(state.kept[k][0]):
                        yield out(state.kept[k])

        held: list[pa.RecordBatch] = []
        state, name, grp = None, -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, sides = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (sides[1:] != sides[:-1])) + 1).tolist(), len(cells)]
            for a, b in zip(cut, cut[1:]):
                if cells[a] != name:
                    yield from done()
                    held, state, name, grp = [], None, cells[a], batch.column(3)[a].as_py()
                if sides[a] == 0:
                    held.append(batch.slice(a, b - a))
                    continue
                if state is None and held:
                    parts = None if shared is None else (shared.value[0], {p: r for (g, p), r in shared.value[1].items() if g == grp})
                    state, held = _Block(pa.Table.from_batches(held).combine_chunks().to_batches()[0], digits, least, most, ok, parts), []
                if state is not None:
                    yield from map(out, state.read(batch.slice(a, b - a)))
        yield from done()

    placed = both.repartitionById(max(1, sum(n.values())), "cell").sortWithinPartitions("cell", "side", "part")
    return placed.mapInArrow(run, f"grp int, a {plain}, b {plain}, s double").select("grp", F.col("a").cast(types[0]).alias("a"), F.col("b").cast(types[1]).alias("b"), "s")
