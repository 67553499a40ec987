"""Unbounded n-gram scores from sharded suffixes of the corpus.

A word is scored after its longest context (the words before it in its text, as
many as there are) that occurs elsewhere in the corpus; an occurrence of the
text's own is never counted for itself:

    p(word) = (others(context word) + MASS p0(word)) / (others(context) + MASS)
    p0(word) = (others(word) + MASS / N) / (others() + MASS)

with N the words of the corpus and others() N, less 1 in a text of the corpus.

1. Words are counted (one pass), and contexts of more than ``HOT`` occurrences
   (passes only as deep as there are any, ``DEPTH`` words at most).
2. Each place of each text goes to the shard of its shortest context that isn't
   hot, so a frequent word is split by the words before it.  A shard thereby
   holds all places with the same contexts from that length on; that the context
   is longer than a hot one and occurs nowhere else is the only other case, and
   then the hot one, with its count, is the longest.
3. A shard finds every place's longest context by a binary search over lengths:
   its suffixes (the contexts, read backwards) are put in the order of the hash
   of so many words, doubling from the shortest; who shares it with others goes
   on to longer ones, who doesn't goes on to shorter ones, where each group that
   did stands for itself as one suffix with its count.  Long copies thus cost
   steps by the logarithm of their length.
4. As the longest context grows by one word at most from one place to the next,
   others(context word) is the next place's count if its longest context has one
   word more, and else 0.  So a length and a count per place are all that comes
   back; the counts are summed and smoothed text by text.

A place travels in 1 to 4 bytes and returns in 2 to 8, packed.  The words stand
as prefix hashes in files of the shared folder (a POSIX path that all executors
see), 8 bytes a word, and word counts, sorted, in files there, so nothing that
grows goes to the driver or is broadcast, except hot contexts (words / ``HOT``).
A task that runs again writes the same files and blobs, so lost executors do no
harm (as long as the documents come in the same order again, as from files).

Defined cases: a row per scored row; null or wordless texts have n_words 0,
logprob 0 and a null perplexity; a null id is reported as null; a context that
ends a document counts; repeated rows count for each other and have a row each;
an unknown word has p0 = MASS / N / (N + MASS); an empty corpus gives p = 1;
texts of any length are scored whole; empty tables give no rows; other columns
are not read.  A context of more than ``DEPTH`` words that is itself hot (a
passage with millions of copies) stays in one shard.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import arrays as A
from .decontamination import _WORD
from .frames import dropped, parallelism, removed, shared_dir, texts, written

MASS = 2.0
SHARD = HOT = 1 << 19
DEPTH = 8
FILE = 1 << 21
SLICE = 1 << 22
NEAR = 4
CORPUS, SCORED = 1, 2
SCHEMA = "doc_id long, n_words int, logprob double, perplexity double, mean_context double"


def word_keys(text: str | None) -> np.ndarray:
    words = _WORD.findall((text or "").lower())
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in words]).astype(np.int64)
    return A.word_hashes(data, np.concatenate(([0], ends[:-1])).astype(np.int64), ends) if words else np.zeros(0, A.U)


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, begin): order sorts key, begin has where each distinct key starts in it."""
    n = len(key)
    bits = A.U(max(1, n.bit_length()))
    packed = key >> bits << bits | np.arange(n, dtype=A.U)
    packed.sort()
    order = (packed & ((A.U(1) << bits) - A.U(1))).astype(np.int64)
    k = key[order]
    new = k[1:] != k[:-1]
    if (new & (packed[1:] >> bits == packed[:-1] >> bits)).any():  # keys that differ in the bits cut off only
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = k[1:] != k[:-1]
    return order, np.flatnonzero(np.concatenate((np.ones(min(n, 1), bool), new)))


def codes(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of each key, and the weight of each group."""
    order, begin = grouped(key)
    code = np.empty(len(key), np.int32)
    code[order] = np.repeat(np.arange(len(begin), dtype=np.int32), np.diff(begin, append=len(key)))
    return code, np.add.reduceat(weight[order], begin) if len(begin) else np.zeros(0, np.int64)


def counted(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order, begin = grouped(h)
    return h[order[begin]], np.add.reduceat(n[order], begin) if len(begin) else np.zeros(0, np.int64)


def planes(x: np.ndarray) -> bytes:
    """Unsigned numbers byte by byte, lowest first: compresses well."""
    size = 1 if not len(x) else max(1, (int(x.max()).bit_length() + 7) // 8)
    return bytes([size]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, : data[0]] = raw.T
    return out.view("<u8").ravel().astype(np.int64)


def placed(path: str, array: np.ndarray) -> None:
    """Write an array's file whole or not at all; a task that runs again, or twice at once, replaces it by the same."""
    tmp = f"{path}-{uuid.uuid4().hex}"
    np.save(f"{tmp}.npy", array)
    os.replace(f"{tmp}.npy", f"{path}.npy")


def prefixes(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Prefix hashes: the entries between two places of a text, over a power of its place, are the hash of the words between."""
    length = np.diff(bounds)
    rel = np.arange(len(h)) - np.repeat(bounds[:-1], length)
    power = A.powers(int(length.max(initial=0)) + 2)[0]
    return np.concatenate((np.zeros(1, A.U), np.cumsum((h + A.U(1)) * power[rel], dtype=A.U)))


class Hot:
    """Frequent contexts by their number of words, with their counts."""

    def __init__(self, total: int):
        self.total = total
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: list[int], counts: list[int]) -> None:
        k, n = np.array(keys, np.int64).view(A.U), np.array(counts, np.int64)
        order = np.argsort(k)
        self.levels.append((k[order], n[order]))

    def count(self, m: int, key: np.ndarray) -> np.ndarray:
        """Occurrences of contexts of m words, 0 where they aren't hot."""
        if m > len(self.levels) or not len(self.levels[m - 1][0]):
            return np.zeros(len(key), np.int64)
        k, n = self.levels[m - 1]
        at = np.minimum(np.searchsorted(k, key), len(k) - 1)
        return np.where(k[at] == key, n[at], 0)


Context = Callable[[np.ndarray, "np.ndarray | int"], np.ndarray]


def shortest(context: Context, rel: np.ndarray, hot: Hot) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of the shortest context that isn't hot, its hash, count of the hot one a word shorter); a place with fewer words before it has only the hot one."""
    d, key, base = np.ones(len(rel), np.int64), np.zeros(len(rel), A.U), np.full(len(rel), hot.total)
    live, m = np.flatnonzero(rel >= 1), 1
    while len(live):
        key[live] = own = context(live, m)
        n = hot.count(m, own)
        more = n > 0
        live, m = live[more], m + 1
        base[live], d[live] = n[more], m
        live = live[rel[live] >= m]
    return d, key, base


def longest(context: Context, rel: np.ndarray, d: np.ndarray, key: np.ndarray, weight: np.ndarray, asks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words of the longest context that others have, how many others) of the places that ask, 0 where no other has even the key."""
    length, others = np.zeros(len(rel), np.int64), np.zeros(len(rel), np.int64)
    gid, size = codes(key, weight)
    size = size[gid]
    keep = np.bincount(gid, asks & (size > weight)) > 0
    idx = np.flatnonzero(keep[gid] & (asks & (size > weight) | (weight > 0))).astype(np.int32)  # a shard's places: 32 bits halve what a worker holds
    lo, hi = d[idx].astype(np.int32), np.zeros(len(idx), np.int32)  # hi 0: no length is known yet that nobody shares
    w, ask, gid, size = weight[idx], asks[idx], gid[idx], size[idx]
    while len(idx):
        done = (hi > 0) & (hi - lo == 1)
        end = idx[done & ask]
        length[end], others[end] = lo[done & ask], (size - w)[done & ask]
        go = ~done
        idx, lo, hi, w, ask, gid, size = (x[go] for x in (idx, lo, hi, w, ask, gid, size))
        if not len(idx):
            break
        mid = np.where(hi == 0, 2 * lo, (lo + hi) >> 1)
        fit = np.flatnonzero(rel[idx] >= mid)
        code, total = codes(A.mix(gid[fit].astype(A.U) * A.U(A.BASE) + A.U(1)) ^ context(idx[fit], mid[fit]), w[fit])
        sums = total[code]
        good = ask[fit] & (sums > w[fit])
        won = np.bincount(code, good, len(total)) > 0  # groups that go on to longer contexts
        first = np.full(len(total), -1)
        first[code[::-1]] = fit[::-1]
        alone = ask[fit] & ~good
        lone = np.zeros(len(idx), bool)
        lone[fit[alone]] = True
        out = np.ones(len(idx), bool)
        out[fit] = False
        fails = lone | (out & ask)
        wanted = np.zeros(int(gid.max()) + 1, bool)  # groups of the shorter context in which someone goes on to shorter ones
        wanted[gid[fails]] = True
        up = fit[won[code] & (good | (w[fit] > 0))]
        stay = np.flatnonzero((fails | (out & (w > 0))) & wanted[gid])
        heads = np.flatnonzero(np.bincount(code, ~alone, len(total)) > 0)  # groups that stand for themselves as one
        heads = heads[wanted[gid[first[heads]]] & (total[heads] > 0)]
        rep = first[heads]
        at = np.empty(len(idx), np.int32)
        at[fit] = code
        groups = np.int32(len(total))
        part = [
            (idx[up], mid[up], hi[up], w[up], ask[up], at[up], total[at[up]]),
            (idx[stay], lo[stay], mid[stay], w[stay], ask[stay], gid[stay] + groups, size[stay]),
            (idx[rep], lo[rep], mid[rep], total[heads], np.zeros(len(rep), bool), gid[rep] + groups, size[rep]),
        ]
        idx, lo, hi, w, ask, gid, size = (np.concatenate(x) for x in zip(*part))
        order = np.argsort(idx, kind="stable")
        idx, lo, hi, w, ask, gid, size = (x[order] for x in (idx, lo, hi, w, ask, gid, size))
        # ids stay small
        if len(gid):
            used = np.zeros(int(gid.max()) + 1, np.int32)
            used[gid] = 1
            gid = (np.cumsum(used, dtype=np.int32) - np.int32(1))[gid]
    return length, others


class Places:
    """Places of several files, in the order of their files, and the hashes of their contexts."""

    def __init__(self, folder: str, names: list[str], offs: list[np.ndarray]):
        self.maps = [np.load(f"{folder}/{n}.npy", mmap_mode="r") for n in names]
        self.file = np.repeat(np.arange(len(names), dtype=np.int32), [len(o) for o in offs])
        self.off = np.concatenate(offs).astype(np.int32)  # FILE or so at most, but for one long text
        rel, role = [], []
        for n, o in zip(names, offs):
            bounds, kind = np.load(f"{folder}/{n}-rows.npy")
            row = np.searchsorted(bounds, o, "left") - 1
            rel.append((o - bounds[row]).astype(np.int32))
            role.append(kind[row].astype(np.int8))
        self.rel, self.role = np.concatenate(rel), np.concatenate(role)
        self.inverse = A.powers(int(self.rel.max(initial=0)) + 2)[1]
        every = np.arange(len(self.off))
        self.near = [self._read(every, self.off - np.minimum(self.rel, m)) for m in range(NEAR + 1)]

    def _read(self, idx: np.ndarray, place: np.ndarray) -> np.ndarray:
        out = np.empty(len(idx), A.U)
        cut = np.searchsorted(self.file[idx], np.arange(len(self.maps) + 1, dtype=np.int32))
        for k in np.flatnonzero(np.diff(cut)):
            out[cut[k] : cut[k + 1]] = self.maps[k][place[cut[k] : cut[k + 1]]]
        return out

    def context(self, idx: np.ndarray, m: np.ndarray | int) -> np.ndarray:
        """Hashes of the m words before places (ascending) that have so many."""
        m = np.broadcast_to(np.asarray(m), len(idx))
        begin = np.empty(len(idx), A.U)
        far = np.flatnonzero(m > NEAR)
        for k in range(1, NEAR + 1):
            i = np.flatnonzero(m == k)
            begin[i] = self.near[k][idx[i]]
        if len(far):
            begin[far] = self._read(idx[far], self.off[idx[far]] - m[far])
        return (self.near[0][idx] - begin) * self.inverse[self.rel[idx] - m]


def whole(p: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, Context]:
    """(places, words before each, hashes of contexts) of all places of a file but the starts of texts."""
    off = np.arange(1, len(p))
    rel = off - np.repeat(bounds[:-1], np.diff(bounds))
    inverse = A.powers(int(rel.max(initial=0)) + 2)[1]
    return off, rel, lambda i, m: (p[off[i]] - p[off[i] - m]) * inverse[rel[i] - m]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch, buf, offs in A.slices(batches, "text", SLICE):
        starts, stops, bounds = A.words(buf, offs)
        yield batch, A.word_hashes(buf, starts, stops), bounds


class Tally:
    """Counts of hashes, kept small."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, h: np.ndarray) -> None:
        self.parts.append(counted(h, np.ones(len(h), np.int64)))
        self.size += len(self.parts[-1][0])
        if self.size > 1 << 20:
            self.fold()

    def fold(self) -> None:
        if self.parts:
            self.parts = [counted(*(np.concatenate(x) for x in zip(*self.parts)))]
            self.size = 0

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.fold()
        for h, n in self.parts:
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])


def vocabulary(rows: DataFrame, folder: str) -> tuple[DataFrame, dict[int, str], int]:
    """(h, n) of all words of the corpus; the same in files, sorted, by the upper eight bits of the hash; the number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch, h, bounds in _slices(batches):
            tally.add(h)
        yield from tally.batches()

    def write(key: tuple, table: pa.Table) -> pa.Table:
        h, n = table.column("h").to_numpy().view(A.U), table.column("n").to_numpy()
        order = np.argsort(h)
        path = f"{folder}/words-{uuid.uuid4().hex}.npy"
        np.save(path, np.stack((h[order], n[order].astype(A.U))))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "path": [path], "n": [int(n.sum())]})

    corpus = rows.where(F.col("role").bitwiseAND(CORPUS) > 0)
    words = written(corpus.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "lm-words")
    files = words.withColumn("bucket", F.shiftrightunsigned("h", 56).cast("int")).groupBy("bucket").applyInArrow(write, "bucket int, path string, n long").collect()  # 256 at most
    return words, {r.bucket: r.path for r in files}, sum(r.n for r in files)


def unigrams(h: np.ndarray, files: dict[int, str]) -> np.ndarray:
    """Counts of words in the corpus."""
    order, begin = grouped(h)
    own = h[order[begin]]
    n = np.zeros(len(own), np.int64)
    cut = np.searchsorted(own >> A.U(56), np.arange(257, dtype=A.U))
    for b in np.flatnonzero(np.diff(cut)):
        if b in files:
            known, count = np.load(files[int(b)], mmap_mode="r")
            part = own[cut[b] : cut[b + 1]]
            at = np.minimum(np.searchsorted(known, part), len(known) - 1)
            n[cut[b] : cut[b + 1]] = np.where(known[at] == part, count[at], 0)
    out = np.empty(len(h), np.int64)
    out[order] = np.repeat(n, np.diff(begin, append=len(h)))
    return out


def hot_contexts(rows: DataFrame, words: DataFrame, total: int, limit: int, depth: int) -> Hot:
    """Contexts of more than limit occurrences.  One of m + 1 words is made of two of m words that are hot too, so each pass counts only few."""
    hot = Hot(total)
    found = words.where(F.col("n") > limit).collect()  # total / limit at most
    keys = np.array([r.h for r in found], np.int64).view(A.U) + A.U(1)  # as prefix hashes have a word
    hot.add(keys.view(np.int64).tolist(), [r.n for r in found])
    while len(hot.levels[-1][0]) and len(hot.levels) < depth:
        m = len(hot.levels)

        def run(batches: Iterator[pa.RecordBatch], m: int = m) -> Iterator[pa.RecordBatch]:
            tally = Tally()
            for _, h, bounds in _slices(batches):
                p = prefixes(h, bounds)
                off, rel, context = whole(p, bounds)
                i = np.flatnonzero(rel > m)
                i = i[hot.count(m, context(i, m)) > 0]
                i = i[hot.count(m, context(i - 1, m)) > 0]
                tally.add(context(i, m + 1))
            yield from tally.batches()

        more = rows.where(F.col("role").bitwiseAND(CORPUS) > 0).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > limit).collect()  # total / limit at most
        hot.add([r.h for r in more], [r.n for r in more])
    return hot


BLOBS = "shard int, name string, data binary, counts binary"
_BLOB_TYPES = (pa.int32(), pa.string(), pa.binary(), pa.binary())
_BLOB_NAMES = ["shard", "name", "data", "counts"]


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return (A.mix(key.copy()) % A.U(shards)).astype(np.int64)


def by_shard(rel: np.ndarray, d: np.ndarray, key: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that go to a shard, those of one shard together and in order, and where each shard's begin."""
    go = np.flatnonzero(rel >= d)
    to = shard_of(key[go], shards)
    order = np.argsort(to.astype(np.uint16) if shards <= 1 << 16 else to, kind="stable")
    return go[order], np.searchsorted(to[order], np.arange(shards + 1))


def lm_scores(docs: DataFrame, scored: DataFrame | None = None, shard: int = SHARD, hot: int = HOT, depth: int = DEPTH, key: str = "doc_id") -> DataFrame:
    """One row per scored row (of docs themselves, or of another table with the id ``key``): doc_id, n_words, logprob, perplexity, mean_context (words of the longest contexts)."""
    spark = docs.sparkSession
    rows = texts(docs).withColumn("role", F.lit(CORPUS | SCORED if scored is None else CORPUS))
    if scored is not None:
        rows = rows.union(texts(scored.select(scored[key].alias("doc_id"), scored["text"])).withColumn("role", F.lit(SCORED)))
    folder = "/" + f"{shared_dir(spark).removeprefix('file:')}/lm-{uuid.uuid4().hex}".lstrip("/")
    os.makedirs(folder, exist_ok=True)
    words, files, total = vocabulary(rows, folder)
    frequent = spark.sparkContext.broadcast(hot_contexts(rows, words, total, hot, depth))  # total / hot at most
    shards = max(parallelism(spark), -(-total // shard))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size, part = 0, 0
        task = TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            h, length, role, ids, null = (np.concatenate(x) for x in zip(*held))
            bounds = np.concatenate(([0], np.cumsum(length)))
            name = f"{task}-{part}"  # the same if the task runs again
            p = prefixes(h, bounds)
            placed(f"{folder}/{name}-rows", np.stack((bounds, np.append(role, 0))))
            placed(f"{folder}/{name}", p)
            off, rel, context = whole(p, bounds)
            d, own, _ = shortest(context, rel, frequent.value)
            order, cut = by_shard(rel, d, own, shards)
            out: list[tuple] = [(-1, name, ids.astype("<i8").tobytes() + null.astype("<i8").tobytes(), None)]
            for k in np.flatnonzero(np.diff(cut)):
                out.append((int(k), name, planes(np.diff(off[order[cut[k] : cut[k + 1]]], prepend=0)), None))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _BLOB_TYPES)], _BLOB_NAMES)

        for batch, h, bounds in _slices(batches):
            ids = batch.column(0)
            held.append((h, np.diff(bounds), batch.column(2).to_numpy().astype(np.int64), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)))
            size += len(h)
            if size >= FILE:
                yield flush()
                held, size, part = [], 0, part + 1
        if held:
            yield flush()

    def search(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return table.select(_BLOB_NAMES)
        table = table.sort_by("name")
        names = table.column("name").to_pylist()
        offs = [np.cumsum(from_planes(x.as_py())) for x in table.column("data")]
        places = Places(folder, names, offs)
        d, own, _ = shortest(places.context, places.rel, frequent.value)
        length, others = longest(places.context, places.rel, d, own, (places.role & CORPUS > 0).astype(np.int64), places.role & SCORED > 0)
        cut = np.cumsum([0, *map(len, offs)])
        parts = [(planes(length[a:b]), planes(others[a:b])) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        return pa.table({"shard": table.column("shard"), "name": names, "data": pa.array([p[0] for p in parts], pa.binary()), "counts": pa.array([p[1] for p in parts], pa.binary())})

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        name = key[0].as_py()
        table = table.sort_by("shard")
        data, counts = table.column("data"), table.column("counts")
        head = np.frombuffer(data[0].as_py(), "<i8")
        ids, null = head[: len(head) // 2], head[len(head) // 2 :] > 0
        bounds, role = np.load(f"{folder}/{name}-rows.npy")
        p = np.load(f"{folder}/{name}.npy")
        off, rel, context = whole(p, bounds)
        d, own, base = shortest(context, rel, frequent.value)
        order, _ = by_shard(rel, d, own, shards)
        corpus = np.repeat((role[:-1] & CORPUS > 0).astype(np.int64), np.diff(bounds))
        length, others = d - 1, base - corpus  # where no other place has the shortest context that isn't hot
        if len(order):
            n = np.concatenate([from_planes(x.as_py()) for x in data[1:]])
            c = np.concatenate([from_planes(x.as_py()) for x in counts[1:]])
            hit = n > 0
            length[order[hit]], others[order[hit]] = n[hit], c[hit]
        del own, base, d
        # off[i] is the place after word i: word i stands after place i - 1, or at the start of its text
        h = (p[off] - p[off - 1]) * A.powers(int(rel.max(initial=0)) + 2)[1][rel - 1] - A.U(1)
        start = rel == 1
        before = np.where(start, 0, np.append([0], length[:-1])[: len(rel)])
        context_n = np.append([0], others[:-1])[: len(rel)]
        follows = np.where(length == before + 1, others, 0)
        rest = total - corpus
        p0 = (unigrams(h, files) - corpus + MASS / max(total, 1)) / (rest + MASS) if total else np.ones(len(h))
        score = np.where(before > 0, (follows + MASS * p0) / (context_n + MASS), p0)
        ll, ctx = A.sum_by_row(np.log(score), bounds), A.sum_by_row(before, bounds)
        size = np.diff(bounds)
        some = np.maximum(size, 1)
        out = pa.table({
            "doc_id": pa.array(ids, pa.int64(), mask=null), "n_words": pa.array(size.astype(np.int32)), "logprob": pa.array(ll),
            "perplexity": pa.array(np.exp(-ll / some), mask=size == 0), "mean_context": pa.array(ctx / some, mask=size == 0),
        })
        return out.filter(pa.array(role[:-1] & SCORED > 0))

    # heads go through one group per file, not one for all
    found = rows.mapInArrow(spread, BLOBS).groupBy("shard", F.when(F.col("shard") < 0, F.col("name")).alias("head")).applyInArrow(search, BLOBS)
    out = written(found.groupBy("name").applyInArrow(gather, SCHEMA), "lm-scores")
    dropped(words)
    removed(spark, folder)
    return out
