"""Benchmark decontamination: pigeonhole edit matching.

A document leaks a benchmark item if some stretch of its text is within
floor(``rate`` x length) edits of the whole item.  The item is split into that
many pieces plus one, so one piece at least is there unchanged: an Aho-Corasick
automaton finds all pieces in the whole text, and Myers' bit-parallel algorithm
verifies the stretch around each hit.  Exact: no hit is dropped.

Texts are compared as words of the lower-cased text joined by one space, in
UTF-8 bytes, so case, punctuation and white space never count as edits.

The map over documents is narrow.  Only the items travel; they are taken in
groups of ``GROUP_BYTES`` at most, so a large benchmark never has to fit in
memory at once: ``decontaminate`` makes one pass over the documents for each
group, ``without_leaks`` one map after another within the same pass.

Defined cases: items of fewer than ``min_length`` bytes allow no edit and match
whole words only; null, empty and one-word items match nothing (a word is no
passage); null or empty documents leak nothing; a row per pair of doc_id and
item_id with the least distance, however often either is repeated; a null
doc_id or item_id is reported as null; ``without_leaks`` judges each row by its
own text, whatever its doc_id; empty tables give no rows; other columns are
carried by ``without_leaks``, never read, and their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import arrays as A
from .frames import texts

RATE = 0.08
MIN_LENGTH = 24
GROUP_BYTES = 16 << 20
SLICE = 1 << 21

_WORD = re.compile("[a-z0-9\x80-\U0010ffff]+")


def normalise(text: str | None) -> bytes:
    return " ".join(_WORD.findall((text or "").lower())).encode()


def normalised(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for all rows of a slice; a line feed stands between rows and before the first."""
    keep = A.WORD_BYTE[buf]
    out = np.where(keep, buf, np.uint8(32))
    starts, _, bounds = A.runs(keep, offs)
    later = np.ones(len(starts), bool)
    later[bounds[:-1][np.diff(bounds) > 0]] = False  # a row's first word has no separator
    keep[starts[later] - 1] = True
    at = np.concatenate(([0], np.cumsum(keep)))[offs]
    n = len(offs) - 1
    size = np.diff(at)
    res = np.full(int(at[-1]) + n + 1, 10, np.uint8)
    to = at[:-1] + np.arange(n) + 1
    res[np.repeat(to - at[:-1], size) + np.arange(int(at[-1]))] = out[keep]
    return res, np.concatenate((to, [len(res) + (n == 0)]))


def budget(length: int, rate: float) -> int:
    return int(length * rate + 1e-9)


def pieces(item: bytes, rate: float) -> list[tuple[int, int]]:
    n = budget(len(item), rate) + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return list(zip(cuts, cuts[1:]))


def ancestors(item: bytes, rate: float) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """Each piece with the joins of neighbouring pieces above it in a binary tree, as (from, to, edits).

    If the whole is within its budget, so is one half with its number of pieces less one, and so on down to an exact
    piece: a hit counts only if every join above it is within its edits.
    """
    out: list[tuple[int, int, list[tuple[int, int, int]]]] = []

    def split(part: list[tuple[int, int]], above: list[tuple[int, int, int]]) -> None:
        if len(part) == 1:
            out.append((*part[0], above[::-1]))
            return
        half = len(part) // 2
        for side in (part[:half], part[half:]):
            split(side, above if len(side) == 1 else [*above, (side[0][0], side[-1][1], len(side) - 1)])

    split(pieces(item, rate), [])
    return out


def myers(item: bytes, text: bytes) -> int:
    """Least edit distance of item to a stretch of text."""
    masks: dict[int, int] = {}
    for k, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << k
    full, top = (1 << len(item)) - 1, 1 << len(item) - 1
    vp, vn, score, best = full, 0, len(item), len(item)
    get = masks.get
    for c in text:
        eq = get(c, 0)
        xh = (((eq & vp) + vp) ^ vp) | eq
        xv = eq | vn
        hp = vn | ~(xh | vp) & full
        hn = vp & xh
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
            if score < best:
                best = score
        hp = hp << 1 & full
        hn = hn << 1 & full
        vp = hn | ~(xv | hp) & full
        vn = hp & xv
    return best


class Matcher:
    """Finds all leaks in a normalised slice."""

    def __init__(self, items: list[bytes], rate: float, min_length: int = MIN_LENGTH):
        self.items = items
        self.short = [len(i) < min_length for i in items]  # as whole words, without edits
        self.budgets = [0 if s else budget(len(i), rate) for i, s in zip(items, self.short)]
        where: dict[bytes, list[tuple[int, int, list]]] = {}
        for k, item in enumerate(items):
            for a, b, above in [(0, len(item), [])] if self.short[k] else ancestors(item, rate):
                where.setdefault(item[a:b], []).append((k, b, above))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece.decode("latin-1"), places)
        if where:
            self.automaton.make_automaton()

    def holds(self, text: bytes, k: int, begin: int, above: list[tuple[int, int, int]]) -> bool:
        if self.short[k]:
            end = begin + len(self.items[k])
            return text[max(begin - 1, 0) : begin] in (b" ", b"\n", b"") and text[end : end + 1] in (b" ", b"\n", b"")
        for a, b, edits in above:
            part, own = text[max(begin + a - edits, 0) : max(begin + b + edits, 0)], self.items[k][a:b]
            if own not in part and myers(own, part) > edits:
                return False
        return True

    def leaks(self, data: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, item, distance); starts has one more element than there are rows."""
        if not self.items or len(starts) < 2:
            return []
        text = data.tobytes()
        hits = [(k, end + 1 - b) for end, places in self.automaton.iter(text.decode("latin-1")) for k, b, above in places if self.holds(text, k, end + 1 - b, above)]
        if not hits:
            return []
        h = np.array(hits, np.int64)
        which, begin = h[:, 0], h[:, 1]
        length = np.array([len(i) for i in self.items])[which]
        slack = np.array(self.budgets)[which]
        found: dict[tuple[int, int], int] = {}
        order = np.lexsort((begin, which))
        open_: dict[int, list[int]] = {}
        spans: list[tuple[int, int, int]] = []  # stretches around the hits of an item, those that overlap as one
        for k, a, b in zip(which[order].tolist(), (begin - slack)[order].tolist(), (begin + length + slack)[order].tolist()):
            last = open_.get(k)
            if last is not None and a <= last[1]:
                last[1] = max(last[1], b)
            else:
                if last is not None:
                    spans.append((k, *last))
                open_[k] = [a, b]
        spans += [(k, *v) for k, v in open_.items()]
        for k, a, b in spans:
            a, b = max(a, 0), min(b, len(text))
            first = max(int(np.searchsorted(starts, a, "right")) - 1, 0)
            r = first
            while r < len(starts) - 1 and starts[r] < b:
                part = text[max(a, int(starts[r])) : min(b, int(starts[r + 1]) - 1)]
                item, most = self.items[k], self.budgets[k]
                if len(part) >= len(item) - most and found.get((r, k), most + 1) > 0:
                    d = 0 if item in part else myers(item, part)
                    if d <= most:
                        found[r, k] = min(d, found.get((r, k), d))
                r += 1
        return [(r, k, d) for (r, k), d in found.items()]


SCHEMA = "doc_id long, item_id long, distance int"


def item_groups(benchmark: DataFrame):  # type: ignore[no-untyped-def]
    """The benchmark's normalised items with their ids, in groups of GROUP_BYTES or so."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = 1 + total // GROUP_BYTES
    for g in range(groups):
        ids_of: dict[bytes, list] = {}
        for r in items.where(F.pmod(F.xxhash64("text"), F.lit(groups)) == g).collect():
            item = normalise(r.text)
            if b" " in item:
                ids_of.setdefault(item, []).append(r.item_id)
        yield ids_of


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, item_id, distance of every leak."""
    context = docs.sparkSession.sparkContext
    own = texts(docs)
    out = None
    for ids_of in item_groups(benchmark):
        shared = context.broadcast(ids_of)  # GROUP_BYTES or so

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own_items = list(shared.value)
            matcher = Matcher(own_items, rate, min_length)
            for batch, buf, offs in A.slices(batches, "text", SLICE):
                ids = batch.column(0)
                found = [(ids[r].as_py(), i, d) for r, k, d in matcher.leaks(*normalised(buf, offs)) for i in shared.value[own_items[k]]]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.int32()))], ["doc_id", "item_id", "distance"])

        part = own.mapInArrow(run, SCHEMA)
        out = part if out is None else out.union(part)
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, min_length: int = MIN_LENGTH) -> DataFrame:
    """The documents that leak no item: decided row by row within the map, so nothing is shuffled."""
    context = docs.sparkSession.sparkContext
    rows = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # names that can't clash
    text = rows[f"c{docs.columns.index('text')}"]
    rows = rows.select("*", F.lower(F.coalesce(text, F.lit(""))).alias("text"))
    for ids_of in item_groups(benchmark):
        if not ids_of:
            continue
        shared = context.broadcast(list(ids_of))  # GROUP_BYTES or so

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate, min_length)
            for batch in batches:
                leaks: list[int] = []
                first = 0
                for part, buf, offs in A.slices(iter([batch]), "text", SLICE):
                    leaks += [first + r for r, _, _ in matcher.leaks(*normalised(buf, offs))]
                    first += part.num_rows
                clean = np.ones(batch.num_rows, bool)
                clean[leaks] = False
                yield batch if clean.all() else batch.filter(pa.array(clean))  # whole batches: a slice would carry all of its batch

        rows = rows.mapInArrow(run, rows.schema)
    return rows.drop("text").toDF(*docs.columns)
