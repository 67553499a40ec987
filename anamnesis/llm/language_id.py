"""Language ID by cross-parsing entropy.

A suffix automaton of labelled text is built per language.  A document is
parsed greedily into the longest phrases that occur in that text; the language
whose parse needs the fewest phrases per character wins.  A greedy parse is a
walk through a total transition table (a missing transition ends the phrase
and restarts at the root), so numpy walks all documents of a slice at once;
when only a few long documents are left, a plain loop ends them.  The map over
documents is narrow: no shuffle.

Training text: labelled documents in the order of xxhash64(doc_id), up to
``TRAIN_CHARS`` characters a language, the documented bound of the fit.

Defined cases: text is lower-cased, runs of anything but letters count as one
space; a null text or one without letters has no phrases, score 0 and language
null; a tie goes to the alphabetically first language; a null label trains
nothing; a language with less labelled text than TRAIN_CHARS is parsed by what
it has and is chosen more rarely, since fewer of its phrases are known; without
any label every language is null; texts of any length are parsed whole; equal
rows get a row each; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import arrays as A
from .frames import texts

TRAIN_CHARS = 24_000
TRAIN_DOCS = 64
FEW = 48
OTHER = np.ones(256, bool)
OTHER[97:123] = OTHER[128:] = False


def normalise(text: str) -> str:
    """Letters (and all that isn't ASCII); runs of anything else become one space, none at the ends."""
    return re.sub("[^a-z\x80-\U0010ffff]+", " ", text).strip(" ")


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions by state (0 the root) of the minimal automaton of the factors of text."""
    nxt: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for ch in text:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and ch not in nxt[p]:
            nxt[p][ch] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][ch]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(ch) == q:
                    nxt[p][ch] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def phrases(automaton: list[dict[str, int]], text: str) -> int:
    """Number of phrases of the greedy parse; a character unknown to the text is a phrase of its own."""
    n = state = 0
    fresh = True
    for ch in text:
        to = automaton[state].get(ch)
        if to is None or fresh:
            n += 1
            to = automaton[0].get(ch)
        fresh = to is None
        state = 0 if fresh else to
    return n


class Parser:
    """Transition tables of all languages in one array: a cell holds twice the next state, plus 1 where a phrase begins."""

    def __init__(self, training: dict[str, str]):
        self.languages = sorted(training)
        symbols = sorted({c for t in training.values() for c in t})
        self.symbol = np.zeros(0x110000, np.uint8 if len(symbols) < 255 else np.uint16)
        for k, c in enumerate(symbols):
            self.symbol[ord(c)] = k + 1
        self.width = len(symbols) + 1
        rows, self.roots = [], []
        base = 0
        for lang in self.languages:
            auto = suffix_automaton(training[lang])
            t = np.full((len(auto), self.width), -1, np.int64)
            for s, arcs in enumerate(auto):
                for c, to in arcs.items():
                    t[s, self.symbol[ord(c)]] = to
            start = np.where(t[0] >= 0, (t[0] + base) * 2 + 1, (len(auto) + base) * 2 + 1)
            t = np.where(t >= 0, (t + base) * 2, start)
            rows += [t, start[None]]  # the added state restarts on any symbol; every parse begins there
            self.roots.append(base + len(auto))
            base += len(auto) + 1
        self.table = np.concatenate(rows).astype(np.int32).ravel() if rows else np.zeros(0, np.int32)

    def counts(self, symbols: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Phrases of each row (first axis) in each language (second)."""
        k, n = len(self.languages), len(offs) - 1
        out = np.zeros((n, k), np.int64)
        length = np.diff(offs)
        order = np.argsort(-length, kind="stable")
        start, length = offs[:-1][order], length[order]
        state = np.repeat(np.array(self.roots, np.int32)[None], n, 0)
        count = np.zeros((n, k), np.int32)
        width, table = np.int32(self.width), self.table
        alive = np.searchsorted(-length, -np.arange(int(length[0]) + 1 if n else 1), "left")  # rows longer than i
        i = 0
        while n and i < length[0] and alive[i] >= FEW:
            a = alive[i]
            s = state[:a] * width
            s += symbols[start[:a] + i].astype(np.int32)[:, None]
            to = table[s]
            count[:a] += to & 1
            np.right_shift(to, 1, out=state[:a])
            i += 1
        if n and i < length[0]:
            get = memoryview(table)
            w = self.width
            for r in range(alive[i]):
                row = memoryview(np.ascontiguousarray(symbols[start[r] + i : start[r] + length[r]]))
                for j in range(k):
                    s, c = int(state[r, j]), 0
                    for x in row:
                        to = get[s * w + x]
                        c += to & 1
                        s = to >> 1
                    count[r, j] += c
        out[order] = count
        return out


def training_text(docs: DataFrame, chars: int = TRAIN_CHARS) -> dict[str, str]:
    """The bounded labelled sample; the shortest hashes of each language, taken until it has enough characters."""
    ids = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    ranked = ids.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("r") <= TRAIN_DOCS)
    chosen = [r.doc_id for r in ranked.select("doc_id").collect()]
    if not chosen:
        return {}
    rows = docs.where(F.col("doc_id").isin(chosen)).where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", F.lower("text").alias("text"), F.xxhash64("doc_id").alias("h")).collect()
    out: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r.h, r.doc_id, r.text)):
        have = out.get(r.lang, "")
        if len(have) < chars:
            out[r.lang] = (have + " " + normalise(r.text)).strip()[:chars]
    return {k: v for k, v in out.items() if v}


SCHEMA = "doc_id long, language string, phrases long, score double"


def language_id(docs: DataFrame, training: dict[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, language, phrases of its parse, score (phrases per character)."""
    parser = Parser(training_text(docs) if training is None else training)
    shared = docs.sparkSession.sparkContext.broadcast(parser)  # bounded by TRAIN_CHARS, not by the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        names = np.array(p.languages, object)
        for batch, buf, offs in A.slices(batches, "text", 1 << 22):
            space = OTHER[buf]
            starts, ends, _ = A.runs(space, offs)
            edge = np.zeros(len(buf) + 1, bool)
            edge[offs] = True
            keep = ~space
            keep[starts[~(edge[starts] | edge[ends])]] = True
            b = np.where(space, np.uint8(32), buf)[keep]
            o = np.concatenate(([0], np.cumsum(keep)))[offs]
            cp, co = A.codepoints(b, o)
            n = p.counts(p.symbol[cp], co)
            size = np.diff(co)
            ok = size > 0
            if n.shape[1]:
                best = n.argmin(1)
                least = np.where(ok, n[np.arange(len(n)), best], 0)
                lang = pa.array(np.where(ok, names[best], None), pa.string())
            else:
                least, lang = np.zeros(len(size), np.int64), pa.nulls(len(size), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), lang, pa.array(least), pa.array(least / np.maximum(size, 1))], ["doc_id", "language", "phrases", "score"])

    return texts(docs).mapInArrow(run, SCHEMA)
