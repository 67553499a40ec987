"""Token counts of a unigram tokenizer by trie-shared dynamic programming.

The distinct pre-tokens of a slice form a trie, walked level by level in numpy.
The best score of a prefix is computed once, however many pre-tokens share it;
where a pre-token ends, the number of pieces of its best segmentation is stored
(and kept for the worker's next slices).  A document's count is the sum over its
pre-tokens.  The map over documents is narrow: no shuffle.

Scores: the vocabulary file lists pieces by rank; a piece's log probability is
taken as -ln(rank + 2) (Zipf's law), or as given by ``scores``.  Equal scores go
to fewer pieces.  Every byte must be a piece, so every text has a segmentation;
a vocabulary without some single byte is refused.

Defined cases: a null or empty text counts 0; pre-tokens of any length are
segmented whole (beyond ``LONG`` bytes on their own); repeated rows give a row
each; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrays as A
from .bpe import VOCABULARY, checked, pretokens, read_ranks
from .frames import texts

SLICE = 1 << 21
LONG = 256
KEPT = 1 << 20


def zipf(ranks: dict[bytes, int]) -> dict[bytes, float]:
    return {p: -math.log(r + 2) for p, r in ranks.items()}


def segment(word: bytes, scores: dict[bytes, float], lengths: list[int]) -> int:
    """Pieces of the best segmentation: plain dynamic programming, for very long pre-tokens."""
    best, count = [0.0] * (len(word) + 1), [0] * (len(word) + 1)
    for e in range(1, len(word) + 1):
        top, least = -math.inf, 0
        for n in lengths:
            if n > e:
                break
            s = scores.get(word[e - n : e])
            if s is not None:
                v, c = best[e - n] + s, count[e - n] + 1
                if v > top or (v == top and c < least):
                    top, least = v, c
        best[e], count[e] = top, least
    return count[-1]


class Unigram:
    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        self.lengths = sorted({len(p) for p in scores})
        data = np.frombuffer(b"".join(scores), np.uint8)
        ends = np.cumsum([len(p) for p in scores])
        keys = A.span_hash(A.prefix_hash(data), np.concatenate(([0], ends[:-1])), ends)
        self.shift = np.uint64(64 - (8 * len(keys)).bit_length())
        size = 1 << (64 - int(self.shift))
        self.slots = np.zeros(size, A.U)  # 0: free
        self.values = np.full(size, -np.inf)
        for k, v in zip(keys.tolist(), scores.values()):
            at = k >> int(self.shift)
            while self.slots[at]:
                at = (at + 1) % size
            self.slots[at], self.values[at] = k, v
        self.known = pd.Series(np.zeros(0, np.int64), index=pd.Index([], dtype=A.U))

    def score(self, key: np.ndarray) -> np.ndarray:
        at = (key >> self.shift).astype(np.int64)
        found = self.slots[at]
        out = np.where(found == key, self.values[at], -np.inf)
        todo = np.flatnonzero((found != key) & (found != 0))
        at, key = at[todo], key[todo]
        while len(todo):
            at = (at + 1) % len(self.slots)
            found = self.slots[at]
            hit = found == key
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (found != 0)
            todo, at, key = todo[on], at[on], key[on]
        return out

    def trie(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Terminal counts of distinct words of 1 to LONG bytes."""
        n = len(starts)
        if not n:
            return np.zeros(0, np.int64)
        data = buf.tobytes()
        words = [data[s:e] for s, e in zip(starts.tolist(), ends.tolist())]
        order = np.array(sorted(range(n), key=words.__getitem__))
        s, size = starts[order], (ends - starts)[order]
        both = np.minimum(size[1:], size[:-1])
        shared = np.zeros(n, np.int64)  # common prefix with the word before
        todo = np.arange(n - 1)
        d = 0
        while len(todo):
            todo = todo[both[todo] > d]
            todo = todo[buf[s[todo] + d] == buf[s[todo + 1] + d]]
            d += 1
            shared[todo + 1] = d
        prefix = A.prefix_hash(buf)
        back = max(self.lengths) + 1
        score: dict[int, np.ndarray] = {0: np.zeros(n)}
        pieces: dict[int, np.ndarray] = {0: np.zeros(n, np.int64)}
        out = np.zeros(n, np.int64)
        for d in range(1, int(size.max()) + 1):
            active = np.flatnonzero(size >= d)
            made = shared[active] < d  # the nodes of this level, each by its first word
            w = active[made]
            top = np.full(len(w), -np.inf)
            least = np.zeros(len(w), np.int64)
            end = s[w] + d
            for k in self.lengths:
                if k > d:
                    break
                g = self.score(A.span_hash(prefix, end - k, end))
                hit = np.flatnonzero(g > -np.inf)
                if not len(hit):
                    continue
                v = score[d - k][w[hit]] + g[hit]
                c = pieces[d - k][w[hit]] + 1
                better = (v > top[hit]) | ((v == top[hit]) & (c < least[hit]))
                hit = hit[better]
                top[hit], least[hit] = v[better], c[better]
            node = np.cumsum(made) - 1
            score[d], pieces[d] = np.zeros(n), np.zeros(n, np.int64)
            score[d][active], pieces[d][active] = top[node], least[node]
            last = active[size[active] == d]
            out[last] = pieces[d][last]
            score.pop(d - back, None)
            pieces.pop(d - back, None)
        res = np.empty(n, np.int64)
        res[order] = out
        return res

    def counts(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pre-tokens and tokens of each row."""
        starts, ends, bounds = pretokens(buf, offs)
        if not len(starts):
            return np.zeros(len(offs) - 1, np.int64), np.zeros(len(offs) - 1, np.int64)
        code, at, own = A.distinct_spans(buf, starts, ends)
        s, e = starts[at], ends[at]
        place = self.known.index.get_indexer(own)
        value = np.where(place >= 0, self.known.to_numpy()[place] if len(self.known) else 0, 0)
        new = np.flatnonzero(place < 0)
        short = new[(e - s)[new] <= LONG]
        size = (e - s)[short]
        packed = buf[A.ragged(s[short], size)]
        stop = np.cumsum(size)
        value[short] = self.trie(packed, stop - size, stop)
        for k in new[(e - s)[new] > LONG]:
            value[k] = segment(buf[s[k] : e[k]].tobytes(), self.scores, self.lengths)
        if len(self.known) + len(short) > KEPT:
            self.known = self.known.iloc[:0]
        if len(short):
            more = pd.Series(value[short], index=pd.Index(own[short]))
            self.known = pd.concat([self.known, more[~more.index.duplicated()]])
        return np.diff(bounds), A.sum_by_row(value[code], bounds)


SCHEMA = "doc_id long, n_pretokens long, n_tokens long"


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, scores: dict[bytes, float] | None = None) -> DataFrame:
    """One row per document: doc_id, n_pretokens, n_tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(checked(scores) if scores else zipf(read_ranks(vocabulary)))  # the vocabulary, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Unigram(shared.value)
        for batch, buf, offs in A.slices(batches, "text", SLICE):
            pre, n = model.counts(buf, offs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pre.astype(np.int64)), pa.array(n)], ["doc_id", "n_pretokens", "n_tokens"])

    return texts(docs, lower=False).mapInArrow(run, SCHEMA)
