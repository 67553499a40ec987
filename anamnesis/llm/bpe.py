"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

The pre-tokens of the corpus are counted; the most frequent, ``LEXICON`` at most, are
compiled, with the ids of their merges as outputs, into a minimal acyclic
automaton whose equal suffixes share states, stored as one array file that the
workers memory-map.  A slice's distinct pre-tokens walk it all at once; those
it doesn't hold are merged exactly.  ``LEXICON`` decides speed only, never ids.

The vocabulary is a file of byte sequences in rank order; its path is a
parameter.  The map over documents is narrow; counting shuffles distinct words.

Defined cases: a null or empty text has no ids and decodes to ''; texts of any
length are encoded whole; repeated rows give a row each; words of a level of
frequency are in the lexicon all or none; words of equal hash are told apart by
their bytes; a vocabulary without some single byte is refused; empty tables give
no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import arrays as A
from .frames import lean, shared_dir, texts, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEXICON = 1 << 17
SLICE = 1 << 21
COUNT_SLICE = 1 << 21


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return checked({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def checked(vocabulary: dict) -> dict:
    """The vocabulary, if every byte is a piece of it, without which some texts have no encoding; else ValueError."""
    missing = [b for b in range(256) if bytes([b]) not in vocabulary]
    if missing:
        raise ValueError(f"the vocabulary lacks {len(missing)} single bytes, the first 0x{missing[0]:02x}")
    return vocabulary


@lru_cache(1)
def classes() -> np.ndarray:
    """Of every code point: 0 white space, 1 letter, 2 number, 3 other."""
    out = np.full(0x110000, 3, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = 1
        elif k == "N":
            out[c] = 2
    out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 0
    return out


def pretokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the pre-tokens, which tile the rows, and the rows' bounds among them.

    As the usual expression splits: contractions, runs of letters, numbers or other signs with a space before
    them, and white space of which the last is left to what follows.
    """
    cp, co = A.codepoints(buf, offs)
    n = len(cp)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    cls = classes()[cp]
    row_start = np.zeros(n + 1, bool)
    row_start[co] = True
    first = np.empty(n + 1, bool)  # where a run of one class begins
    first[0] = first[n] = True
    np.not_equal(cls[1:], cls[:-1], out=first[1:n])
    first |= row_start
    begin = first[:n].copy()
    solid = first[:n] & (cls > 0)
    after = np.flatnonzero(solid & ~row_start[:n])
    after = after[cls[after - 1] == 0]  # a run that follows white space
    blank = cp[after - 1] == 32
    lone = first[after - 1]  # white space of length one
    begin[after[blank]] = False  # the space belongs to the run
    begin[after - 1] = True
    del lone
    tick = np.flatnonzero((cp == 39) & begin)
    tick = tick[(tick + 1 < n)]
    tick = tick[first[tick + 1] & ~row_start[tick + 1] & (cls[tick + 1] == 1)]  # alone, then letters
    if len(tick):
        a = cp[tick + 1]
        inside = (tick + 2 < n) & ~first[np.minimum(tick + 2, n)]
        b = np.where(inside, cp[np.minimum(tick + 2, n - 1)], 0)
        one = np.isin(a, [115, 116, 109, 100])
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        size = np.where(one, 1, np.where(two, 2, 0))
        hit = tick[size > 0]
        size = size[size > 0]
        begin[hit + 1] = False
        rest = hit + 1 + size
        rest = rest[rest < n]
        begin[rest] = True
    at = np.flatnonzero(begin)
    bounds = np.searchsorted(at, co)
    if len(cp) != len(buf):
        at = np.flatnonzero((buf & 0xC0) != 0x80)[at]
    return at, np.concatenate((at[1:], [len(buf)])), bounds


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Exact byte pair merges: always the leftmost pair of least rank."""
    n = len(word)
    nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\1") * n
    while heap:
        _, i, j, e = heapq.heappop(heap)
        if not alive[i] or j >= n or not alive[j] or end[i] != j or end[j] != e:
            continue
        alive[j] = 0
        end[i] = e
        k = nxt[i] = nxt[j]
        if k < n:
            prev[k] = i
            r = ranks.get(word[i : end[k]])
            if r is not None:
                heapq.heappush(heap, (r, i, k, end[k]))
        p = prev[i]
        if p >= 0:
            r = ranks.get(word[p:e])
            if r is not None:
                heapq.heappush(heap, (r, p, i, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = nxt[i]
    return out


class Lexicon:
    """Minimal acyclic transducer of sorted words: arcs sorted by state and symbol, with the number of words passed over as output.

    The sum of a word's outputs is its place in sorted order, which indexes the ids.
    """

    NAMES = ("keys", "targets", "outputs", "final", "offsets", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        for k in self.NAMES:
            setattr(self, k, arrays[k])
        self.longest = int(arrays["longest"][0])

    @classmethod
    def compile(cls, words: list[bytes], ids: list[list[int]]) -> Lexicon:
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...], int]] = []

        def close(node: list) -> int:
            key = (node[0], tuple(node[1]))
            s = register.get(key)
            if s is None:
                s = register[key] = len(states)
                states.append((node[0], key[1], node[0] + sum(states[t][2] for _, t in key[1])))
            return s

        path: list[list] = [[False, []]]  # open states along the last word: final, arcs
        last = b""
        for w in words:
            p = 0
            while p < len(last) and p < len(w) and last[p] == w[p]:
                p += 1
            for i in range(len(last), p, -1):
                s = close(path.pop())
                path[-1][1].append((last[i - 1], s))
            path += [[False, []] for _ in range(len(w) - p)]
            path[-1][0] = True
            last = w
        for i in range(len(last), 0, -1):
            s = close(path.pop())
            path[-1][1].append((last[i - 1], s))
        root = close(path[0])
        order = [root, *(s for s in range(len(states)) if s != root)]  # the root is state 0
        number = np.empty(len(states), np.int64)
        number[order] = np.arange(len(states))
        keys, targets, outputs = [], [], []
        for s in order:
            final, arcs, _ = states[s]
            passed = int(final)
            for c, t in arcs:
                keys.append(int(number[s]) << 8 | c)
                targets.append(int(number[t]))
                outputs.append(passed)
                passed += states[t][2]
        return cls(
            {
                "keys": np.array(keys, np.int64),
                "targets": np.array(targets, np.int32),
                "outputs": np.array(outputs, np.int32),
                "final": np.array([states[s][0] for s in order], np.uint8),
                "offsets": np.cumsum([0, *map(len, ids)]).astype(np.int32),
                "ids": np.array([i for x in ids for i in x], np.int32),
                "longest": np.array([max(map(len, words), default=0)], np.int32),
            }
        )

    def bytes(self) -> bytes:
        parts = [np.ascontiguousarray(getattr(self, k)).view(np.uint8) for k in self.NAMES]
        head = np.array([self.longest, *(len(p) for p in parts)], np.int64).view(np.uint8)
        return b"".join(x.tobytes() + b"\0" * (-len(x) % 8) for x in (head, *parts))

    @classmethod
    def view(cls, data: np.ndarray) -> Lexicon:
        """From the bytes above, memory-mapped or not, without a copy."""
        head = data[: 8 * 7].view(np.int64)
        arrays, at = {"longest": head[:1]}, 56
        for k, size, kind in zip(cls.NAMES, head[1:], (np.int64, np.int32, np.int32, np.uint8, np.int32, np.int32)):
            arrays[k] = data[at : at + int(size)].view(kind)
            at += int(size) + -int(size) % 8
        return cls(arrays)

    def find(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Place of each word in the lexicon, -1 where it isn't there."""
        length = ends - starts
        order = np.argsort(-length, kind="stable")
        order = order[np.searchsorted(-length[order], -self.longest, "left") :]
        s, n = starts[order], length[order]
        state, place = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        live = np.searchsorted(-n, -np.arange(self.longest + 1), "left") if len(n) else np.zeros(self.longest + 1, np.int64)
        for i in range(self.longest):
            a = live[i]
            if not a:
                break
            key = state[:a] << 8 | buf[s[:a] + i]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = (self.keys[k] == key) & (state[:a] >= 0)
            place[:a] += self.outputs[k]
            state[:a] = np.where(ok, self.targets[k], -1)
        out = np.full(len(starts), -1, np.int64)
        good = (state >= 0) & (n > 0) if len(self.keys) else np.zeros(len(n), bool)
        good &= self.final[np.maximum(state, 0)] > 0
        out[order[good]] = place[good]
        return out


class Merger:
    """Exact merges of many words at once: every round merges the leftmost pair of least rank of each word."""

    NONE = np.int32(np.iinfo(np.int32).max)

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        pairs = {(x << 32 | y): r for piece, r in ranks.items() for k in range(1, len(piece)) if (x := ranks.get(piece[:k])) is not None and (y := ranks.get(piece[k:])) is not None}
        self.shift = np.uint64(64 - max(4, (8 * len(pairs)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.slots = np.full(size, -1, np.int64)
        self.values = np.full(size, self.NONE, np.int32)
        keys, values = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        at = self._home(keys)
        while len(keys):  # open addressing, all keys at once: the first of each free slot takes it
            free = self.slots[at] < 0
            slot, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.slots[slot], self.values[slot] = keys[won], values[won]
            left = np.ones(len(keys), bool)
            left[won] = False
            keys, values, at = keys[left], values[left], (at[left] + 1) % size
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(A.BASE) >> self.shift).astype(np.int64)

    def rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x.astype(np.int64) << 32 | y
        at = self._home(key)
        out = np.full(len(key), self.NONE, np.int32)
        todo = np.arange(len(key))
        while len(todo):
            found = self.slots[at]
            hit = found == key
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (found >= 0)
            todo, key, at = todo[on], key[on], (at[on] + 1) % len(self.slots)
        return out

    def merge(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and their numbers."""
        size = ends - starts
        done: list[np.ndarray] = []
        owner: list[np.ndarray] = []
        data = buf
        for k in np.flatnonzero(size > 64):
            ids = merge(data[starts[k] : ends[k]].tobytes(), self.ranks)
            done.append(np.array(ids, np.int32))
            owner.append(np.full(len(ids), k))
        some = np.flatnonzero((size > 0) & (size <= 64))
        tok = self.single[buf[A.ragged(starts[some], size[some])]]
        word = np.repeat(some, size[some])
        rank = np.full(len(tok), self.NONE, np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.rank(tok[inner], tok[inner + 1])
        while len(tok):
            new = np.concatenate(([True], word[1:] != word[:-1]))
            begin = np.flatnonzero(new)
            least = np.minimum.reduceat(rank, begin)
            each = np.repeat(least, np.diff(np.concatenate((begin, [len(tok)]))))
            over = each == self.NONE
            if over.any():
                done.append(tok[over])
                owner.append(word[over])
                on = ~over
                tok, word, rank, each = tok[on], word[on], rank[on], each[on]
                if not len(tok):
                    break
            at = np.flatnonzero(rank == each)
            at = at[np.concatenate(([True], word[at[1:]] != word[at[:-1]]))]
            tok[at] = rank[at]
            keep = np.ones(len(tok), bool)
            keep[at + 1] = False
            tok, word, rank = tok[keep], word[keep], rank[keep]
            at -= np.arange(len(at))
            for i in (at, at[at > 0] - 1):
                if len(i):
                    j = np.minimum(i + 1, len(tok) - 1)
                    pair = (j > i) & (word[j] == word[i])
                    rank[i] = np.where(pair, self.rank(tok[i], tok[j]), self.NONE)
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(starts), np.int64)
        ids, own = np.concatenate(done), np.concatenate(owner)
        order = np.argsort(own, kind="stable")
        return ids[order], np.bincount(own, minlength=len(starts))


class Encoder:
    def __init__(self, ranks: dict[bytes, int], lexicon: Lexicon | None):
        """Without a lexicon it only decodes."""
        if lexicon is not None:
            self.merger, self.lexicon = Merger(ranks), lexicon
        size = max(ranks.values(), default=-1) + 1
        pieces = [b""] * size
        for piece, r in ranks.items():
            pieces[r] = piece
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.piece_offs = np.cumsum([0, *map(len, pieces)])

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and the rows' bounds among them."""
        starts, ends, bounds = pretokens(buf, offs)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        code, at, _ = A.distinct_spans(buf, starts, ends)
        s, e = starts[at], ends[at]
        place = self.lexicon.find(buf, s, e)
        known = place >= 0
        unseen = np.flatnonzero(~known)
        extra, extra_size = self.merger.merge(buf, s[unseen], e[unseen])
        begin, size = np.empty(len(s), np.int64), np.empty(len(s), np.int64)
        begin[known] = self.lexicon.offsets[place[known]]
        size[known] = self.lexicon.offsets[place[known] + 1] - begin[known]
        size[unseen] = extra_size
        begin[unseen] = len(self.lexicon.ids) + np.cumsum(size[unseen]) - size[unseen]
        ids = np.concatenate((self.lexicon.ids, extra))
        count = size[code]
        return ids[A.ragged(begin[code], count)], np.concatenate(([0], np.cumsum(count)))[bounds]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes and row offsets."""
        begin = self.piece_offs[ids]
        size = self.piece_offs[ids + 1] - begin
        return self.piece_bytes[A.ragged(begin, size)], np.concatenate(([0], np.cumsum(size)))[bounds]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all pre-tokens of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, buf, offs in A.slices(batches, "text", COUNT_SLICE):
            starts, ends, _ = pretokens(buf, offs)
            if not len(starts):
                continue
            code, at, _ = A.distinct_spans(buf, starts, ends)
            s, size = starts[at], ends[at] - starts[at]
            data = pa.py_buffer(buf[A.ragged(s, size)].tobytes())
            words = pa.BinaryArray.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), data])
            yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(code).astype(np.int64))], ["word", "n"])

    return texts(docs, lower=False).mapInArrow(lean(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, ranks: dict[bytes, int], size: int = LEXICON, longest: int = 64) -> Lexicon:
    counts = written(word_counts(docs).where((F.length("word") <= longest) & (F.col("n") > 1)), "words")
    level = F.floor(F.log2("n") * 8)
    room, least = size, 1 << 62  # the lowest level of frequency down to which all words fit: a few hundred rows decide, not a sort
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        if r["count"] > room:
            break
        room, least = room - r["count"], r.level
    frequent = counts.where(level >= least).select("word").collect()
    words = sorted(bytes(r.word) for r in frequent)
    return Lexicon.compile(words, [merge(w, ranks) for w in words])


def publish(spark: SparkSession, lexicon: Lexicon):  # type: ignore[no-untyped-def]
    """A function that gives the lexicon on a worker: memory-mapped from the shared folder if that is mounted, else from a broadcast of its bytes (bounded by LEXICON)."""
    url = urlparse(shared_dir(spark))
    if url.scheme in ("", "file"):
        path = f"{url.path}/lexicon-{uuid.uuid4().hex}.bin"
        import os

        os.makedirs(url.path, exist_ok=True)
        with open(path, "wb") as f:
            f.write(lexicon.bytes())
        return lambda: Lexicon.view(np.memmap(path, np.uint8, "r"))
    held = spark.sparkContext.broadcast(lexicon.bytes())
    return lambda: Lexicon.view(np.frombuffer(held.value, np.uint8))


SCHEMA = "doc_id long, n_tokens int, tokens array<int>, round_trip boolean"


def bpe(docs: DataFrame, vocabulary: str = VOCABULARY, lexicon: int = LEXICON) -> DataFrame:
    """One row per document: doc_id, n_tokens, tokens, and whether the tokens decode to the very text."""
    spark = docs.sparkSession
    ranks = read_ranks(vocabulary)
    shared = spark.sparkContext.broadcast(ranks)  # the vocabulary, whatever the data
    open_lexicon = publish(spark, build_lexicon(docs, ranks, lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(shared.value, open_lexicon())
        for batch, buf, offs in A.slices(batches, "text", SLICE):
            ids, bounds = coder.encode(buf, offs)
            back, at = coder.decode(ids, bounds)
            if len(back) == len(buf):
                differ = np.searchsorted(offs, np.flatnonzero(back != buf), "right") - 1
                same = at == offs
                ok = same[1:] & same[:-1]
                ok[differ] = False
            else:
                ok = np.array([back[at[r] : at[r + 1]].tobytes() == buf[offs[r] : offs[r + 1]].tobytes() for r in range(len(offs) - 1)], bool)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(bounds).astype(np.int32)), A.list_array(bounds, pa.array(ids.astype(np.int32))), pa.array(ok)],
                ["doc_id", "n_tokens", "tokens", "round_trip"],
            )

    return texts(docs, lower=False).mapInArrow(lean(run), SCHEMA)


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and text of rows with doc_id and tokens; bytes that are no UTF-8 become the replacement character; null tokens give a null text; null ids and ids outside the vocabulary raise."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(shared.value, None)
        known = np.zeros(len(coder.piece_offs) - 1, bool)
        known[list(shared.value.values())] = True
        for batch in batches:
            tokens = batch.column(1)
            ids = tokens.flatten()
            if ids.null_count:
                raise ValueError("a token is null")
            ids = ids.to_numpy().astype(np.int64)
            if len(ids) and (ids.min() < 0 or ids.max() >= len(known) or not known[ids].all()):
                raise ValueError("a token is not in the vocabulary")
            size = tokens.value_lengths().fill_null(0).to_numpy()
            raw, at = coder.decode(ids, np.concatenate(([0], np.cumsum(size))))
            data = raw.tobytes()
            out = [data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string(), mask=tokens.is_null().to_numpy(zero_copy_only=False))], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "tokens").mapInArrow(lean(run), "doc_id long, text string")
