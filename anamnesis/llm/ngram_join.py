"""N-gram Jaccard join: a blocked sparse matrix product of documents by n-grams.

Finds every pair of documents whose sets of word n-grams have a Jaccard
similarity of at least ``threshold`` and returns one row per document: its class
(the smallest doc_id that links lead to) and its number of links, all of them
counted.  The incidence matrix is cut into column blocks (by n-gram hash); rows
of a block travel as packed arrays, 7 bytes an entry, so no JVM row is made per
n-gram.  N-grams are hashes of ``BITS`` bits whatever the cluster.

1. Column blocks count document frequencies.  A document needs a partner that
   holds ``threshold`` of its n-grams, so one with fewer n-grams of frequency
   above 1 is discarded (a size-derived bound); most end here.
2. Identical sets are folded into one, which counts for all its copies: copies
   are never paired with each other.
3. The product over the survivors' rarest columns (s - ceil(t n) + 1 of s)
   accumulates overlap counts.  Columns are gathered by their least document,
   which near copies share, so a pair's counts meet in few tasks; summed, pairs
   whose count cannot reach t / (1 + t) (n_a + n_b) any more are discarded.
   Pairs travel packed by document, 16 bytes each, and not as rows; a task hands
   on what it has counted, PAIRS pairs or so at a time.
4. The remaining pairs get their full overlap from dense tiles of the product.
   A neighbourhood is cut into cells of ``SIDE`` documents a side, as a column of
   more than ``LONG`` is, each a task's work of its own; a set travels once per
   cell.  A cell returns a row per document, not per pair.

No cap on partners or frequencies: frequent n-grams are last in the order and
are only multiplied where a document consists of them.

Defined cases: words are runs of letters and digits of the lower-cased text; a
text of 1 to n - 1 words has one gram of all of them; null or wordless texts
have no n-gram and no partner and are a class of their own; rows with a null
doc_id are not reported and count for nobody; rows that repeat a doc_id with
different texts are documents of their own, equal rows are one document (with a
row of the result for each); among equals of a class the least doc_id, then the
least hash of the row is kept; empty tables give no rows; other columns are not
read.  Columns of the result: doc_id, class_id, n_links, max_jaccard (null
without link).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from . import arrays as A
from .frames import dropped, lean, parallelism, written

N = 5
THRESHOLD = 0.5
BITS = 54
ROWS = 1 << (64 - BITS)
SLICE = 1 << 20
BATCH = 1 << 21
TILE = 1 << 9
DENSE = 1 << 10
PAIRS = 1 << 20
CHUNK = 1 << 22
SIDE = LONG = 1 << 11
MAX_BROADCAST = 1 << 20
EPS = 1e-9


def node_of(doc_id: Column, text: Column) -> Column:
    """Identity of a row: its doc_id and text."""
    return F.xxhash64(doc_id.cast("long"), text)


def distinct_grams(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (row, n-gram) of a slice of ROWS rows at most."""
    starts, ends, bounds = A.words(buf, offs)
    g, b = A.ngram_hashes(A.word_hashes(buf, starts, ends), bounds, n)
    row = np.repeat(np.arange(len(offs) - 1, dtype=np.uint64), np.diff(b))
    key = row << np.uint64(BITS)
    key |= g >> np.uint64(64 - BITS)
    key.sort()
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return (key >> np.uint64(BITS)).astype(np.int64), key & np.uint64((1 << BITS) - 1)


def _blob(a: np.ndarray) -> bytes:
    return a.tobytes()


def pack(grams: np.ndarray) -> bytes:
    """The seven low bytes of each gram."""
    return np.ascontiguousarray(grams.view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def unpack(parts: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 7)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :7] = raw
    return out.view(np.uint64).ravel()


def _least(n: np.ndarray, t: float) -> np.ndarray:
    """Least overlap that a set of size n needs with any partner."""
    return np.ceil(t * n - EPS).astype(np.int64)


INCIDENCE = "block int, batch long, docs binary, counts binary, grams binary, heads binary"
SHARED = "block int, batch long, docs binary, counts binary, grams binary, df binary, heads binary"
HEAD = np.dtype([("node", "<i8"), ("doc_id", "<i8"), ("key", "<i8"), ("n", "<i4")])


def incidence(docs: DataFrame, n: int, blocks: int) -> DataFrame:
    """Packed entries by column block, of batches of about BATCH entries; one block of each batch carries the documents' heads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            heads, rows, gram = (np.concatenate(x) for x in zip(*held))
            block = (gram % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block.astype(np.uint16) if blocks <= 1 << 16 else block, kind="stable")
            block, rows, gram = block[order], rows[order], gram[order]
            at = np.searchsorted(block, np.arange(blocks + 1))
            out: list[list] = [[] for _ in range(6)]
            home = batch % blocks
            for k in range(blocks):
                i, j = at[k], at[k + 1]
                if i == j and k != home:
                    continue
                first = i + np.flatnonzero(np.diff(rows[i:j], prepend=-1))
                values = (k, batch, _blob(rows[first].astype(np.uint32)), _blob(np.diff(first, append=j).astype(np.uint32)), pack(gram[i:j]), _blob(heads) if k == home else None)
                for c, v in zip(out, values):
                    c.append(v)
                if len(out[0]) >= 512:
                    yield _batch(out, INCIDENCE)
                    out = [[] for _ in range(6)]
            if out[0]:
                yield _batch(out, INCIDENCE)

        for part, buf, offs in A.slices(batches, "text", SLICE, ROWS):
            rows, gram = distinct_grams(buf, offs, n)
            if not len(gram):
                continue
            heads = np.zeros(len(offs) - 1, HEAD)
            heads["node"], heads["doc_id"] = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
            bounds = np.searchsorted(rows, np.arange(len(offs)))
            heads["n"] = np.diff(bounds)
            with np.errstate(over="ignore"):
                total = A.sum_by_row(A.mix(gram.copy()).view(np.int64), bounds).view(np.uint64)
                heads["key"] = A.mix(total + heads["n"].astype(np.uint64) * np.uint64(A.BASE)).view(np.int64)  # of the set, for its copies too
            held.append((heads, rows + count, gram))
            size, count = size + len(gram), count + len(heads)
            if size >= BATCH:
                yield from flush()
                held, size, count = [], 0, 0
                batch += 1
        if held:
            yield from flush()

    own = docs.where(docs["doc_id"].isNotNull() & docs["text"].isNotNull())
    rows = own.select(node_of(docs["doc_id"], docs["text"]).alias("node"), docs["doc_id"].cast("long").alias("doc_id"), F.lower(docs["text"]).alias("text"))
    return rows.mapInArrow(lean(run), INCIDENCE)


_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields)], [name for name, _ in fields])


def shared_grams(entries: DataFrame, blocks: int) -> DataFrame:
    """Entries whose n-gram occurs in two rows or more, with the frequency (255 for more, which orders columns only)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(6)))]
        if not rows:
            return
        gram = unpack([r[4] for r in rows])
        length = np.array([len(r[4]) // 7 for r in rows])
        order = np.argsort(gram)
        g = gram[order]
        first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
        count = np.diff(np.concatenate((first, [len(g)])))
        df = np.empty(len(g), np.uint8)
        df[order] = np.repeat(np.minimum(count, 255), count).astype(np.uint8)
        del order, g
        keep = df > 1
        at = np.concatenate(([0], np.cumsum(length)))
        out: list[list] = [[] for _ in range(7)]
        for k, r in enumerate(rows):
            s = slice(at[k], at[k + 1])
            m = keep[s]
            if not m.any() and r[5] is None:
                continue
            docs, counts = np.frombuffer(r[2], np.uint32), np.frombuffer(r[3], np.uint32)
            left = A.sum_by_row(m.astype(np.int64), np.concatenate(([0], np.cumsum(counts.astype(np.int64)))))
            some = left > 0
            for c, v in zip(out, (r[0], r[1], _blob(docs[some]), _blob(left[some].astype(np.uint32)), pack(gram[s][m]), _blob(df[s][m]), r[5])):
                c.append(v)
            if len(out[0]) >= 512:
                yield _batch(out, SHARED)
                out = [[] for _ in range(7)]
        if out[0]:
            yield _batch(out, SHARED)

    return entries.repartitionById(blocks, "block").mapInArrow(lean(run), SHARED)


SURVIVOR = "batch long, place int, node long, doc_id long, n int, set_key long, grams binary"


def survivors(shared: DataFrame, threshold: float) -> DataFrame:
    """Documents with enough shared n-grams: size and key of the set, and the shared n-grams, rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for b in batches:
            for r in zip(*(b.column(k).to_pylist() for k in range(7))):
                by.setdefault(r[1], []).append(r)
        for batch, rows in by.items():
            head = np.frombuffer(next(r[6] for r in rows if r[6] is not None), HEAD)
            gram = unpack([r[4] for r in rows])
            doc = np.concatenate([np.repeat(np.frombuffer(r[2], np.uint32), np.frombuffer(r[3], np.uint32)) for r in rows]).astype(np.int64)
            df = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
            n = head["n"]
            s = np.bincount(doc, minlength=len(head))
            alive = (n > 0) & (s >= _least(n, threshold))
            k = alive[doc]
            doc, gram, df = doc[k], gram[k], df[k]
            order = np.argsort(gram | df.astype(np.uint64) << np.uint64(BITS), kind="stable")
            order = order[np.argsort(doc[order].astype(np.int32), kind="stable")]
            doc, gram = doc[order], gram[order]
            at = np.searchsorted(doc, np.arange(len(head) + 1))
            out: list[list] = [[] for _ in range(7)]
            for d in np.flatnonzero(alive).tolist():
                for c, v in zip(out, (batch, d, int(head["node"][d]), int(head["doc_id"][d]), int(n[d]), int(head["key"][d]), pack(gram[at[d] : at[d + 1]]))):
                    c.append(v)
            if out[0]:
                yield _batch(out, SURVIVOR)

    return shared.repartition("batch").mapInArrow(lean(run), SURVIVOR)


LISTS = "home long, split int, docs binary, sizes binary, lengths binary"


def columns(sets: DataFrame, blocks: int, threshold: float, long: int = LONG) -> DataFrame:
    """The columns of both documents' rarest n-grams, gathered by their least document: near copies share it, so their counts meet in one task.

    A column of more than ``long`` documents is cut into pairs of pieces, each a task's work of its own (split: documents of the first piece).
    """
    schema = "block int, docs binary, sizes binary, grams binary"

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, once = np.unique(b.column(0).to_numpy(), return_index=True)  # of copies one
            n = b.column(1).to_numpy()[once]
            raw = b.column(2).take(pa.array(once)).to_pylist()
            take = np.array([len(x) // 7 for x in raw]) - _least(n, threshold) + 1
            gram = unpack([x[: 7 * k] for x, k in zip(raw, take.tolist())])
            doc, size = np.repeat(ids, take), np.repeat(n.astype(np.int32), take)
            block = (gram % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            gram, doc, size = gram[order], doc[order], size[order]
            at = np.searchsorted(block[order], np.arange(blocks + 1))
            ks = np.flatnonzero(at[1:] > at[:-1])
            yield _batch([ks.tolist(), *([_blob(x[at[k] : at[k + 1]]) for k in ks] for x in (doc, size)), [pack(gram[at[k] : at[k + 1]]) for k in ks]], schema)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[], [], []]
        for b in batches:
            for k in range(3):
                cols[k] += b.column(k + 1).to_pylist()
        if not cols[0]:
            return
        doc, size, gram = np.frombuffer(b"".join(cols[0]), np.int64), np.frombuffer(b"".join(cols[1]), np.int32), unpack(cols[2])
        order = np.lexsort((doc, size, gram))
        doc, size, gram = doc[order], size[order], gram[order]
        once = np.concatenate(([True], (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])))  # copies of a set are equal here
        doc, size, gram = doc[once], size[once], gram[once]
        begin = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        length = np.diff(begin, append=len(gram))
        home = np.minimum.reduceat(doc, begin)
        out: list[list] = [[] for _ in range(5)]

        def add(key: int, split: int, docs: np.ndarray, sizes: np.ndarray, lengths: np.ndarray) -> None:
            for c, v in zip(out, (key, split, _blob(docs), _blob(sizes), _blob(lengths.astype(np.uint32)))):
                c.append(v)

        short = np.flatnonzero((length > 1) & (length <= long))
        short = short[np.argsort(home[short], kind="stable")]
        at = A.ragged(begin[short], length[short])
        docs, sizes = doc[at], size[at]
        stop = np.cumsum(length[short])
        for group in np.split(np.arange(len(short)), np.flatnonzero(np.diff(home[short])) + 1):
            if len(group):
                i, j = int(stop[group[0]] - length[short[group[0]]]), int(stop[group[-1]])
                add(int(home[short[group[0]]]), 0, docs[i:j], sizes[i:j], length[short[group]])
                if len(out[0]) >= 4096:
                    yield _batch(out, LISTS)
                    out = [[] for _ in range(5)]
        for g in np.flatnonzero(length > long).tolist():
            own = slice(begin[g], begin[g] + length[g])
            pieces = 1 << (-(-int(length[g]) // long) - 1).bit_length()  # columns of like lengths are cut alike, so their counts meet
            piece = (A.mix(doc[own].view(np.uint64).copy()) % np.uint64(pieces)).astype(np.int64)
            where = [np.flatnonzero(piece == k) for k in range(pieces)]
            for i in range(pieces):
                for j in range(i, pieces):
                    m = where[i] if i == j else np.concatenate((where[i], where[j]))
                    key = int(A.mix(np.array([home[g]], np.int64).view(np.uint64) + np.uint64(i * pieces + j + 1)).view(np.int64)[0])
                    if len(m) > 1:
                        add(key, 0 if i == j else len(where[i]), doc[own][m], size[own][m], np.array([len(m)]))
                    if len(out[0]) >= 64:
                        yield _batch(out, LISTS)
                        out = [[] for _ in range(5)]
        if out[0]:
            yield _batch(out, LISTS)

    packed = sets.select(F.col("set_key").alias("node"), "n", "grams").mapInArrow(lean(scatter), schema)
    return packed.repartitionById(blocks, "block").mapInArrow(lean(gather), LISTS)


PARTIAL = "b long, n int, others binary, sizes binary, counts binary"


def by_larger(ids: np.ndarray, sizes: np.ndarray, large: np.ndarray, other: np.ndarray, times: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs, in order of the larger, as PARTIAL; those whose sizes alone rule them out are left out."""
    a, b = sizes[large], sizes[other]
    m = np.minimum(a, b) >= np.ceil(threshold * np.maximum(a, b) - EPS)
    large, other, times = large[m], other[m], times[m]
    at = np.append(np.flatnonzero(np.diff(large, prepend=-1)), len(large))
    k = 0
    while k < len(at) - 1:
        e = min(k + 4096, max(k + 1, int(np.searchsorted(at, at[k] + PAIRS // 4, "right")) - 1))
        who, cuts, here = large[at[k:e]], at[k : e + 1] - at[k], slice(at[k], at[e])
        columns_ = ids[other[here]], sizes[other[here]].astype(np.int32), times[here].astype(np.uint32)
        yield _batch([ids[who], sizes[who].astype(np.int32), *([_blob(x[i:j]) for i, j in zip(cuts, cuts[1:])] for x in columns_)], PARTIAL)
        k = e


def sparse_counts(ids: np.ndarray, sizes: np.ndarray, doc: np.ndarray, length: np.ndarray, split: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """Overlap counts from the pairs of each column, PAIRS of them at a time; what is counted is handed on at once."""
    begin = np.repeat(np.cumsum(length) - length, length)
    place, cut = np.arange(len(doc)) - begin, np.repeat(split, length)
    count = np.where(cut == 0, place, np.where(place >= cut, cut, 0))
    order = np.argsort(doc, kind="stable")  # all pairs of a document at once, so few are handed on twice
    doc_, begin, count = doc[order], begin[order], count[order]
    total = np.concatenate(([0], np.cumsum(count)))
    i = 0
    while i < len(count):
        j = max(i + 1, int(np.searchsorted(total, total[i] + PAIRS, "right")) - 1)
        if total[j] > total[i]:
            x, y = np.repeat(doc_[i:j], count[i:j]), doc[A.ragged(begin[i:j], count[i:j])]
            codes, times = np.unique(np.maximum(x, y) * len(ids) + np.minimum(x, y), return_counts=True)
            del x, y
            large, other = np.divmod(codes, len(ids))
            real = large != other
            yield from by_larger(ids, sizes, large[real], other[real], times[real], threshold)
        i = j


def dense_counts(ids: np.ndarray, sizes: np.ndarray, doc: np.ndarray, length: np.ndarray, split: np.ndarray, threshold: float) -> Iterator[pa.RecordBatch]:
    """The same from tiles of the product of the incidence matrix with its transpose; columns that are cut and others apart."""
    column, place = np.repeat(np.arange(len(length)), length), np.arange(len(doc)) - np.repeat(np.cumsum(length) - length, length)
    cut = np.repeat(split, length)
    side = DENSE
    step = CHUNK // side

    def block(m: np.ndarray, row: int, c: int) -> np.ndarray:
        out = np.zeros((min(side, len(ids) - row), min(step, len(length) - c)), np.float32)
        m = m[(column[m] >= c) & (column[m] < c + step)]
        out[doc[m] - row, column[m] - c] = 1
        return out

    def rows_of(m: np.ndarray, row: int) -> np.ndarray:
        return np.flatnonzero(m & (doc >= row) & (doc < row + side))

    whole, first, rest = cut == 0, (cut > 0) & (place < cut), (cut > 0) & (place >= cut)
    terms = [t for t in ((whole, whole), (first, rest), (rest, first)) if t[0].any()]
    for i in range(0, len(ids), side):
        for j in range(0, i + 1, side):
            total = np.zeros((min(side, len(ids) - i), min(side, len(ids) - j)), np.float32)
            for left, right in terms:
                l, r = rows_of(left, i), rows_of(right, j)
                for c in range(0, len(length), step):
                    total += block(l, i, c) @ block(r, j, c).T
            x, y = np.nonzero(np.tril(total, -1) if i == j else total)
            yield from by_larger(ids, sizes, x + i, y + j, total[x, y], threshold)


def product(lists: DataFrame, threshold: float) -> DataFrame:
    """Overlap counts of pairs of documents, by the larger of both; pairs whose sizes alone rule them out are left out.

    A pair may come in several rows, whose counts add up: a task holds its columns and the counts of PAIRS pairs or so,
    however many pairs it has.  Small homes are counted together; a home of many pairs by itself, as a dense product
    where that is less work.
    """

    def counted(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, doc = np.unique(np.concatenate([np.frombuffer(r[2], np.int64) for r in rows]), return_inverse=True)
        sizes = np.zeros(len(ids), np.int64)
        sizes[doc] = np.concatenate([np.frombuffer(r[3], np.int32) for r in rows])
        length = np.concatenate([np.frombuffer(r[4], np.uint32) for r in rows]).astype(np.int64)
        split = np.repeat([r[1] for r in rows], [len(r[4]) // 4 for r in rows])
        pairs = sum(map(pairs_of, rows))
        dense = pairs > PAIRS and len(ids) ** 2 * len(length) < 256 * pairs
        yield from (dense_counts if dense else sparse_counts)(ids, sizes, doc, length, split, threshold)

    def pairs_of(row: tuple) -> int:
        n = np.frombuffer(row[4], np.uint32).astype(np.int64)
        return int((row[1] * (n - row[1])).sum() if row[1] else (n * (n - 1) // 2).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes: dict[int, list[tuple]] = {}
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(5))):
                homes.setdefault(row[0], []).append(row)
        held: list[tuple] = []
        size = entries = 0
        while homes:
            rows = homes.popitem()[1]
            own = sum(map(pairs_of, rows))
            if own > PAIRS:
                yield from counted(rows)
                continue
            held += rows
            size, entries = size + own, entries + sum(len(r[2]) // 8 for r in rows)
            if max(size, entries) > PAIRS:
                yield from counted(held)
                held, size, entries = [], 0, 0
        if held:
            yield from counted(held)

    return lists.repartition("home").mapInArrow(lean(run), PARTIAL)


CELLS = "cell long, node long, others binary"


def candidates(partial: DataFrame, threshold: float, side: int = SIDE) -> DataFrame:
    """Pairs whose accumulated overlap can still reach the bound, packed, by cell: (cell, node, the smaller documents to compare with), and, without others, who is in a cell.

    A common n-gram outside the two prefixes lies in the suffix of the document whose prefix ends first.  A pair belongs
    to the neighbourhood of the least document that its larger one may be similar to; a document with more than ``side``
    others has them in that many pieces, and its pairs in cells by both documents' pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list] = {}
        size: dict[int, int] = {}
        for batch in batches:
            for b, n, *rest in zip(*(batch.column(k).to_pylist() for k in range(5))):
                rows.setdefault(b, []).append(rest)
                size[b] = n
        out: list[list] = [[], [], []]
        there: list[tuple[np.ndarray, np.ndarray]] = []
        held = known = 0

        def settle() -> None:
            nonlocal there, known
            cell, node = (np.concatenate(x) for x in zip(*there))
            order = np.lexsort((node, cell))
            cell, node = cell[order], node[order]
            once = np.concatenate(([True], (cell[1:] != cell[:-1]) | (node[1:] != node[:-1])))
            there, known = [(cell[once], node[once])], int(once.sum())

        def members() -> Iterator[pa.RecordBatch]:
            cell, node = there[0]
            for k in range(0, len(cell), 1 << 16):
                yield _batch([cell[k : k + (1 << 16)], node[k : k + (1 << 16)], [None] * len(cell[k : k + (1 << 16)])], CELLS)

        while rows:
            b, parts = rows.popitem()
            others, first, inv = np.unique(np.frombuffer(b"".join(r[0] for r in parts), np.int64), return_index=True, return_inverse=True)
            nb = np.frombuffer(b"".join(r[1] for r in parts), np.int32)[first].astype(np.int64)
            c = np.bincount(inv, np.frombuffer(b"".join(r[2] for r in parts), np.uint32))
            rest = np.maximum(_least(np.array([size[b]]), threshold), _least(nb, threshold)) - 1
            need = np.ceil((size[b] + nb) * (threshold / (1 + threshold)) - EPS)
            others = others[c + rest >= need]
            if not len(others):
                continue
            pieces = 1 << max(0, (len(others) - 1) // side).bit_length()
            home = A.mix(np.array([others[0], b], np.int64).view(np.uint64))
            piece = A.mix(others.view(np.uint64).copy()) % np.uint64(pieces)
            with np.errstate(over="ignore"):
                cell = A.mix(home[0] * np.uint64(A.BASE) + np.uint64(pieces << 32) + home[1] % np.uint64(pieces) + A.mix(piece + np.uint64(1))).view(np.int64)
            cells = np.unique(cell)
            for k in cells.tolist():
                for col, v in zip(out, (k, b, _blob(others[cell == k]))):
                    col.append(v)
            there += [(cell, others), (cells, np.full(len(cells), b))]
            held, known = held + len(others), known + len(others) + len(cells)
            if len(out[0]) >= 4096 or held > PAIRS // 2:
                yield _batch(out, CELLS)
                out, held = [[], [], []], 0
            if known > PAIRS:
                settle()
                if known > PAIRS // 2:  # those that come again are dropped later
                    yield from members()
                    there, known = [], 0
        if out[0]:
            yield _batch(out, CELLS)
        if there:
            settle()
            yield from members()

    return partial.repartition("b").mapInArrow(lean(run), CELLS)


def factors(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """The incidence matrix of the n-grams that two sets or more hold: (row, column) of its entries by column, and its width."""
    gram = np.concatenate(grams)
    row = np.repeat(np.arange(len(grams), dtype=np.int32), [len(g) for g in grams])
    parts, width = np.uint64(1 + len(gram) // PAIRS), 0
    rows, columns_ = [], []
    for p in range(int(parts)):
        mine = np.flatnonzero(gram % parts == np.uint64(p))
        mine = mine[np.argsort(gram[mine], kind="stable")]
        new = np.diff(gram[mine], prepend=~gram[mine[:1]]) != 0
        column = np.cumsum(new) - 1
        common = np.bincount(column)[column] > 1
        rows.append(row[mine[common]])
        columns_.append((np.cumsum(new & common) - 1 + width)[common].astype(np.int32))
        width += int((new & common).sum())
    return np.concatenate(rows), np.concatenate(columns_), width


def overlap(grams: list[np.ndarray], x: np.ndarray, y: np.ndarray, known: tuple[np.ndarray, np.ndarray, int] | None = None) -> np.ndarray:
    """Sizes of the intersections of sets x[i] and y[i], from dense tiles of the product of the incidence matrix with its transpose (known: its factors)."""
    if not len(x):
        return np.zeros(0, np.int64)
    row, column, width = known or factors(grams)
    out = np.zeros(len(x), np.int64)
    tile = x // TILE * ((len(grams) // TILE) + 1) + y // TILE
    for t in np.unique(tile):
        mine = np.flatnonzero(tile == t)
        i, j = int(x[mine[0]]) // TILE * TILE, int(y[mine[0]]) // TILE * TILE
        h, w = min(TILE, len(grams) - i), min(TILE, len(grams) - j)
        step = max(256, CHUNK // max(h, w) // 2)
        cuts = np.searchsorted(column, np.arange(0, width + step, step))
        total = np.zeros((h, w), np.float32)
        for c, a, b in zip(range(0, width, step), cuts, cuts[1:]):
            r, k = row[a:b], column[a:b] - c
            left = np.zeros((h, min(step, width - c)), np.float32)
            m = (r >= i) & (r < i + h)
            left[r[m] - i, k[m]] = 1
            if i == j:
                right = left
            else:
                right = np.zeros((w, min(step, width - c)), np.float32)
                m = (r >= j) & (r < j + w)
                right[r[m] - j, k[m]] = 1
            total += left @ right.T
        out[mine] = total[x[mine] - i, y[mine] - j].astype(np.int64)
    return out


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, root of each) of the components of edges (a, b), root the least node."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        new = root.copy()
        np.minimum.at(new, x, root[y])
        np.minimum.at(new, y, root[x])
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


LINKS = "node long, root long, links long, best double"


def verify(cells: DataFrame, sets: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """By cell and set with a similar one: links (to documents, copies of the other set counted), the best similarity and a root that its cell's pairs lead to."""
    member = cells.where("others IS NULL").select("cell", "node").distinct()
    need = written(member.join(reps, F.col("node") == F.col("set_key")).select("cell", "node", "copies", "r.batch", "r.place"), "need")
    if need.count() <= MAX_BROADCAST:  # 40 bytes a row; beyond, a join by shuffle, which moves all sets
        need = F.broadcast(need)
    none = F.lit(None)
    rows = sets.select("batch", "place", "n", "grams").join(need, ["batch", "place"]).select("cell", "node", none.cast("binary").alias("others"), "n", "copies", "grams")
    both = rows.union(cells.where("others IS NOT NULL").select("cell", "node", "others", none.cast("int"), none.cast("long"), none.cast("binary")))

    def judge(sets_: list, own_: list) -> pa.RecordBatch | None:
        if not own_:
            return None
        members = sorted(sets_, key=lambda r: r[0])
        ids, n, copies = (np.array([m[k] for m in members]) for k in (0, 1, 2))
        grams = [unpack([m[3]]) for m in members]
        known = factors(grams)
        at = np.searchsorted(ids, np.array([b for b, _ in own_]))
        links, best = np.zeros(len(ids)), np.zeros(len(ids))
        roots: list[tuple[np.ndarray, np.ndarray]] = []
        for t in np.unique(at // TILE):  # a row of tiles at a time
            mine = np.flatnonzero(at // TILE == t)
            x = np.repeat(at[mine], [len(own_[k][1]) // 8 for k in mine])
            y = np.searchsorted(ids, np.frombuffer(b"".join(own_[k][1] for k in mine), np.int64))
            common = overlap(grams, x, y, known)
            j = common / (n[x] + n[y] - common)
            ok = j >= threshold - EPS
            x, y, j = x[ok], y[ok], j[ok]
            links += np.bincount(x, copies[y], len(ids)) + np.bincount(y, copies[x], len(ids))
            np.maximum.at(best, x, j)
            np.maximum.at(best, y, j)
            roots.append(stars(x, y))
        nodes, root = stars(*(np.concatenate(c) for c in zip(*roots)))
        if not len(nodes):
            return None
        return pa.RecordBatch.from_arrays([pa.array(ids[nodes]), pa.array(ids[root]), pa.array(links[nodes].astype(np.int64)), pa.array(best[nodes])], ["node", "root", "links", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets_, own_ = None, [], []
        for batch in batches:
            for key, node, others, n, copies, grams in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if key != at:
                    out = judge(sets_, own_)
                    if out is not None:
                        yield out
                    at, sets_, own_ = key, [], []
                if grams is None:
                    own_.append((node, others))
                else:
                    sets_.append((node, n, copies, grams))
        out = judge(sets_, own_)
        if out is not None:
            yield out

    return both.repartition("cell").sortWithinPartitions("cell").mapInArrow(lean(run), LINKS)


def folded(docs: DataFrame, n: int, threshold: float, side: int = SIDE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of sets (LINKS, a row for each cell), the sets (set_key, copies, r: the representative), and the documents that may have a link: node, doc_id, set_key."""
    blocks = parallelism(docs.sparkSession)
    alive = written(survivors(shared_grams(incidence(docs, n, blocks), blocks), threshold), "survivors")
    member = alive.select("node", "doc_id", "set_key")
    reps = written(alive.groupBy("set_key").agg(F.min(F.struct("doc_id", "node", "batch", "place")).alias("r"), F.count_distinct("node").alias("copies")), "sets")
    cells = written(candidates(product(columns(alive, blocks, threshold, side), threshold), threshold, side), "cells")
    links, member = written(verify(cells, alive, reps, threshold), "links"), written(member.distinct(), "members")
    dropped(alive, cells)
    return links, reps, member


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of edges (a, b): root is the least node that can be reached.

    Least labels spread over the edges and are then followed to their own labels, until none changes; each round is written.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = held = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        spread = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near")).withColumnRenamed("a", "node")
        step = labels.join(spread, "node", "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        new = written(step.join(jump, "next", "left").select("node", "root", F.least("next", F.coalesce("far", "next")).alias("next")), "labels")
        changed = not new.where("next <> root").isEmpty()
        dropped(held)
        labels, held = new.select("node", F.col("next").alias("root")), new
        if not changed:
            dropped(both)
            return labels


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, side: int = SIDE) -> DataFrame:
    """(node, class_id, kept, n_links, max_jaccard) of every document that has a link; kept: it is the one of its class that stays."""
    links, reps, member = folded(docs, n, threshold, side)
    counted = links.groupBy("node").agg(F.sum("links").alias("links"), F.max("best").alias("best")).withColumnRenamed("node", "set_key")
    roots = components(links.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))).withColumnRenamed("node", "set_key")
    linked = reps.join(counted, "set_key", "left").join(roots, "set_key", "left").where("copies > 1 OR links IS NOT NULL")
    own = written(
        member.join(linked, "set_key").select(
            F.coalesce("root", "set_key").alias("root"), "doc_id", "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.when(F.col("copies") > 1, 1.0).otherwise(F.col("best")).alias("max_jaccard"),
        ),
        "linked",
    )
    dropped(links, reps, member)
    first = own.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("first"))
    return own.join(first, "root").select("node", F.col("first.doc_id").alias("class_id"), (F.col("first.node") == F.col("node")).alias("kept"), "n_links", "max_jaccard")


def ngram_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, side: int = SIDE) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, max_jaccard."""
    found = classes(docs, n, threshold, side)
    own = docs.where(docs["doc_id"].isNotNull()).select(docs["doc_id"].cast("long").alias("doc_id"), node_of(docs["doc_id"], docs["text"]).alias("node"))
    return own.join(found, "node", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "max_jaccard")


def without_near_copies(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, that of the smallest doc_id; rows with a null doc_id and rows without partner stay."""
    gone = written(classes(docs, n, threshold).where("NOT kept").select(F.col("node").alias("__gone")), "gone")
    if gone.count() <= MAX_BROADCAST:  # 8 bytes a row; beyond, the documents are shuffled
        gone = F.broadcast(gone)
    return docs.join(gone, node_of(docs["doc_id"], docs["text"]) == gone["__gone"], "left_anti")


SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\\x{{80}}-\\x{{10ffff}}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < {N} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {N - 2}), lambda i: array_to_string(w[i:i + {N - 1}], ' ')) END) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
p AS (SELECT doc_a, doc_b, c / (x.n + y.n - c)::DOUBLE AS jaccard
    FROM o JOIN n x ON x.doc_id = doc_a JOIN n y ON y.doc_id = doc_b WHERE c / (x.n + y.n - c)::DOUBLE >= {THRESHOLD}),
e AS (SELECT doc_a AS a, doc_b AS b, jaccard FROM p UNION ALL SELECT doc_b, doc_a, jaccard FROM p),
r(b, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.b WHERE r.root < e.b)
SELECT d.doc_id, coalesce(m.root, d.doc_id) AS class_id, coalesce(l.n, 0) AS n_links, l.j AS max_jaccard FROM documents d
LEFT JOIN (SELECT b, min(root) AS root FROM r GROUP BY b) m ON m.b = d.doc_id
LEFT JOIN (SELECT a, count(*) AS n, max(jaccard) AS j FROM e GROUP BY a) l ON l.a = d.doc_id WHERE d.doc_id IS NOT NULL
"""
