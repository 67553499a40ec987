"""Vectorised text kernels shared by the operators of this subpackage.

Texts arrive as Arrow string columns.  The kernels work on the bytes (or code
points) of many documents at once, so that no Python statement runs per
character or per word.  A *word* is a maximal run of ASCII letters, digits and
non-ASCII bytes, ``[a-z0-9\\x80-\\U0010ffff]+`` on lower-cased text.

Null texts count as empty.  Every kernel accepts empty input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
_INV = pow(BASE, -1, 1 << 64)

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[ord("a") : ord("z") + 1] = WORD_BYTE[ord("A") : ord("Z") + 1] = WORD_BYTE[ord("0") : ord("9") + 1] = True
WORD_BYTE[128:] = True
SPACE_BYTE = np.zeros(256, bool)
SPACE_BYTE[[9, 10, 11, 12, 13, 32]] = True

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((BASE, _INV)):
            a = np.full(size, base, U)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0][:n], _powers[1][:n]


def string_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column, without a copy where Arrow allows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offs = np.frombuffer(off, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20, rows: int = 1 << 31) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows in groups of about limit bytes of text (one row at least) and so many rows at most, which bounds the memory of the kernels."""
    for batch in batches:
        if not batch.num_rows:
            continue
        buf, offs = string_buffer(batch.column(batch.schema.get_field_index(column)))
        i, n = 0, batch.num_rows
        while i < n:
            j = min(n, i + rows, max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1))
            yield batch.slice(i, j - i), buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of mask that stay within a row; bounds[r]:bounds[r + 1] are the runs of row r."""
    n = len(mask)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(mask[:-1], out=first[1:])
    cut = offs[:-1][offs[:-1] < n]
    first[cut] = True
    first &= mask
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(mask[1:], out=last[:-1])
    last[cut[cut > 0] - 1] = True
    last &= mask
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return runs(WORD_BYTE[buf], offs)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits; a bijection."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """H with H[i] the polynomial hash of symbols[:i]."""
    h = np.zeros(len(symbols) + 1, U)
    if len(symbols):
        t = symbols.astype(U)
        t += U(1)
        t *= powers(len(symbols))[0]
        np.cumsum(t, out=h[1:])
    return h


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, independent of where they lie."""
    return mix((h[ends] - h[starts]) * powers(len(h))[1][starts])


def _windows(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of buf (zeros beyond its end) as a number."""
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    return np.ndarray((len(buf) + 1,), "<u8", padded.data, strides=(1,))


def _part(window: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Up to eight of the left bytes from each place, those beyond as zeros."""
    x = window[at]
    short = np.flatnonzero(left < 8)
    x[short] &= (U(1) << (U(8) * left[short].astype(U))) - U(1)
    return x


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans by their content; eight bytes are mixed in at a time, so no algebra makes two words collide."""
    size = ends - starts
    h = size.astype(U) * U(BASE)
    window = _windows(buf)
    live, k = np.flatnonzero(size > 0), 0
    while len(live):
        x = _part(window, starts[live] + k, size[live] - k)
        x ^= h[live]
        x *= U(BASE)
        h[live] = mix(x)
        k += 8
        live = live[size[live] > k]
    return h


def differ(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indexes of the pairs of spans of equal size, from a and from b, whose bytes differ."""
    window = _windows(buf)
    live, k, out = np.flatnonzero((size > 0) & (a != b)), 0, []
    while len(live):
        left = size[live] - k
        bad = _part(window, a[live] + k, left) != _part(window, b[live] + k, left)
        out.append(live[bad])
        k += 8
        live = live[~bad]
        live = live[size[live] > k]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def distinct_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group of each span, a span of each group, hash of each group): spans of equal bytes make a group; equal hashes are compared byte by byte."""
    h = word_hashes(buf, starts, ends)
    code, own = pd.factorize(h)
    at = np.empty(len(own), np.int64)
    at[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    size = ends - starts
    wrong = np.union1d(np.flatnonzero(size != size[at[code]]), differ(buf, starts, starts[at[code]], np.minimum(size, size[at[code]])))
    if len(wrong):  # by their bytes
        groups: dict[bytes, int] = {}
        extra = []
        for i in wrong.tolist():
            g = groups.setdefault(buf[starts[i] : ends[i]].tobytes(), len(own) + len(groups))
            if g == len(own) + len(extra):
                extra.append(i)
            code[i] = g
        at = np.concatenate((at, np.array(extra, np.int64)))
        own = np.concatenate((own, h[extra]))
    return code, at, own


def ngram_hashes(w: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n consecutive words from each place of each row, and the row's bounds among them.

    A row of 1 to n - 1 words has one gram of all of them; an empty row has none.
    """
    length = np.diff(bounds)
    count = np.where(length >= n, length - n + 1, np.minimum(length, 1))
    out = np.concatenate(([0], np.cumsum(count)))
    if not out[-1]:
        return np.zeros(0, U), out
    row = np.repeat(np.arange(len(length)), count)
    at = bounds[row] + (np.arange(out[-1]) - out[row])
    h = np.zeros(len(at), U)
    for k in range(n):
        there = at + k < bounds[row + 1]
        h = np.where(there, (h ^ w[np.minimum(at + k, len(w) - 1)]) * U(BASE) + U(k + 1), h)
    return mix(h), out


def sum_by_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[r]:bounds[r + 1]] for each row, 0 for an empty one."""
    c = np.concatenate((np.zeros((1, *values.shape[1:]), values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values, axis=0)))
    return c[bounds[1:]] - c[bounds[:-1]]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1, ... (counts[i] of them), one row after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - begin, counts)


def codepoints(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the UTF-8 bytes, and the rows' offsets among them."""
    cp = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(cp) == len(buf):
        return cp, offs
    lead = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    return cp, lead[offs]


def list_array(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
