"""License scans: winnowed fingerprints, then banded sequence alignment.

Templates and documents are words of the lower-cased text.  Word n-grams of the
templates are in an inverted index, of ``CLASSES`` by the template's length:
with three quarters of its words matched, a template of up to 8 words has a run
of 2 of them, one of up to 39 a run of 3, and of these all n-grams of a document
are looked up, so no notice is missed; for longer ones the least hash of each
window is (winnowing), so that any run of 9 common words is hit.  Hits of one
template that lie on near diagonals make a candidate; if enough of the
template's words occur in its stretch at all, that is aligned word by word within
a band about the diagonals (local alignment: match 2, else -1).  A template with
``COVERAGE`` of its words matched is reported; of reports that overlap the one
with most matched words stays.

The map over documents is narrow; the templates, a constant of the library or a
parameter, are all that travels.

Defined cases: null or empty texts have no row; a document has a row for each
stretch (doc_id, license, template, coverage, matched, start, end: code points,
end exclusive); ties of overlapping reports go to the higher coverage, then the
first in order; repeated rows give repeated reports; a template of one word is
one gram; templates without words are left out; empty tables give no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrays as A
from .frames import texts
from .license_templates import TEMPLATES
from .lm_scoring import word_keys

CLASSES = ((8, 2, 1), (39, 3, 1), (1 << 31, 6, 4))  # words of a template at most, words of its n-grams, window
BAND = 8
COVERAGE = 0.75
SLICE = 1 << 21
FILTER = 20


def winnow(h: np.ndarray, bounds: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of each window within a row (the last of equals); a row with fewer hashes has its least."""
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    best = np.arange(n)
    for k in range(1, window):
        at = np.minimum(np.arange(n) + k, n - 1)
        best = np.where((row[at] == row) & (h[at] <= h[best]), at, best)
    whole = np.arange(n) + window <= bounds[row + 1]
    first = np.arange(n) == bounds[row]
    return np.unique(best[whole | first])


def align(template: list[int], words: list[int], low: int, high: int) -> tuple[int, int, int]:
    """(matched words, from, to) of the best local alignment of diagonals low..high (place in words less place in template)."""
    m, n = len(template), len(words)
    best = (0, 0, 0, 0)  # score, matched, from, to
    prev: dict[int, tuple[int, int, int]] = {}
    for i in range(m):
        t = template[i]
        row: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i + low), min(n - 1, i + high) + 1):
            s, c, start = prev.get(j - 1, (0, 0, j))
            if words[j] == t:
                cell = (s + 2, c + 1, start if s > 0 else j)
            else:
                cell = (s - 1, c, start)
            up, left = prev.get(j), row.get(j - 1)
            if up is not None and up[0] - 1 > cell[0]:
                cell = (up[0] - 1, up[1], up[2])
            if left is not None and left[0] - 1 > cell[0]:
                cell = (left[0] - 1, left[1], left[2])
            if cell[0] > 0:
                row[j] = cell
                if cell[0] > best[0]:
                    best = (*cell[:2], cell[2], j + 1)
        prev = row
    return best[1:]


class Scanner:
    def __init__(self, templates: dict[str, list[str]]):
        self.names: list[tuple[str, int]] = []
        self.words: list[list[int]] = []
        self.index: list[dict[int, list[tuple[int, int]]]] = [{} for _ in CLASSES]
        for name, own in templates.items():
            for k, text in enumerate(own):
                w = word_keys(text)
                if not len(w):
                    continue
                t = len(self.words)
                self.names.append((name, k))
                self.words.append(w.tolist())
                c = next(c for c, (most, _, _) in enumerate(CLASSES) if len(w) <= most)
                for q, g in enumerate(A.ngram_hashes(w, np.array([0, len(w)]), CLASSES[c][1])[0].tolist()):
                    self.index[c].setdefault(g, []).append((t, q))
        self.maybe = np.zeros((len(CLASSES), 1 << FILTER), bool)
        for c, index in enumerate(self.index):
            if index:
                self.maybe[c, np.array(list(index), A.U) >> A.U(64 - FILTER)] = True

    def hits(self, w: np.ndarray, bounds: np.ndarray) -> dict[int, dict[int, list[tuple[int, int]]]]:
        """By row and template the places (in the row's words, in the template) of common n-grams."""
        out: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for c, (_, k, window) in enumerate(CLASSES):
            if not self.index[c]:
                continue
            grams, at = A.ngram_hashes(w, bounds, k)
            places = np.flatnonzero(self.maybe[c, grams >> A.U(64 - FILTER)])
            rows = np.searchsorted(at, places, "right") - 1
            if window > 1:
                chosen = []
                for r in np.unique(rows).tolist():
                    chosen.append(at[r] + winnow(grams[at[r] : at[r + 1]], np.array([0, at[r + 1] - at[r]]), window))
                places = np.concatenate(chosen) if chosen else places[:0]
                places = places[self.maybe[c, grams[places] >> A.U(64 - FILTER)]]
                rows = np.searchsorted(at, places, "right") - 1
            for r, p, g in zip(rows.tolist(), (places - at[rows]).tolist(), grams[places].tolist()):
                for t, q in self.index[c].get(g, ()):
                    out.setdefault(r, {}).setdefault(t, []).append((p, q))
        return out

    def scan(self, buf: np.ndarray, offs: np.ndarray) -> list[tuple[int, str, int, float, int, int, int]]:
        """(row, license, template, coverage, matched, start, end) of a slice, start and end as bytes of the row."""
        starts, ends, bounds = A.words(buf, offs)
        w = A.word_hashes(buf, starts, ends)
        out = []
        for r, found in sorted(self.hits(w, bounds).items()):
            words = w[bounds[r] : bounds[r + 1]].tolist()
            reports = []
            for t, places in found.items():
                own = self.words[t]
                size = len(own)
                band = min(max(BAND, size // 40), max(1, size // 2))  # repeats of a short notice stay apart, a long text may drift
                groups: list[list[int]] = []  # of the diagonals p - q, those within the band of each other
                for d in sorted({p - q for p, q in places}):
                    if groups and d - groups[-1][1] <= band:
                        groups[-1][1] = d
                    else:
                        groups.append([d, d])
                for low, high in groups:
                    a, b = max(0, low - band), min(len(words), high + size + band)
                    there = set(words[a:b])
                    if sum(x in there for x in own) < COVERAGE * size:
                        continue
                    matched, s, e = align(own, words[a:b], low - band - a, high + band - a)
                    if matched >= COVERAGE * size:
                        reports.append((-matched, -matched / size, self.names[t], a + s, a + e))
            taken: list[tuple[int, int]] = []
            for matched, coverage, (name, k), s, e in sorted(set(reports)):
                if all(e <= x or s >= y for x, y in taken):
                    taken.append((s, e))
                    first, last = int(starts[bounds[r] + s] - offs[r]), int(ends[bounds[r] + e - 1] - offs[r])
                    out.append((r, name, k, -coverage, -matched, first, last))
        return out


SCHEMA = "doc_id long, license string, template int, coverage double, matched int, start int, end int"
_TYPES = (pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
_NAMES = ["doc_id", "license", "template", "coverage", "matched", "start", "end"]


def license_scan(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per stretch of a document that matches a licence."""
    shared = docs.sparkSession.sparkContext.broadcast(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        for batch, buf, offs in A.slices(batches, "text", SLICE):
            found = []
            for r, name, k, coverage, matched, s, e in scanner.scan(buf, offs):
                raw = buf[offs[r] : offs[r] + e].tobytes()
                found.append((batch.column(0)[r].as_py(), name, k, coverage, matched, len(raw[:s].decode()), len(raw.decode())))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _TYPES)], _NAMES)

    return texts(docs).mapInArrow(run, SCHEMA)
