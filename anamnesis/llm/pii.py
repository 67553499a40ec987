"""PII by bootstrapped contextual extraction.

Candidates are the white-space tokens that hold a digit, ``@`` or a key's prefix,
or follow a cue (a word and ``=``, ``:`` or ``#``), neighbours joined where a
seed spans them, over whole texts.  Seed entities, found
by strict expressions, induce lexical patterns: the *shape* of the identifier
(class and length of its runs of letters and digits) and its *cue* (the word
and sign before it, such as ``password=``).  Patterns and distinct instances
form a bipartite graph, which Spark scores iteratively, by kind: a pattern's
confidence is the share of its distinct instances' scores, smoothed; an
instance's score is that of its best pattern.  Patterns of high confidence and
support then mark identifiers that no seed expression knows.

Both passes over the documents are narrow; only distinct (pattern, instance)
rows are shuffled.  Candidates are decided by a join with the accepted patterns,
which are broadcast if there are ``MAX_BROADCAST`` at most and shuffled beyond;
``redact`` likewise masks in its second pass, or by a join of spans with
documents on a key of the row (doc_id and text).  Either way gives the same rows.

Defined cases: null or empty texts hold nothing; a row per occurrence (doc_id,
start, end in code points, kind, value, pattern: 'seed', 'shape' or 'cue');
repeated rows give repeated occurrences, rows of one doc_id keep their own; ties
between kinds go to the first in the alphabet; cues and identifiers of any
length are read whole; empty tables give no rows; other columns are carried by
``redact``, never read, and their names cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import arrays as A
from .frames import dropped, texts, written

ROUNDS = 3
CONFIDENCE = 0.9
SUPPORT = 5
SMOOTHING = 0.5
MAX_BROADCAST = 100_000
SLICE = 1 << 21

SEEDS = {
    "email": r"(?<![\w.+-])[\w.+-]{0,63}\w@(?:[a-z0-9-]{1,63}\.){1,8}[a-z]{2,24}",
    "phone": r"\+\d{1,3} ?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3}[ .-]?\d{4}(?!\d)",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "card": r"(?<!\w)\d{4}(?:[ -]?\d{4}){3}(?!\w)",
    "key": r"(?<!\w)(?:(?:AKIA|ASIA)[0-9A-Z]{12,}|(?:ghp|gho|sk|pk|xox[bp])[_-]\w{16,})",
    "secret": r"(?<!\w)(?:password|passwd|pwd|secret|token|api[_-]?key)\s?[=:]\s?[\"']?[\w+/.-]{8,}=*[\"']?",
}
_SEED = re.compile("|".join(f"(?P<{k}>{v})" for k, v in SEEDS.items()), re.I)
_MARK = re.compile(r"[\d@]|(?i:A[KS]IA|(?<!\w)(?:gh[po]|sk|pk|xox[bp])[_-])|(?P<cue>[^\W\d_]\s?[=:#]\s?[\"']?)(?=[^\s\"'])")
_ALNUM = re.compile(r"[^\W_]+")
_CORE = re.compile(r"[^\W_](?:.*[^\W_])?", re.S)


def shape(value: str) -> str:
    """Runs of letters (a), digits (d) or both (x) with their length, other signs as they are."""

    def run(m: re.Match) -> str:
        t = m.group()
        return f"{'d' if t.isdigit() else 'a' if not any(c.isdigit() for c in t) else 'x'}{len(t)}"

    full = _ALNUM.sub(run, value)
    return full if len(full) <= 64 else f"{full[:47]}~{hashlib.blake2b(full.encode(), digest_size=8).hexdigest()}"


def scan(text: str) -> list[tuple[int, int, str, str | None, str | None, str]]:
    """(start, end, value, kind of the seed, cue, shape) of all candidates of a text, in order."""
    out = []
    tokens = []  # spans of the tokens with a mark
    end = 0
    for m in _MARK.finditer(text):
        at = m.end() if m.lastgroup else m.start()  # after a cue, its value
        if at >= end:
            start, end = _back(text, at), _forth(text, at)
            tokens.append((start, end))
    seeds = []
    window: list[int] = []
    for start, end in [*tokens, (len(text) + 2, len(text) + 2)]:
        left = start
        for _ in range(2 if start < len(text) else 0):  # the words of a cue
            left = _back(text, max(0, left - 1))
        if window and left > window[1] + 1:
            seeds += [(m.start(), m.end(), m.group(), m.lastgroup) for m in _SEED.finditer(text, *window)]
            window = []
        window = [window[0] if window else left, end]
    for s, e, value, kind in seeds:
        cut = re.search(r"[=:]\s?[\"']?", value) if kind == "secret" else None
        begin, stop = (s + cut.end(), e - (value[-1] in "\"'")) if cut else (s, e)
        body = text[begin:stop]
        out.append((begin, stop, body, kind, _cue(text, begin), shape(body)))
    taken = [(s, e) for s, e, *_ in seeds]
    k = 0
    for s, e in tokens:
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if k < len(taken) and taken[k][0] < e:
            continue
        m = _CORE.search(text, s, e)
        if m:
            value = m.group()
            cut = re.search(r"[=:#][\"']?", value)  # a cue within the token
            begin = m.start() + cut.end() if cut and cut.end() < len(value) else m.start()
            value = text[begin : m.end()]
            cue = _cue(text, begin)
            if cue or _MARK.search(value):
                out.append((begin, m.end(), value, None, cue, shape(value)))
    return sorted(out)


_SPACE = re.compile(r"\s")


def _back(text: str, i: int) -> int:
    """Start of the token that holds place i, or ends there."""
    while i > 0 and not text[i - 1].isspace():
        i -= 1
    return i


def _forth(text: str, i: int) -> int:
    m = _SPACE.search(text, i)
    return m.start() if m else len(text)


def _cue(text: str, begin: int) -> str | None:
    """The letters and the sign before a place, between which and about which a space may stand, and a quote after."""
    i = begin
    if i and text[i - 1] in "\"'":
        i -= 1
    if i and text[i - 1].isspace():
        i -= 1
    if not i or text[i - 1] not in "=:#":
        return None
    sign = text[i - 1]
    end = i - 1
    if end and text[end - 1].isspace():
        end -= 1
    i = end
    while i and text[i - 1].isalpha():
        i -= 1
    return (text[i:end] + sign).lower() if i < end else None


FOUND = "doc_id long, start int, end int, value string, seed string, cue string, shape string"


def _marked(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows that may hold a mark; the others hold no candidate."""
    mark = ((buf >= 48) & (buf <= 57)) | np.isin(buf, np.frombuffer(b"@=:#", np.uint8))
    i = np.flatnonzero((buf[2:] == 95) | (buf[2:] == 45)) + 2  # the signs after a key's prefix
    pair = (buf[i - 2] | 32).astype(np.int32) << 8 | buf[i - 1] | 32
    mark[i[np.isin(pair, [a << 8 | b for a, b in (b"hp", b"ho", b"sk", b"pk", b"xb", b"xp")])]] = True
    i = np.flatnonzero((buf[2:] | 32) == 97) + 2  # ..ia, of AKIA and ASIA
    mark[i[(buf[i - 1] | 32 == 105) & np.isin(buf[i - 2] | 32, [107, 115])]] = True
    mark |= buf >= 0xD9  # digits of other scripts
    hit = np.flatnonzero(mark)
    return np.unique(np.searchsorted(offs, hit, "right") - 1)


def occurrences(docs: DataFrame) -> DataFrame:
    """All candidates of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offs in A.slices(batches, "text", SLICE):
            rows = []
            for r in _marked(buf, offs):
                ident, text = batch.column(0)[int(r)].as_py(), batch.column(1)[int(r)].as_py()
                rows += [(ident, *x) for x in scan(text)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), *[pa.string()] * 4))], ["doc_id", "start", "end", "value", "seed", "cue", "shape"])

    return texts(docs, lower=False).mapInArrow(run, FOUND)


def learn(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, confidence, support) of the accepted patterns; pattern is 'shape:...' or 'cue:...'."""
    kinds = sorted(SEEDS)
    shapes = found.select(F.concat(F.lit("shape:"), "shape").alias("pattern"), "value", "seed")
    cues = found.where("cue IS NOT NULL").select(F.concat(F.lit("cue:"), "cue").alias("pattern"), "value", "seed")
    edges = shapes.union(cues).groupBy("pattern", "value").agg(*(F.max((F.coalesce(F.col("seed"), F.lit("")) == k).cast("double")).alias(k) for k in kinds))
    edges = written(edges, "pii-graph")
    seeds = edges.groupBy("value").agg(*(F.max(k).alias(k) for k in kinds))
    scores = seeds
    patterns = before = None
    for _ in range(rounds):
        scored = edges.select("pattern", "value").join(scores, "value")
        patterns = written(scored.groupBy("pattern").agg(F.count("*").alias("support"), *((F.sum(k) / (F.count("*") + SMOOTHING)).alias(k) for k in kinds)), "pii-patterns")
        if before is not None:
            dropped(before)
        before = patterns
        best = edges.select("pattern", "value").join(patterns, "pattern").groupBy("value").agg(*(F.max(F.when(F.col("support") >= SUPPORT, F.col(k)).otherwise(0.0)).alias(f"p_{k}") for k in kinds))
        scores = seeds.join(best, "value").select("value", *(F.greatest(k, f"p_{k}").alias(k) for k in kinds))
    top = F.array_max(F.array(*(F.struct(F.col(k).alias("confidence"), F.lit(-i).alias("order"), F.lit(k).alias("kind")) for i, k in enumerate(kinds))))
    accepted = written(patterns.select("pattern", "support", top.alias("t")).where((F.col("t.confidence") >= CONFIDENCE) & (F.col("support") >= SUPPORT)).select("pattern", "t.kind", "t.confidence", "support"), "pii-accepted")
    dropped(edges, patterns)
    return accepted


def decided(found: DataFrame, patterns: DataFrame, limit: int = MAX_BROADCAST) -> DataFrame:
    """The occurrences that are seeds or match an accepted pattern."""
    by_shape = patterns.where("pattern LIKE 'shape:%'").select(F.expr("substring(pattern, 7)").alias("shape"), F.col("kind").alias("by_shape"))
    by_cue = patterns.where("pattern LIKE 'cue:%'").select(F.expr("substring(pattern, 5)").alias("known"), F.col("kind").alias("by_cue"))
    if patterns.count() <= limit:
        by_shape, by_cue = F.broadcast(by_shape), F.broadcast(by_cue)
    cue = F.coalesce("cue", F.concat(F.lit(" "), "value"))  # no cue has a space: rows without one are spread, not gathered at null
    both = found.withColumn("at", cue).join(by_shape, "shape", "left").join(by_cue, F.col("at") == F.col("known"), "left")
    kind = F.coalesce("seed", "by_shape", "by_cue")
    why = F.when(F.col("seed").isNotNull(), "seed").when(F.col("by_shape").isNotNull(), "shape").otherwise("cue")
    return both.where(kind.isNotNull()).select("doc_id", "start", "end", kind.alias("kind"), "value", why.alias("pattern"))


def pii(docs: DataFrame) -> DataFrame:
    """One row per identifier found."""
    found = written(occurrences(docs), "pii-candidates")
    return decided(found, learn(found))


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for s, e, kind in sorted(spans):
        if s >= at:
            parts += [text[at:s], f"<{kind.upper()}>"]
            at = e
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, limit: int = MAX_BROADCAST) -> DataFrame:
    """The documents with every identifier replaced by <KIND>; n_chars, if there, is the new length."""
    found = written(occurrences(docs), "pii-candidates")
    patterns = learn(found)
    if patterns.count() <= limit:
        dropped(found)
        accepted = docs.sparkSession.sparkContext.broadcast({r.pattern: r.kind for r in patterns.collect()})  # limit rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = accepted.value
            for batch in batches:
                k = batch.schema.get_field_index("text")
                values = batch.column(k).to_pylist()
                buf, offs = A.string_buffer(batch.column(k))
                for r in _marked(buf, offs):
                    spans = []
                    for s, e, _, seed, cue, form in scan(values[r]):
                        kind = seed or known.get(f"shape:{form}") or (known.get(f"cue:{cue}") if cue else None)
                        if kind:
                            spans.append((s, e, kind))
                    values[r] = masked(values[r], spans)
                columns = list(batch.columns)
                columns[k] = pa.array(values, batch.schema.field(k).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

        out = docs.mapInArrow(run, docs.schema)
    else:
        # a key per row, since rows may share a doc_id; equal rows have equal spans
        whole = docs.select(F.xxhash64(docs["doc_id"], docs["text"]).alias("key"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
        rows = occurrences(whole.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")))
        spans = decided(rows, patterns, limit).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end", "kind"))).alias("spans")).withColumnRenamed("doc_id", "id")

        @F.pandas_udf("string")
        def cover(text, where):  # type: ignore[no-untyped-def]
            return text.combine(where, lambda t, w: t if t is None or w is None else masked(t, [(x["start"], x["end"], x["kind"]) for x in w]))

        masked_rows = whole.join(spans, F.col("key") == F.col("id"), "left").select("row", cover(F.col("row.text"), F.col("spans")).alias("covered"))
        out = masked_rows.select(*((F.col("covered") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
