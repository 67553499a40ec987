"""Quality classifier: supervised subword embeddings.

Tokens (white-space runs, case kept, so that shouting and symbol junk show),
pairs of neighbouring tokens and the tokens' character 3- to 5-grams are hashed into buckets; a document is the
mean of its features' vectors, and two softmax heads give the probability of
good quality and of toxicity.  Trained by numpy stochastic gradient descent on
the driver over a bounded labelled sample; scored by one narrow map.  As the
mean and the heads are linear, each bucket is folded to its logits once, so
that scoring a document is a sum over its features.

``TRAIN_DOCS`` labelled documents at most (smallest xxhash64(doc_id) first) are
fitted: the documented bound.  All documents are scored, over their whole texts.

Defined cases: a null, empty or blank text has no features and gets the
probabilities of the bias alone; a null doc_id is scored and reported as null; a
probability of exactly 0.5 is class 1; labels that are null, or of a null
doc_id, train nothing, repeated labels of a document are averaged, and of rows
that repeat a labelled doc_id the least text is fitted; without labels every
probability is 0.5; equal rows get a row each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import arrays as A
from .frames import texts

TRAIN_DOCS = 3000
BUCKETS = 1 << 18
DIM = 16
EPOCHS = 8
RATE = 1.0
HEAD_RATE = 0.1
NGRAMS = (3, 4, 5)


def features(buf: np.ndarray, offs: np.ndarray, buckets: int = BUCKETS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Feature buckets and the rows' bounds among them: for the tokens, their pairs, then the n-grams within ' token ' of each length."""
    cp, co = A.codepoints(buf, offs)
    space = (cp == 32) | (cp - np.uint32(9) <= 4)
    starts, ends, bounds = A.runs(~space, co)
    h = A.prefix_hash(np.where(space, np.uint32(32), cp))
    rows = np.repeat(np.arange(len(offs) - 1), np.diff(bounds))
    token = A.span_hash(h, starts, ends)
    pair = np.flatnonzero(rows[1:] == rows[:-1])
    both = A.mix(token[pair] * A.U(A.BASE) ^ token[np.minimum(pair + 1, len(token) - 1)] if len(pair) else token[:0])
    out = [((token % A.U(buckets)).astype(np.int64), bounds), ((both % A.U(buckets)).astype(np.int64), np.searchsorted(pair, bounds))]
    lo = np.where(starts > co[rows], starts - 1, starts)  # with the space on either side, where the row has one
    hi = np.where(ends < co[rows + 1], ends + 1, ends)
    for n in NGRAMS:
        count = np.maximum(hi - lo - n + 1, 0)
        at = A.ragged(lo, count)
        found = A.span_hash(h, at, at + n) + A.U(n)
        out.append(((found % A.U(buckets)).astype(np.int64), np.concatenate(([0], np.cumsum(count)))[bounds]))
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Model:
    """vectors (buckets x dim), heads (dim x 2 tasks x 2 classes) and bias; table holds each bucket's logit difference."""

    def __init__(self, buckets: int = BUCKETS, dim: int = DIM, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
        self.heads = rng.normal(0, 1, (2, dim, 2)).astype(np.float32)
        self.bias = np.zeros((2, 2), np.float32)

    def fit(self, docs: list[str], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 11) -> Model:
        """labels: per document the share of class 1 in (quality, toxic), NaN where it has none."""
        if not docs:
            return self
        col = pa.array(docs, pa.string())
        bags = []
        for k in range(len(docs)):
            parts = features(*A.string_buffer(col[k : k + 1]), len(self.vectors))
            idx, n = np.unique(np.concatenate([f for f, _ in parts]), return_counts=True)
            bags.append((idx.astype(np.int32), n.astype(np.float32)))
        rng = np.random.default_rng(seed)
        step, total = 0, epochs * len(docs)
        for _ in range(epochs):
            for k in rng.permutation(len(docs)):
                idx, n = bags[k]
                lr = rate * (1 - step / total)
                step += 1
                if not len(idx):
                    continue
                w = (n / n.sum()).astype(np.float32)
                x = w @ self.vectors[idx]
                back = np.zeros_like(x)
                for t in range(2):
                    y = labels[k, t]
                    if np.isnan(y):
                        continue
                    err = softmax(x @ self.heads[t] + self.bias[t]) - np.array([1 - y, y], np.float32)
                    back += self.heads[t] @ err
                    self.heads[t] -= HEAD_RATE * lr * np.outer(x, err)
                    self.bias[t] -= HEAD_RATE * lr * err
                self.vectors[idx] -= (lr / w.max() * w)[:, None] * back  # as for words: the most frequent feature takes the whole step
        return self

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        w = np.stack([h[:, 1] - h[:, 0] for h in self.heads], 1)
        return (self.vectors @ w).astype(np.float32), (self.bias[:, 1] - self.bias[:, 0]).astype(np.float64)


def score(table: np.ndarray, bias: np.ndarray, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Probabilities of (quality, toxic) for each row."""
    parts = features(buf, offs, len(table))
    n = np.maximum(sum(np.diff(b) for _, b in parts), 1)
    z = np.stack([sum(A.sum_by_row(table[:, t][f].astype(np.float64), b) for f, b in parts) / n + bias[t] for t in range(2)], 1)
    return 1 / (1 + np.exp(-z))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """The bounded labelled sample."""
    chosen = (
        labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)")
        .groupBy("doc_id")
        .agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    own = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = own.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"), F.first("toxic").alias("toxic")).collect()  # limit rows at most
    rows = sorted(rows, key=lambda r: (r.doc_id, r.text))
    nan = float("nan")
    return [r.text for r in rows], np.array([[nan if v is None else v for v in (r.quality, r.toxic)] for r in rows], np.float32).reshape(-1, 2)


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> Model:
    return Model().fit(*training_rows(docs, labels, limit))


SCHEMA = "doc_id long, quality_prob double, toxic_prob double, quality int, toxic int"


def quality_classifier(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, quality_prob, toxic_prob, and the classes at 0.5."""
    model = model or train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model.table())  # 2 MB, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = shared.value
        for batch, buf, offs in A.slices(batches, "text", 1 << 19):
            p = score(table, bias, buf, offs)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array((p[:, 0] >= 0.5).astype(np.int32)), pa.array((p[:, 1] >= 0.5).astype(np.int32))],
                ["doc_id", "quality_prob", "toxic_prob", "quality", "toxic"],
            )

    return texts(docs, lower=False).mapInArrow(run, SCHEMA)
