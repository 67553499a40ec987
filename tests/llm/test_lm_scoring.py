import math
import random
from collections import Counter

import numpy as np
import pytest

from anamnesis.llm import lm_scoring as L
from anamnesis.llm.queries import queries

from ..compare import SF


def brute(corpus, scored=None):
    """(log probability, sum of the longest contexts' lengths) of each scored text."""
    own = scored is None
    texts, asked = [d.split() for d in corpus], [d.split() for d in (corpus if own else scored)]
    n = Counter(tuple(w[i:j]) for w in texts for i in range(len(w)) for j in range(i + 1, len(w) + 1))
    total = sum(map(len, texts))
    out = []
    for w in asked:
        ll = ctx = 0
        for i in range(len(w)):
            p0 = (n[w[i],] - own + L.MASS / max(total, 1)) / (total - own + L.MASS) if total else 1.0
            k = max((k for k in range(1, i + 1) if n[tuple(w[i - k : i])] - own > 0), default=0)
            p = (n[tuple(w[i - k : i + 1])] - own + L.MASS * p0) / (n[tuple(w[i - k : i])] - own + L.MASS) if k else p0
            ll += math.log(p)
            ctx += k
        out.append((ll, ctx))
    return out


def check(got, texts, want):
    for i, (ll, ctx) in enumerate(want):
        n = len(texts[i].split())
        assert got[i].n_words == n and abs(got[i].logprob - ll) < 1e-8, i
        assert (got[i].perplexity is None) == (n == 0) == (got[i].mean_context is None)
        assert n == 0 or abs(got[i].mean_context - ctx / n) < 1e-9


def sample():
    rnd = random.Random(4)
    docs = [" ".join(rnd.choice("abcde") for _ in range(rnd.randint(0, 30))) for _ in range(60)]
    long = [rnd.choice(["p", "q", "r", "s1"]) for _ in range(150)]
    near = [" ".join(x if rnd.random() > 0.03 else "zz" for x in long) for _ in range(6)]
    return docs + near + [" ".join(long), " ".join(long), " ".join(long[:70] + ["x"] + long[71:]), " ".join(long[20:90]), "", "alone", " ".join(["a"] * 40), " ".join(["a"] * 40)]


@pytest.mark.parametrize("hot,depth", [(1 << 19, 8), (20, 8), (20, 2), (3, 3)])
def test_every_document_is_scored_as_by_brute_force(spark, monkeypatch, hot, depth):
    monkeypatch.setattr(L, "FILE", 300)
    monkeypatch.setattr(L, "SLICE", 500)
    docs = sample()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in L.lm_scores(df, shard=97, hot=hot, depth=depth).collect()}
    assert len(got) == len(docs)
    check(got, docs, brute(docs))


def test_other_texts_are_scored_as_by_brute_force(spark):
    docs = sample()
    rnd = random.Random(8)
    asked = [" ".join(rnd.choice([*"abcde", "unheard"]) for _ in range(rnd.randint(0, 12))) for _ in range(20)] + [docs[3], docs[66], docs[66]]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: r for r in L.lm_scores(df, spark.createDataFrame(list(enumerate(asked)), "item_id long, text string"), shard=97, hot=20, key="item_id").collect()}
    assert len(got) == len(asked)
    check(got, asked, brute(docs, asked))


def test_defined_cases(spark):
    odd = spark.createDataFrame([(None, "a b", 1), (1, None, 1), (1, "a b", 1), (2, "!", 1), (3, "A  b.", 1)], "doc_id long, text string, role int")
    assert sorted((r.doc_id or 0, r.n_words) for r in L.lm_scores(odd).collect()) == [(0, 2), (1, 0), (1, 2), (2, 0), (3, 2)]
    assert L.lm_scores(odd.limit(0)).count() == 0 and L.lm_scores(odd, odd.limit(0)).count() == 0
    empty = L.lm_scores(odd.limit(0), odd).collect()
    assert len(empty) == 5 and all(r.logprob == 0 for r in empty)


def test_long_texts_take_few_steps(spark):
    rnd = np.random.default_rng(3)
    long = " ".join(f"w{k}" for k in rnd.integers(0, 500, 30_000))
    got = {r.doc_id: r for r in L.lm_scores(spark.createDataFrame([(1, long), (2, long + " end"), (3, "w1 w2")], "doc_id long, text string")).collect()}
    assert abs(got[1].mean_context - (30_000 - 1) / 2) < 1 and got[1].n_words == 30_000


def test_numbers_survive_packing():
    for x in ([], [0], [255, 256], [1, 2**40]):
        assert L.from_planes(L.planes(np.array(x, np.int64))).tolist() == x


def test_query_scores_every_document(spark):
    assert queries()["op7_lm_scoring"](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
