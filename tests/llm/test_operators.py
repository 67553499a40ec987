"""Every operator on awkward rows (nulls, empty and very long texts, repeats, clashing columns, empty tables) and against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from anamnesis.llm import arrays as A, bpe, decontamination, language_id, license_scan, lm_scoring, ngram_join, pii, quality_classifier, quality_rules, token_counts
from anamnesis.llm.queries import oracle_sql, queries

from ..compare import SF, same

WORD = re.compile("[a-z0-9\x80-\U0010ffff]+")
SCHEMA = "doc_id long, text string, lang string, word string, n long, grams string, block int, shape string, seed string, item_id long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en" if i else None, "x", 1, "g", 0, "s", "q", 3) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark):
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "one two three"), (6, "one two three"), (6, "one two three"), (None, "one two three"), (7, long), (8, long + " end"), (9, "é中 😀 ‰"), (10, "x" * 50_000), (11, "!!! ???")]
    return docs_of(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "one two three", 3), (4, " ".join(f"word{k}" for k in range(100, 130)), 4)], "item_id long, text string, doc_id long")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (5, 1, 0), (7, 0, None), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    same(queries()[name], oracle_sql()[name], spark)


@pytest.mark.parametrize("name", [n for n in queries() if n not in oracle_sql()])
def test_query_runs_over_the_whole_table(spark, name):
    n = queries()[name](spark, SF).count()
    assert n > 0
    if name in ("op1_quality_classifier", "op4_bpe", "op9_token_counts", "op10_language_id"):
        assert n == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_awkward_rows(spark, awkward, empty, items, labels):
    n = awkward.count()
    for f in (lambda d: quality_classifier.quality_classifier(d, labels), bpe.bpe, quality_rules.quality_rules, token_counts.token_counts, language_id.language_id):
        assert f(awkward).count() == n
        assert f(empty).count() == 0
    classes = [(r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_join(awkward).collect()]
    assert sorted(classes) == [(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 1), (6, 5, 1), (6, 5, 1), (7, 7, 1), (8, 7, 1), (9, 9, 0), (10, 10, 0), (11, 11, 0)]
    assert ngram_join.ngram_join(empty).count() == 0 and ngram_join.without_near_copies(empty).count() == 0
    kept = [r.doc_id for r in ngram_join.without_near_copies(awkward).collect()]
    assert sorted(x for x in kept if x) == [1, 2, 3, 4, 5, 7, 9, 10, 11] and None in kept
    assert {(r.doc_id, r.item_id, r.distance) for r in decontamination.decontaminate(awkward, items).collect()} == {(7, 4, 0), (8, 4, 0)}
    assert decontamination.decontaminate(empty, items).count() == 0 and decontamination.decontaminate(awkward, items.limit(0)).count() == 0
    for f in (pii.pii, license_scan.license_scan):
        assert f(empty).count() == 0
        f(awkward).count()
    assert pii.redact(awkward).columns == awkward.columns and pii.redact(awkward).count() == n
    assert lm_scoring.lm_scores(awkward).count() == n and lm_scoring.lm_scores(empty).count() == 0
    assert lm_scoring.lm_scores(awkward, items, key="item_id").count() == items.count()
    assert all(r.round_trip for r in bpe.bpe(awkward).collect())
    assert quality_rules.clean(awkward).columns == awkward.columns


def brute_jaccard(rows, n, t):
    sets = {}
    for i, text in rows:
        w = WORD.findall((text or "").lower())
        g = {tuple(w[k : k + n]) for k in range(max(len(w) - n + 1, 1))} if w else set()
        sets[i] = g
    ids = sorted(i for i in sets if sets[i])
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}


def test_ngram_join_brute_force(spark):
    rnd = random.Random(5)
    base = [[rnd.choice("abcdefghij") * rnd.randint(1, 3) for _ in range(rnd.randint(3, 50))] for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = rnd.choice("xyz")
        rows.append((i, " ".join(w)))
    want = brute_jaccard(rows, ngram_join.N, ngram_join.THRESHOLD)
    root = {i: i for i, _ in rows}
    for _ in range(20):
        for a, b in want:
            root[a] = root[b] = min(root[a], root[b])
    for side in (ngram_join.SIDE, 3):  # one cell, and neighbourhoods cut into many
        got = {r.doc_id: r for r in ngram_join.ngram_join(docs_of(spark, rows), side=side).collect()}
        assert len(got) == len(rows)
        for i, _ in rows:
            own = [v for p, v in want.items() if i in p]
            assert (got[i].class_id, got[i].n_links) == (root[i], len(own))
            assert (got[i].max_jaccard is None) == (not own) and (not own or abs(got[i].max_jaccard - max(own)) < 1e-12)
    kept = {r.doc_id for r in ngram_join.without_near_copies(docs_of(spark, rows)).collect()}
    assert kept == {i for i in root if root[i] == i}


def test_rows_of_one_doc_id_are_told_apart(spark):
    text = [" ".join(f"{c}{k}" for k in range(40)) for c in "abc"]
    rows = [(1, text[0]), (1, text[1]), (2, text[1]), (3, text[2]), (None, text[2]), (3, text[2])]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in ngram_join.ngram_join(docs_of(spark, rows)).collect())
    assert got == [(1, 1, 0), (1, 1, 1), (2, 1, 1), (3, 3, 0), (3, 3, 0)]
    kept = sorted((r.doc_id or 0, r.text[0]) for r in ngram_join.without_near_copies(docs_of(spark, rows)).collect())
    assert kept == [(0, "c"), (1, "a"), (1, "b"), (3, "c"), (3, "c")]


def test_ngram_hashes_do_not_depend_on_the_number_of_partitions(spark):
    rows = docs_of(spark, [(i, " ".join(f"w{(i // 3 * 7 + k) % 90}" for k in range(30))) for i in range(40)])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        out = []
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out.append(sorted(map(tuple, ngram_join.ngram_join(rows).collect()), key=repr))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1]


def test_overlap_in_tiles(monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 7)
    rng = np.random.default_rng(1)
    grams = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(30)]
    x, y = np.array([(a, b) for a in range(30) for b in range(a + 1, 30)]).T
    assert ngram_join.overlap(grams, x, y).tolist() == [len(np.intersect1d(grams[a], grams[b])) for a, b in zip(x, y)]


def test_pairs_are_counted_in_bounded_memory(monkeypatch):
    """However many pairs a task's columns have, the counts held at once are of PAIRS pairs or so."""
    rng = np.random.default_rng(1)
    ids = np.sort(rng.choice(10_000, 90, replace=False)).astype(np.int64)
    sizes, length = rng.integers(5, 20, 90), rng.integers(2, 80, 60)
    split = np.array([rng.integers(1, n) if k % 3 == 0 else 0 for k, n in enumerate(length)])
    cols = [rng.choice(90, n, replace=False) for n in length]
    want = {}
    for col, s in zip(cols, split):
        for i, y in enumerate(col):
            for x in col[: (s if i >= s else 0) if s else i]:
                a, b = max(x, y), min(x, y)
                if 2 * min(sizes[a], sizes[b]) >= max(sizes[a], sizes[b]):
                    want[ids[a], ids[b]] = want.get((ids[a], ids[b]), 0) + 1
    monkeypatch.setattr(ngram_join, "PAIRS", 100)
    monkeypatch.setattr(ngram_join, "DENSE", 16)
    monkeypatch.setattr(ngram_join, "CHUNK", 256)
    for f in (ngram_join.sparse_counts, ngram_join.dense_counts):
        got, most = {}, 0
        for batch in f(ids, sizes, np.concatenate(cols), length, split, 0.5):
            rows = [(a, b, c) for a, _, o, _, t in zip(*(c.to_pylist() for c in batch.columns)) for b, c in zip(np.frombuffer(o, np.int64), np.frombuffer(t, np.uint32))]
            most = max(most, len(rows))
            for a, b, c in rows:
                got[a, b] = got.get((a, b), 0) + c
        assert got == want and most <= 200 < len(want)


def distance(p, t):
    prev = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        cur = [i]
        for j in range(1, len(t) + 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (p[i - 1] != t[j - 1])))
        prev = cur
    return min(prev)


def test_decontamination_brute_force():
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 4)))
    items = [decontamination.normalise(" ".join(word() for _ in range(rnd.randint(10, 30)))) for _ in range(10)]
    docs = []
    for k in range(50):
        t = " ".join(word() for _ in range(rnd.randint(0, 50)))
        if k % 2:
            i = list(rnd.choice(items).decode())
            for _ in range(rnd.randint(0, 7)):
                i[rnd.randrange(len(i))] = rnd.choice(["", "x", "ab"])
            t = t[: len(t) // 2] + " " + "".join(i) + ", " + t[len(t) // 2 :]
        docs.append("..." + t.upper() + "!\n " if k % 7 == 0 else t)
    docs += ["", ".,."]
    data, starts = decontamination.normalised(*A.string_buffer(pa.array([d.lower() for d in docs])))
    assert [data[starts[k] : starts[k + 1] - 1].tobytes() for k in range(len(docs))] == [decontamination.normalise(d) for d in docs]
    got = sorted(decontamination.Matcher(items, 0.08).leaks(data, starts))
    want = sorted((r, k, d) for r, t in enumerate(docs) for k, i in enumerate(items) if (d := distance(i, decontamination.normalise(t))) <= decontamination.budget(len(i), 0.08))
    assert got == want and len(got) > 5


def test_bpe_equals_reference_merges(spark):
    import tiktoken

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    ranks = bpe.read_ranks()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(3)
    parts = [*"abst'  \n\t12!.é中", "'re", "'ll", "  ", "\r\n", "'S", "😀", " the"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(500)] + ["'", "a'ree", "a" * 3000, " " * 500]
    got = {r.doc_id: r for r in bpe.bpe(docs_of(spark, list(enumerate(texts))), lexicon=40).collect()}
    assert all(got[k].tokens == enc.encode_ordinary(t) and got[k].round_trip for k, t in enumerate(texts))
    back = {r.doc_id: r.text for r in bpe.decode(spark.createDataFrame([(k, r.tokens) for k, r in got.items()], "doc_id long, tokens array<int>")).collect()}
    assert back == dict(enumerate(texts))


def test_pii_discovers_what_no_seed_knows(spark):
    rows = [(i, f"badge: ab{i:03d}cd{i:02d} and mail joe.{i:02d}@mail.example.com, ip 10.0.0.{i}") for i in range(40)]
    rows += [(100 + i, f"write to token = \"{'%032x' % (i * 7919 + 10**30)}\" now") for i in range(30)]
    rows += [(200, "seen 0123456789abcdef0123456789abcdef there"), (201, "version 2.0 of 3 things in 2021")]
    got = [(r.doc_id, r.kind, r.value, r.pattern) for r in pii.pii(docs_of(spark, rows)).collect()]
    assert (200, "secret", "0123456789abcdef0123456789abcdef", "shape") in got
    assert not [g for g in got if g[0] == 201]
    assert sum(g[1] == "email" for g in got) == 40 and sum(g[1] == "ip" for g in got) == 40
    clean = {r.doc_id: r.text for r in pii.redact(docs_of(spark, rows)).collect()}
    assert clean[200] == "seen <SECRET> there" and clean[201] == rows[-1][1] and "@" not in clean[3]
    assert {r.doc_id: r.text for r in pii.redact(docs_of(spark, rows), limit=0).collect()} == clean


def test_pii_scores_brute_force(spark):
    rows = [("w", "1", "ip")] * 6 + [("w", str(k), "ip") for k in range(2, 9)] + [("w", "99", None), ("z", "99", None)]
    found = spark.createDataFrame([(1, 0, 1, v, s, None, p) for p, v, s in rows], pii.FOUND)
    got = {r.pattern: (r.kind, round(r.confidence, 9), r.support) for r in pii.learn(found, 1).collect()}
    conf = 8 / (9 + pii.SMOOTHING)
    assert got == ({"shape:w": ("ip", round(conf, 9), 9)} if conf >= pii.CONFIDENCE else {})


def test_license_scan(spark):
    noise = "the and of ing tion ou er"
    rows = [(1, f"{noise}\nReleased under the MIT License. {noise}"), (2, noise), (3, "Licensed under the Apache Licence, Version 2.0."), (4, "released under the mit license. Released under the MIT license!"), (5, f"é {noise} Licensed under CC BY-NC 4.0.")]
    got = sorted((r.doc_id, r.license, r.start, r.end) for r in license_scan.license_scan(docs_of(spark, rows)).collect())
    assert [(g[0], g[1]) for g in got] == [(1, "MIT"), (3, "Apache-2.0"), (4, "MIT"), (4, "MIT"), (5, "CC-BY-NC-4.0")]
    for i, _, s, e in got:
        assert "icen" in dict(rows)[i][s:e]
    t, w = [1, 2, 3, 4, 5, 6], [9, 1, 2, 8, 4, 5, 6, 9]
    assert license_scan.align(t, w, -10, 10) == (5, 1, 7)


def test_token_counts_brute_force(spark):
    scores = token_counts.zipf(bpe.read_ranks())
    lengths = sorted({len(p) for p in scores})
    rnd = random.Random(3)
    texts = ["".join(rnd.choice([*"abst'  \n12.é中", " the", "ing"]) for _ in range(rnd.randint(0, 50))) for _ in range(200)] + ["a" * 300]
    buf, offs = A.string_buffer(pa.array(texts))
    s, e, b = bpe.pretokens(buf, offs)
    want = [sum(token_counts.segment(buf[s[k] : e[k]].tobytes(), scores, lengths) for k in range(b[r], b[r + 1])) for r in range(len(texts))]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs_of(spark, list(enumerate(texts)))).collect()}
    assert [got[k] for k in range(len(texts))] == want


def test_language_id_brute_force():
    training = {"a": "abab cab abc ba", "b": "xyz zyx xxy yz"}
    parser = language_id.Parser(training)
    texts = ["abc cab", "zyx xyz", "ab xy qq", "", "a" * 500]
    cp, co = A.codepoints(*A.string_buffer(pa.array(texts)))
    got = parser.counts(parser.symbol[cp], co)
    for k, t in enumerate(texts):
        for j, lang in enumerate(parser.languages):
            n, i = 0, 0
            while i < len(t):
                size = 1
                while i + size < len(t) and t[i : i + size + 1] in training[lang]:
                    size += 1
                n, i = n + 1, i + size
            assert got[k, j] == n


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels_ = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train = labels_.where("doc_id % 4 <> 0")
    got = {r.doc_id: r.quality for r in quality_classifier.quality_classifier(docs, train).collect()}
    held = [r for r in labels_.where("doc_id % 4 = 0").collect()]
    assert sum(got[r.doc_id] == r.quality for r in held) >= 0.9 * len(held)
    lang = {r.doc_id: r.language for r in language_id.language_id(docs).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert sum(lang[r.doc_id] == r.lang for r in rows) >= 0.95 * len(rows)
