"""Whole operators against plain versions of themselves, and texts that were once handled wrongly."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from anamnesis.llm import arrays as A, bpe, decontamination, language_id, license_scan, pii, quality_classifier, quality_rules, token_counts
from anamnesis.llm.license_templates import TEMPLATES
from anamnesis.llm.lm_scoring import word_keys

from ..compare import SF
from .test_operators import distance


def docs_of(spark, rows):
    """Columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 0, "s", 1, [2]) for i, t in rows], "doc_id long, text string, n_chars int, row string, key long, spans array<int>")


PROSE = {
    1: "今天天气很好。\n我们去公园散步！\n你觉得怎么样？", 2: "آج موسم اچھا ہے۔\nہم باغ میں گئے۔", 3: "आज मौसम अच्छा है।\nहम बाग में गए।", 4: "วันนี้อากาศดีมาก\nเราไปเดินเล่นกัน",
    5: "I saw it at 19.37.233.11\nWrite to joe.smith@mail.example.com\nHe said “yes”\nSo (I think)", 6: "A long paragraph that says that a site may set a cookie, and what that means for its readers, how javascript does so, and why one may care about it at all.",
}


def test_rules_keep_prose_of_all_scripts(spark):
    rows = [*PROSE.items(), (7, "Home\nAbout us\nAccept the cookie now.\nMenu"), (8, None), (9, "")]
    got = {r.doc_id: r for r in quality_rules.clean(docs_of(spark, rows)).collect()}
    assert sorted(got) == sorted(PROSE) and all(got[i].text == t and got[i].n_chars == len(t) and got[i].key == 1 for i, t in PROSE.items())


def test_rules_judge_a_line_once(spark):
    plan = quality_rules.clean(docs_of(spark, [(1, "a.")]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lorem ipsum") == 1


def test_leaks_are_decided_row_by_row(spark):
    item = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(None, f"so {item} it is"), (None, "clean"), (1, item.upper()), (1, "also clean"), (2, None), (3, "two words"), (4, "these two wordsmiths"), (5, "word")]
    items = spark.createDataFrame([(1, item), (2, "two words"), (3, "word"), (4, None), (5, "")], "item_id long, text string")
    kept = sorted(((r.doc_id or 0, r.text or "") for r in decontamination.without_leaks(docs_of(spark, rows), items).collect()))
    assert kept == [(0, "clean"), (1, "also clean"), (2, ""), (4, "these two wordsmiths"), (5, "word")]
    found = {(r.doc_id, r.item_id) for r in decontamination.decontaminate(docs_of(spark, rows), items).collect()}
    assert found == {(None, 1), (1, 1), (3, 2)}
    assert decontamination.without_leaks(docs_of(spark, rows), items.limit(0)).count() == len(rows)


def test_decontamination_query_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "GROUP_BYTES", 200)  # several groups of items
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 5)))
    items = [" ".join(word() for _ in range(rnd.randint(8, 20))) for _ in range(8)]
    rows = []
    for k in range(60):
        w = [word() for _ in range(rnd.randint(0, 40))]
        if k % 2:
            i = rnd.choice(items).split()
            for _ in range(rnd.randint(0, 3)):
                i[rnd.randrange(len(i))] = rnd.choice(["", "x", "Ab,"])
            w[len(w) // 2 : len(w) // 2] = i
        rows.append((k, " ".join(w)))
    got = {(r.doc_id, r.item_id): r.distance for r in decontamination.decontaminate(docs_of(spark, rows), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    want = {}
    for k, t in rows:
        for j, i in enumerate(items):
            i = decontamination.normalise(i)
            d = distance(i, decontamination.normalise(t))
            if d <= (decontamination.budget(len(i), decontamination.RATE) if len(i) >= decontamination.MIN_LENGTH else 0):
                want[k, j] = d
    assert got == want and len(want) > 10
    kept = {r.doc_id for r in decontamination.without_leaks(docs_of(spark, rows), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert kept == {k for k, _ in rows} - {k for k, _ in want}


def test_words_of_one_polynomial_hash_keep_their_tokens(spark):
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    assert len(a) == 2048 and len({int(word_keys(x)[0]) for x in (a, b)}) == 2
    got = {r.doc_id: r for r in bpe.bpe(docs_of(spark, [(1, a), (2, b), (3, a)])).collect()}
    ranks = bpe.read_ranks()
    assert all(r.round_trip for r in got.values()) and list(got[2].tokens) == bpe.merge(b.encode(), ranks) and got[1].tokens == got[3].tokens
    back = {r.doc_id: r.text for r in bpe.decode(bpe.bpe(docs_of(spark, [(1, a), (2, b)]))).collect()}
    assert back == {1: a, 2: b}


def test_distinct_spans_compare_bytes(monkeypatch):
    monkeypatch.setattr(A, "word_hashes", lambda buf, s, e: (e - s).astype(np.uint64) // np.uint64(3))
    words = [b"ab", b"cd", b"ab", b"abcdefghij", b"abcdefghik", b"", b"abcdefghij", b"x"]
    buf, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    starts = ends - np.array([len(w) for w in words])
    code, at, _ = A.distinct_spans(buf, starts, ends)
    assert [words[at[c]] for c in code] == words and len(at) == len(set(words))


def test_vocabulary_without_a_byte_is_refused(spark):
    ranks = bpe.read_ranks()
    short = {p: r for p, r in ranks.items() if p != b"q"}
    with pytest.raises(ValueError, match="0x71"):
        bpe.checked(short)
    with pytest.raises(ValueError):
        token_counts.token_counts(docs_of(spark, []), scores=token_counts.zipf(short))
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [10**6])], "doc_id long, tokens array<int>")).collect()


def test_redaction_is_the_same_by_broadcast_and_by_join(spark):
    rows = [(1, "nothing personal at all in this second row"), (1, "mail joe.smith@mail.example.com now"), (None, "mail ann.b@mail.example.com"), (None, "clean"), (2, None), (2, "")]
    rows += [(100 + i, f"badge: ab{i:03d}cd{i:02d} and mail joe.{i:02d}@mail.example.com") for i in range(30)]
    rows.append((300, "x" * 60 + "=" + "token" * 20 + " and password=" + "Correct" * 12))
    key = lambda r: (r.doc_id or 0, r.text or "", r.row)
    one, two = (sorted(map(key, pii.redact(docs_of(spark, rows), limit=n).collect())) for n in (pii.MAX_BROADCAST, -1))
    assert one == two and (1, rows[0][1], "s") in one and (1, "mail <EMAIL> now", "s") in one
    found = pii.pii(docs_of(spark, rows))
    assert {(r.doc_id, r.value) for r in found.where("doc_id = 1").collect()} == {(1, "joe.smith@mail.example.com")}


def test_pii_graph_brute_force(spark):
    rnd = random.Random(2)
    kinds = sorted(pii.SEEDS)
    rows = []
    for _ in range(300):
        v = rnd.randint(0, 60)
        rows.append((1, 0, 1, f"v{v}", rnd.choice(kinds[:2]) if v % 3 and rnd.random() < 0.9 else None, rnd.choice([None, "a=", "b:"]), f"s{v % 7}"))
    got = {r.pattern: (r.kind, round(r.confidence, 9), r.support) for r in pii.learn(spark.createDataFrame(rows, pii.FOUND)).collect()}
    edges, seeds = set(), defaultdict(lambda: dict.fromkeys(kinds, 0.0))
    for *_, v, s, c, f in rows:
        edges.add((f"shape:{f}", v))
        if c:
            edges.add((f"cue:{c}", v))
        if s:
            seeds[v][s] = 1.0
    scores = {v: dict(seeds[v]) for _, v in edges}
    for _ in range(pii.ROUNDS):
        members = defaultdict(list)
        for p, v in edges:
            members[p].append(v)
        conf = {p: {k: sum(scores[v][k] for v in vs) / (len(vs) + pii.SMOOTHING) for k in kinds} for p, vs in members.items()}
        scores = {v: {k: max([seeds[v][k], *(conf[p][k] for p, x in edges if x == v and len(members[p]) >= pii.SUPPORT)]) for k in kinds} for v in scores}
    want = {}
    for p, c in conf.items():
        best = max(c.values())
        if best >= pii.CONFIDENCE and len(members[p]) >= pii.SUPPORT:
            want[p] = (next(k for k in kinds if c[k] == best), round(best, 9), len(members[p]))
    assert got == want


def test_classifier_brute_force_and_toxic_accuracy(spark):
    model = quality_classifier.Model(buckets=64, dim=4).fit(["good text here", "bad!! ##text", "fine words all"], np.array([[1, 0], [0, 1], [1, np.nan]], np.float32), epochs=2)
    texts = ["good words", "", " \n", "é中 text ##", "bad!! bad!! bad!!", "one"]
    table, bias = model.table()
    got = quality_classifier.score(table, bias, *A.string_buffer(pa.array(texts)))
    for k, t in enumerate(texts):
        idx = np.concatenate([f for f, _ in quality_classifier.features(*A.string_buffer(pa.array([t])), 64)])
        x = model.vectors[idx].mean(0) if len(idx) else np.zeros(4)
        for task in range(2):
            assert abs(quality_classifier.softmax(x @ model.heads[task] + model.bias[task])[1] - got[k, task]) < 1e-5
    words = [len(f) for f, _ in quality_classifier.features(*A.string_buffer(pa.array(["a bc d", "e"])), 1 << 18)][:2]
    assert words == [4, 2]  # four tokens, two pairs within rows


def test_toxic_accuracy_held_out(spark):
    sf = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = labels.where("doc_id % 4 = 0")
    out = {r.doc_id: r.toxic for r in quality_classifier.quality_classifier(docs, labels.where("doc_id % 4 <> 0")).collect()}
    rows = held.collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if r.toxic == 0]
    assert sum(out[r.doc_id] for r in toxic) >= 0.8 * len(toxic) > 50 and sum(out[r.doc_id] for r in clean) <= 0.03 * len(clean)


def test_license_scan_against_alignment_of_every_template(spark):
    rnd = random.Random(6)
    noise = "the of and is under a program on work in by ing".split()
    short = {n: [t for t in own if len(t.split()) < 60] for n, own in TEMPLATES.items()}
    rows, planted = [], []
    for k in range(60):
        name = rnd.choice(sorted(n for n in short if short[n]))
        t = rnd.choice(short[name]).split()
        for _ in range(rnd.randint(0, len(t) // 6)):
            t[rnd.randrange(len(t))] = rnd.choice(["", rnd.choice(noise)])
        pad = lambda: [rnd.choice(noise) for _ in range(rnd.randint(0, 30))]
        rows.append((k, " ".join(pad() + t + pad())))
    got = defaultdict(set)
    for r in license_scan.license_scan(docs_of(spark, rows), short).collect():
        got[r.doc_id].add(r.license)
    templates = [(n, word_keys(t).tolist()) for n, own in short.items() for t in own]
    hit = total = 0
    for k, t in rows:
        w = word_keys(t.lower()).tolist()
        best = defaultdict(int)
        for n, own in templates:
            matched, s, e = license_scan.align(own, w, -len(own), len(w))
            if matched >= license_scan.COVERAGE * len(own):
                best[n] = max(best[n], matched)
        if best:
            total += 1
            top = max(best.values())
            hit += bool({n for n, m in best.items() if m == top} & got[k])
        else:
            assert not got[k]
    assert total > 40 and hit >= 0.95 * total


def test_whole_licence_texts(spark):
    rnd = random.Random(4)
    rows = []
    names = ["Apache-2.0", "GPL-2.0", "MPL-2.0", "MIT", "BSD-3-Clause", "CC0-1.0"]
    for k, name in enumerate(names):
        w = TEMPLATES[name][-1].split()
        for _ in range(len(w) // 25):
            w[rnd.randrange(len(w))] = "changed"
        rows.append((k, "some words before " + " ".join(w) + " and after"))
    got = {r.doc_id: r for r in license_scan.license_scan(docs_of(spark, rows)).where("matched > 100").collect()}
    assert {k: got[k].license for k in got} == dict(enumerate(names)) and all(r.coverage > 0.9 for r in got.values())


def test_language_query_brute_force(spark):
    rnd = random.Random(9)
    alphabet = {"aa": "abcde", "bb": "cdefg", "cc": "xyzab"}
    say = lambda s, n: " ".join("".join(rnd.choice(s) for _ in range(rnd.randint(1, 6))) for _ in range(n))
    rows = [(i, say(alphabet[lang], rnd.randint(0, 12)), lang) for i, lang in enumerate(rnd.choices(sorted(alphabet), k=60))] + [(90, None, "aa"), (91, "12 !", None), (None, "ABC; cde", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    training = language_id.training_text(docs)
    assert sorted(training) == sorted(alphabet)
    got = {r.doc_id: r for r in language_id.language_id(docs).collect()}
    for i, t, _ in rows:
        t = re.sub("[^a-z\x80-\U0010ffff]+", " ", (t or "").lower()).strip(" ")
        need = {}
        for lang in sorted(training):
            n = k = 0
            while k < len(t):
                size = 1
                while k + size < len(t) and t[k : k + size + 1] in training[lang]:
                    size += 1
                n, k = n + 1, k + size
            need[lang] = n
        if not t:
            assert (got[i].language, got[i].phrases, got[i].score) == (None, 0, 0.0)
        else:
            least = min(need.values())
            assert got[i].language == min(x for x in need if need[x] == least) and got[i].phrases == least and abs(got[i].score - least / len(t)) < 1e-12
