"""Truth tables of predicates, scores, the log fold and the log source."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from anamnesis.functions import scores as X, text as T, vector as V
from anamnesis.functions.stem import stem
from anamnesis.operators import arms, blocks, codec, curation, evaluate, links, predicates as P, scan
from anamnesis.plans import live
from anamnesis.plans.index import Index
from anamnesis.sources import evaluation as source
from anamnesis.sources.log import Log, check_namespace, minor_run_len, namespaces


@pytest.fixture(scope="module")
def tagged(spark):
    return spark.createDataFrame([("ab", ["a", "b"]), ("a", ["a"]), ("c", ["c"]), ("none", [])], "id string, tags array<string>")


@pytest.mark.parametrize(
    "tags,mode,want",
    [
        (["a"], "any", "a ab none"), (["a"], "any_strict", "a ab"), (["a", "b"], "all", "ab none"), (["a", "b"], "all_strict", "ab"),
        (["b", "a", "a"], "exact", "ab"), ([], "exact", "none"), ([], "any", "a ab c none"), ([], "all_strict", "a ab c none"),
    ],
)
def test_tag_modes(tagged, tags, mode, want):
    assert " ".join(sorted(r.id for r in tagged.where(P.tag_filter(tags, mode)).collect())) == want


def test_tag_tree(tagged):
    tree = P.All([P.Any_([P.Leaf(["a"], "any_strict"), P.Leaf(["c"], "any_strict")]), P.Not(P.Leaf(["b"], "any_strict"))])
    assert sorted(r.id for r in tagged.where(tree.column()).collect()) == ["a", "c"]
    assert tagged.where(P.All([]).column()).count() == 4 and tagged.where(P.Any_([]).column()).count() == 0


def test_empty_delete_is_refused(tagged):
    with pytest.raises(ValueError):
        scan.delete_eager(tagged, P.Predicate())


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_scores(spark):
    assert [round(value(spark, X.entity_score(F.lit(n))), 3) for n in (1, 2, 3, 4)] == [0.462, 0.762, 0.905, 0.964]
    assert value(spark, X.proximity(F.lit(50), 0, 100)) == 1.0 and value(spark, X.proximity(F.lit(0), 0, 100)) == 0.0 and value(spark, X.proximity(F.lit(9), 5, 5)) == 1.0
    assert value(spark, V.f16(F.lit(0.7001))) == 0.7001953125
    assert value(spark, X.uuid5(F.lit("key"))) == str(uuid.uuid5(uuid.NAMESPACE_OID, "key"))


def test_cosine(spark):
    v = F.array(F.lit(1.0), F.lit(0.0))
    assert value(spark, V.cosine(v, v)) == 1.0
    assert value(spark, V.cosine(v, F.array().cast("array<double>"))) == 0.0
    with pytest.raises(Exception, match="dimensions"):
        value(spark, V.cosine(v, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))))


def test_tokenizer(spark):
    assert value(spark, T.words(F.lit("Hello, World! get_user_id the"))) == ["hello", "world", "get_user_id"]
    assert value(spark, T.char_bigrams(F.lit("北京大学 x 水"))) == ["北京", "京大", "大学", "水"]
    assert value(spark, T.normalized(F.lit("ＧＰＴ ½"))) == "GPT 1⁄2" and value(spark, T.script_runs(F.lit("使用GPT モデル ok"))) == ["使用", "GPT", "モデル", "ok"]
    assert value(spark, T.plain_tokens(F.lit("The boxes, cities and glasses a"))) == ["boxe", "city", "glasse"]
    assert T.query_terms("使用 GPT 模型 the Running ＧＰＴ", True) == [("bigrams", "使用"), ("bigrams", "模型"), ("words", "gpt"), ("words", "run")]
    assert [(r.field, r.term) for r in value(spark, T.fields(F.lit("GPT 模型")))] == [("words", "gpt"), ("bigrams", "gpt"), ("bigrams", "模型")]
    assert T.config_hash(True) != T.config_hash(False)


def test_stemmer():
    for word, want in {"consistency": "consist", "knavish": "knavish", "generously": "generous", "hopping": "hop", "hoping": "hope", "ties": "tie", "cries": "cri", "communication": "communic", "analogously": "analog", "controlled": "control", "agreed": "agre", "skies": "sky", "by": "by"}.items():
        assert stem(word) == want


def test_text_fields_rank_cjk_and_index_text(spark):
    m = spark.createDataFrame([(1, 1, "北京大学很好", ""), (2, 1, "上海大学", ""), (3, 1, "x", "running licenses"), (4, 1, "GPT 模型", "")], "id long, memory_type int, text string, index_text string")
    p, t = arms.field_postings(m, True), arms.field_totals(m, True)
    found = lambda q: [r.id for r in arms.bm25_fields(p, t, T.query_terms(q, True)).orderBy("rank").collect()]
    assert found("北京大学")[0] == 1 and set(found("大学")) == {1, 2} and found("run") == [3] and found("ＧＰＴ") == [4] and found("模型") == [4]
    plain = [(r.id, r.score) for r in arms.bm25(m, ["gpt", "gpt"]).collect()]
    assert plain == [(r.id, r.score) for r in arms.bm25(m, ["gpt"]).collect()] and arms.bm25(m, ["gpt", "gpt"], repeats=True).first().score == 2 * plain[0][1]


LOG = "seq long, op_index int, kind string, id string, tags array<string>, metadata map<string,string>, proof_count long, proof_delta long, merge_metadata map<string,string>"


def op(seq, i, kind, id_, tags=None, metadata=None, proof=None, delta=None, merged=None):
    return (seq, i, kind, id_, tags, metadata, proof, delta, merged)


def test_log_fold(spark):
    rows = [
        op(1, 0, "upsert", "a", ["x"], {"k": "1"}, 0), op(2, 0, "tombstone", "a"), op(3, 0, "patch", "a", delta=5),
        op(4, 0, "upsert", "a", [], {"k": "2"}, 1), op(5, 0, "patch", "a", delta=-3), op(6, 0, "patch", "a", delta=2, merged={"m": "9"}),
        op(1, 1, "upsert", "b", ["x"], {"k": "1"}, 0), op(5, 1, "upsert", "c", ["x"], {"k": "1"}, 0), op(2, 1, "patch", "ghost", delta=1),
    ]
    log = spark.createDataFrame(rows, LOG)
    got = {r.id: r for r in live.live(log).collect()}
    assert sorted(got) == ["a", "b", "c"]
    assert got["a"].proof_count == 2 and got["a"].metadata == {"k": "2", "m": "9"} and got["a"].write_seq == 4  # clamped at 0 before +2
    deleted = live.live(log, {5: P.Predicate(tags=["x"], mode="any_strict")})
    assert sorted(r.id for r in deleted.collect()) == ["a", "c"]  # an upsert of the same entry survives
    assert sorted(r.id for r in live.live(log, as_of=2).collect()) == ["b"]


def test_absolute_times_and_folds_of_parts(spark):
    schema = LOG + ", occurred_start long, occurred_end long, mentioned_at long, event_at long, set_times struct<occurred_start:long,occurred_end:long,mentioned_at:long,event_at:long>, predicate string"
    none = (None,) * 4
    rows = [
        (*op(1, 0, "upsert", "a", ["x"], {"k": "1"}, 0), 10, 20, 30, 40, None, None), (*op(2, 0, "patch", "a", delta=5), *none, (None, 7, None, None), None),
        (*op(3, 0, "upsert", "b", ["x"], {"k": "9"}, 0), *none, None, None), (*op(4, 0, "tombstone_where", None), *none, None, P.Predicate(metadata_equals={"k": "9"}).to_json()),
        (*op(5, 0, "patch", "b", delta=1), *none, None, None), (*op(6, 0, "patch", "c", delta=1), *none, None, None), (*op(7, 0, "upsert", "b", [], {"z": "1", "k": "9"}, 2), *none, None, None),
    ]
    log = spark.createDataFrame(rows, schema)
    key = lambda r: (r.id, r.write_seq, r.proof_count, r.occurred_start, r.occurred_end, tuple(sorted(r.metadata.items())))
    want = [("a", 1, 5, None, 7, (("k", "1"),)), ("b", 7, 2, None, None, (("k", "9"), ("z", "1")))]
    assert sorted(map(key, live.live(log).collect())) == want
    assert [r.id for r in live.live(log, as_of=3).orderBy("id").collect()] == ["a", "b"] and [r.id for r in live.live(log, as_of=5).collect()] == ["a"]
    for cut in range(1, 7):  # rows folded so far and the rest; squashed parts
        assert sorted(map(key, live.with_tail(live.live(log.where(f"seq <= {cut}")), log.where(f"seq > {cut}")).collect())) == want
        assert sorted(map(key, live.live(live.squash(log.where(f"seq <= {cut}")).union(live.squash(log.where(f"seq > {cut}")))).collect())) == want
    assert live.fold_proof_count(1, [-3, 2]) == 0 and live.fold_proof_count(1, [2, -3, 4]) == 4


def test_predicates_in_the_log():
    p = P.Predicate([1], {"k": "v"}, ["a"], "all", [P.All([P.Leaf(["x"]), P.Not(P.Any_([P.Leaf([], "exact")]))])], 5, None)
    assert P.Predicate.from_json(p.to_json()) == p and P.Predicate.from_json(P.Predicate().to_json()).is_empty()
    assert p.summary() == "types=[1] and k=v and tags all ['a'] and 1 tag groups and updated_at > 5"


def test_wire_filter(tagged):
    got = lambda *a: " ".join(sorted(r.id for r in tagged.where(P.wire_filter(*a)).collect()))
    assert got(["a"]) == "a ab none" and got(["a"], "ALL_STRICT") == "a ab" and got(["a"], 2) == "a ab" and got([], None, [{"not": {"tags": ["b"], "mode": "any_strict"}}]) == "a c none"


def test_log_source(spark, tmp_path):
    log = Log(spark, str(tmp_path), "bank")
    assert log.create(("k",), "h") and not log.create() and log.manifest()["declared"] == ["k"] and log.head() == 0
    one = spark.createDataFrame([("upsert", "a", None)], "kind string, id string, updated_at long")
    assert log.append(one, now_ms=7) == 1 and log.commit(one) == (2, 1)
    assert log.read().where("seq = 1").first().updated_at == 7
    with pytest.raises(RuntimeError):
        log.append(one, expect_below=3)
    assert [r.folded for r in log.entries(cursor=1).collect()] == [True, False]
    with pytest.raises(ValueError):
        check_namespace("_sys")
    assert log.commit_many([one, one.limit(0), one]) == [3, 4] and namespaces(spark, str(tmp_path)) == ["bank"]
    assert log.stats() == {"generation": 0, "wal_head": 4, "cursor": 0, "backlog": 4, "segments": 0, "has_index": False}
    assert {r.kind for r in log.objects().collect()} >= {"entry", "manifest", "head", "claim"} and "updated_at" in log.decode(f"wal/{1:020d}")[0]
    assert log.delete() > 4 and namespaces(spark, str(tmp_path)) == [] and not log.exists()


def test_two_writers_never_share_a_seq(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    one = spark.createDataFrame([("upsert", "a")], "kind string, id string")
    logs = [Log(spark, str(tmp_path), "bank") for _ in range(2)]
    logs[0].create()
    with ThreadPoolExecutor(4) as pool:
        seqs = list(pool.map(lambda k: logs[k % 2].append(one), range(12)))
    assert sorted(seqs) == list(range(1, 13)) and logs[0].read().count() == 12
    old = logs[0].manifest()["generation"]
    assert logs[0].swap(old, {"cursor": 3}) and not logs[1].swap(old, {"cursor": 5}) and logs[1].manifest()["cursor"] == 3


def test_folds_and_gc(spark, tmp_path):
    log = Log(spark, str(tmp_path), "bank")
    make = lambda *rows: spark.createDataFrame(rows, "kind string, id string, proof_count long, proof_delta long")
    log.append(make(*(("upsert", f"r{i}", 0, None) for i in range(20))))
    assert log.fold() == "full" and log.fold() == "none"
    log.append(make(("patch", "r1", None, 5), ("patch", "ghost", None, 1)))
    assert log.fold() == "flush"
    log.append(make(("tombstone", "r2", None, None), ("patch", "r1", None, -2)))
    assert log.fold() == "flush"
    log.append(make(("patch", "r1", None, 1)))
    assert log.fold() == "minor" and log.stats()["segments"] == 2
    log.append(make(("upsert", "r2", 7, None)))
    want = {f"r{i}": {1: 4, 2: 7}.get(i, 0) for i in range(20)}
    assert {r.id: r.proof_count for r in log.view().collect()} == want
    assert {r.id: r.proof_count for r in log.view(as_of=4).collect()} == {k: v for k, v in want.items() if k != "r2"}
    assert log.gc(now_ms=0) == 0  # too young
    assert log.gc(0) > 0 and {r.id: r.proof_count for r in log.view().collect()} == want
    assert {r.id: r.proof_count for r in log.optimize().collect()} == want and log.next_seq() == 6
    assert minor_run_len([10, 3, 3]) == 2 and minor_run_len([10, 3]) == 0 and minor_run_len([5, 4, 4]) == 0 and minor_run_len([20, 9, 5, 4]) == 3


def test_codes_keep_their_bounds():
    rng = np.random.default_rng(5)
    x = blocks.unit(rng.normal(size=(200, 48)))
    c = blocks.unit(rng.normal(size=(4, 48)))[rng.integers(0, 4, 200)]
    rotation = codec.Rotation(48)
    assert np.allclose(np.linalg.norm(rotation.apply(x), axis=1), 1)
    for kind in ("int8", "binary"):
        code, low, step, rest, norm = codec.encode(x, c, kind, rotation)
        for q in blocks.unit(rng.normal(size=(10, 48))):
            lo, hi = codec.bounds(code, low, step, rest, c @ q, q, kind, rotation)
            assert ((x @ q >= lo) & (x @ q <= hi)).all()
    code, low, step, *_ = codec.encode(x, c, "int8")
    assert np.abs(codec.decode(code, low, step, c) - x).max() <= step.max() / 2 + 1e-12
    plane = codec.principal_plane(x)
    assert plane.shape == (200, 2) and plane[:, 0].var() >= plane[:, 1].var()


def test_products_in_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 5))
    m = spark.createDataFrame([(i, 1 + i % 2, i // 10, [float(a) for a in v]) for i, v in enumerate(x)] + [(99, 1, 0, None)], "id long, memory_type int, batch long, vector array<double>")
    s = blocks.unit(x) @ blocks.unit(x).T
    want = set()
    for i in range(90):
        own = sorted(((-s[i, j], j) for j in range(90) if j != i and j % 2 == i % 2 and j // 10 <= i // 10 and s[i, j] >= 0.2))[:5]
        want |= {(i, j) for _, j in own}
    for block in (2048, 7):
        assert {(r.src, r.dst) for r in links.derive_links(m, 0.2, block=block).collect()} == want
        assert {(r.src, r.dst) for r in links.similar(m, 0.5, block=block).collect()} == {(i, j) for i in range(90) for j in range(i + 1, 90) if i % 2 == j % 2 and s[i, j] >= 0.5}
    new = m.where("id >= 80")
    assert {(r.src, r.dst) for r in links.derive_links(m, 0.2, new=new).collect()} == {p for p in want if p[0] >= 80}
    with pytest.raises(Exception, match="dimensions"):
        links.similar(m.union(spark.createDataFrame([(100, 1, 0, [1.0])], m.schema)), 0.5).collect()


def test_index_grows_by_what_is_added(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, 1, i // 10, [float(a) for a in rng.normal(size=4)], f"text {i} word", [], {}) for i in range(40)]
    m = spark.createDataFrame(rows, "id long, memory_type int, batch long, vector array<double>, text string, causal_out array<struct<target:long,link_type:string,weight:double>>, metadata map<string,string>")
    a = Index.build(m.where("id < 30"), f"{tmp_path}/a", 0.3)
    a.add(m.where("id >= 30"), 0.3)
    b = Index.build(m, f"{tmp_path}/b", 0.3)
    for name in ("out", "in", "postings"):
        assert sorted(map(tuple, a.table(name).select(*b.table(name).columns).collect()), key=repr) == sorted(map(tuple, b.table(name).collect()), key=repr)
    got = [(r.id, r.score) for r in arms.bm25_from(a.table("postings"), a.table("totals"), ["text", "word"], 5).collect()]
    assert got == [(r.id, r.score) for r in arms.bm25(m, ["text", "word"], 5).collect()]


def test_observations(spark):
    o = spark.createDataFrame([(1, {"src:5": "1", "src:6": "1"}), (2, {"src:7": "1"}), (3, {})], "id long, metadata map<string,string>")
    deleted = spark.createDataFrame([(5,)], "id long")
    assert [r.id for r in curation.observations_for(o, deleted).collect()] == [1]
    gone, again = curation.delete_stale(o, deleted)
    assert [r.id for r in gone.collect()] == [1] and [(r.id, r.merge_metadata) for r in again.collect()] == [("6", {"consolidated": "0"})]
    live_, archive = curation.invalidate(o, o.limit(0).withColumn("reason", F.lit("")), F.col("id") == 2, "wrong")
    archive = curation.set_reason(archive, F.col("id") == 2, "stale")
    assert sorted(r.id for r in live_.collect()) == [1, 3] and [(r.id, r.reason) for r in archive.collect()] == [(2, "stale")]
    live_, archive = curation.restore(live_, archive, F.col("id") == 2)
    assert sorted(r.id for r in live_.collect()) == [1, 2, 3] and archive.count() == 0
    m = spark.createDataFrame([(10, [3, 1]), (11, [2, 3])], "id long, entity_ids array<long>")
    sources = spark.createDataFrame([(9, 0, 11), (9, 1, 10)], "id long, pos int, source long")
    row = curation.upsert_observation(spark.createDataFrame([(9, {"a": "b"})], "id long, metadata map<string,string>"), sources, m).first()
    assert row.entity_ids == [2, 3, 1] and row.metadata == {"a": "b", "src:10": "1", "src:11": "1"} and row.kind == "upsert"


def test_replay_finds_what_a_view_lost(spark):
    acked = [(1, 0, "upsert", 1, "a"), (2, 0, "upsert", 2, "b"), (3, 0, "tombstone", 1, None), (4, 0, "upsert", 3, "c")]
    assert evaluate.replay(acked) == {2: "b", 3: "c"}
    assert evaluate.divergence(spark.createDataFrame([(1, "a"), (2, "b"), (3, "x")], "id long, v string"), acked, "v") == [1, 3]


def test_readers_of_benchmarks(spark, tmp_path):
    (tmp_path / "corpus.jsonl").write_text('{"_id": "1", "title": "A", "text": "b c"}\n{"_id": "2", "title": "", "text": "d"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q", "text": "b"}\n')
    (tmp_path / "qrels.tsv").write_text("query-id\tcorpus-id\tscore\nq\t1\t2\n")
    np.save(tmp_path / "x.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    assert sorted((r.doc, r.text) for r in source.corpus(spark, f"{tmp_path}/corpus.jsonl").collect()) == [("1", "A b c"), ("2", "d")]
    assert source.queries(spark, f"{tmp_path}/queries.jsonl").first().qid == "q" and source.qrels(spark, f"{tmp_path}/qrels.tsv").first().rel == 2
    assert sorted((r.row, r.vector) for r in source.npy(spark, f"{tmp_path}/x.npy").collect()) == [(0, [0.0, 1.0]), (1, [2.0, 3.0]), (2, [4.0, 5.0])]


def test_exact_baseline(spark):
    corpus = spark.createDataFrame([(1, 0, "red cats", [1.0, 0.0]), (2, 0, "blue dogs dogs", [0.0, 1.0]), (3, 0, "red dog", [0.6, 0.8])], "id long, memory_type int, text string, vector array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, query array<double>")
    got = evaluate.exact_baseline(corpus, asked, {7: ["dog", "red"]}, 3)
    order = lambda df: [r.doc for r in df.orderBy("rank").collect()]
    assert order(got["dense"]) == [1, 3, 2] and order(got["sparse"])[0] == 3 and order(got["hybrid"])[0] in (1, 3)


def test_top_ties_and_dimension(spark):
    m = spark.createDataFrame([(i, 1, [1.0, 0.0]) for i in (3, 1, 2)] + [(4, 1, None)], "id long, memory_type int, vector array<double>")
    assert [(r.id, r.rank) for r in arms.dense(m, [1.0, 0.0], 2).orderBy("rank").collect()] == [(1, 0), (2, 1)]
    with pytest.raises(ValueError):
        arms.check_dimension(m, [1.0])
