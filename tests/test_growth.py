"""Steps whose cost or result once changed with the size of the tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from anamnesis.functions.text import query_terms
from anamnesis.operators import ann, arms, blocks, evaluate, links
from anamnesis.plans import catalog
from anamnesis.plans.index import Rows
from anamnesis.sources.fixtures import oplog

from .compare import SF


@pytest.mark.parametrize("merge", ["true", "false"])
def test_oplog_numbers_rows_once(spark, tmp_path, merge):
    """Ranges of more rows than their sample has: every place is taken once, in order of (ts, event_id)."""
    n, key = 40_000, "spark.sql.adaptive.coalescePartitions.enabled"
    rows = spark.range(n).select(
        F.col("id").alias("event_id"), F.timestamp_micros((F.col("id") * 7919 % n / 3).cast("long") * 1_000_000).alias("ts"), F.col("id").alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"),
    )
    rows.unionByName(rows.limit(1).withColumns({"ts": F.lit(None).cast("timestamp"), "event_id": F.lit(n).cast("long"), "user_id": F.lit(n).cast("long")})).write.parquet(f"{tmp_path}/events.parquet")
    spark.conf.set(key, merge)
    try:
        got = {r.id: (r.seq - 1) * 8 + r.op_index for r in oplog(spark, str(tmp_path)).select("id", "seq", "op_index").collect()}
    finally:
        spark.conf.unset(key)
    order = sorted(range(n), key=lambda i: (int(i * 7919 % n / 3), i)) + [n]  # without a time: last
    assert [got[i] for i in order] == list(range(n + 1))


def test_products_replicate_rows_by_blocks_not_by_pairs(spark):
    """Rows that are shuffled: the left ones once, the right ones BLOCKS times at most, however many pairs there are."""
    n = 6000
    rows = spark.range(n).select(F.lit(1).alias("grp"), "id", F.lit(0).cast("long").alias("batch"), F.array(F.cos(F.col("id") * 0.7), F.sin(F.col("id") * 0.7)).cast("array<float>").alias("vector"))
    few, many = (sum(blocks._sizes(rows.limit(k), None).values()) for k in (n // 2, n))
    assert few == many == blocks.BLOCKS
    got = blocks.product(rows, rows, 6, most=3, ok=lambda a, ba, b, bb: a != b)
    x = blocks.unit(np.array([r.vector for r in rows.orderBy("id").collect()], float))
    s = np.round(np.clip(x @ x.T, -1, 1), 6)
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(n) for j in np.lexsort((np.arange(n), -s[i]))[:3]}
    assert {(r.a, r.b) for r in got.collect()} == want


def test_judgements_by_group_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    docs = [(i, int(rng.integers(0, 6)), int(rng.integers(0, 3))) for i in range(60)] + [(60, 7, 1), (61, 8, 0), (62, 8, 2)]
    groups = spark.createDataFrame(docs, "doc long, grp int, rel int")
    run = spark.createDataFrame([(q, int(d), r) for q, _, _ in docs for r, d in enumerate(x for x in rng.permutation(63)[:13] if x != q)], "qid long, doc long, rank int")
    qrels = groups.select(F.col("doc").alias("qid"), "grp").join(groups, "grp").where("qid <> doc").select("qid", "doc", "rel")
    for grouped, pairs in ((evaluate.grouped_ndcg, evaluate.ndcg), (evaluate.grouped_recall, evaluate.recall), (evaluate.grouped_mrr, evaluate.mrr)):
        assert sorted(map(tuple, grouped(run, groups, 10).collect())) == sorted(map(tuple, pairs(run, qrels, 10).collect()))


def test_the_judgements_of_the_queries_are_a_row_a_vector(spark):
    _, groups = catalog.run_and_groups(spark, SF)
    assert groups.count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()


def test_bounded_search_makes_no_row_of_a_query_and_a_cluster(spark):
    """Every query with every row of the clusters it reads was a row of a join."""
    rng = np.random.default_rng(4)
    m = spark.createDataFrame([(i, 1, [float(a) for a in v]) for i, v in enumerate(rng.normal(size=(50, 8)))], "id long, memory_type int, vector array<double>")
    c = ann.train(m)
    q = m.select("id", "vector").toDF("query_id", "query")
    found = ann.search_many(ann.assign(m, c), c, q, 5, 6)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, arms.dense_many(m, q, 5, 6).collect()))


TEXTS = [(1, 1, "Running runs 北京大学 license, licensed."), (2, 1, "dying die ran runner the LICENSE"), (3, 1, ""), (4, 2, "conditional condition 大学 ability able abilities"), (5, 2, None), (6, 2, "ＧＰＴ gpt skies sky x_1")]


def test_texts_are_scored_in_one_pass_as_from_postings(spark):
    m = spark.createDataFrame(TEXTS, "id long, memory_type int, text string").select("id", "memory_type", "text")
    for stem, terms in ((False, ["license", "gpt", "sky", "die"]), (True, ["run", "licens", "condit", "abl", "die", "sky", "gpt"])):
        for predicate in (None, F.col("id") != 1):
            allowed = None if predicate is None else m.where(predicate)
            want = arms.bm25_from(arms.postings(m, stem), arms.text_totals(m, stem), terms, 3, allowed, digits=6)
            got = arms.bm25(m, terms, 3, predicate, digits=6, stem=stem)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
            assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()  # no row a word
    query = query_terms("license 大学 gpt 使用 x_1")
    want = arms.bm25_fields(arms.field_postings(m), arms.field_totals(m), query, 5, digits=6)
    assert sorted(map(tuple, arms.bm25_texts(m, query, 5, digits=6).collect())) == sorted(map(tuple, want.collect())) != []
    assert arms.bm25(m, []).count() == 0


def test_a_word_begins_like_its_stem():
    """What lets a search stem only the words that begin like a term."""
    from anamnesis.functions.stem import STEP_2, STEP_3, STEP_4, WHOLE, stem

    ends = [a for a, _ in (*STEP_2, *STEP_3)] + list(STEP_4) + ["ing", "ed", "ingly", "eedly", "ied", "ies", "s", "y", "e", "biliti", "bility", "ization", "ly", ""]
    for head in ("a", "y", "say", "rel", "comb", "gener", "activ", "hopp", "sensi", "x", "oper", "ob", "fl", "vale"):
        for one in ends:
            for two in ends:
                w = head + one + two
                s = stem(w)
                assert w in WHOLE or w.startswith(s[: max(1, len(s) - 3)])


def test_document_frequencies_are_those_of_the_postings(spark):
    m = spark.createDataFrame(TEXTS, "id long, memory_type int, text string")
    want = arms.postings(m).groupBy("memory_type", "term").agg(F.count("*").alias("df"))
    got = arms.document_frequencies(m)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "dl" not in got._jdf.queryExecution().executedPlan().toString()  # no posting travels


def test_a_request_derives_the_edges_of_its_rows_only(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, 1 + i % 2, i // 20, [float(a) for a in rng.normal(size=6)], [], "") for i in range(1500)]
    m = spark.createDataFrame(rows, "id long, memory_type int, batch long, vector array<double>, causal_out array<struct<target:long,link_type:string,weight:double>>, text string")
    m.write.parquet(f"{tmp_path}/memories")
    ids = [3, 40, 701, 1499]
    want = {(r.src, r.dst, r.weight) for r in links.derive_links(m, 0.2, digits=6).collect() if r.src in ids or r.dst in ids}
    got = [(r.src, r.dst, r.weight) for r in Rows(spark, str(tmp_path), 0.2, 6).edges_of(m.where(F.col("id").isin(ids))).collect()]
    assert set(got) == want and len(got) == len(want) and any(d in ids for _, d, _ in got)
