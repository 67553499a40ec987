import numpy as np

from anamnesis.operators import ann, arms
from anamnesis.plans import catalog

from .compare import SF


def test_every_row_is_a_query_with_full_recall(spark):
    rows = catalog.QUERIES["ann_recall"](spark, SF).collect()
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    auto = [r.recall for r in rows if r.nprobe == "auto"]
    assert len(auto) == n == sum(r.nprobe == "all" for r in rows)
    assert np.mean(auto) >= 0.9 and min(auto) >= 0.9


def test_bound_leaves_clusters_out_and_misses_nothing(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16)) * 4
    x = np.concatenate([c + rng.normal(size=(15, 16)) * 0.3 for c in centres] + [np.zeros((2, 16))])
    m = spark.createDataFrame([(i, 1 + i % 2, [float(a) for a in v]) for i, v in enumerate(x)], "id long, memory_type int, vector array<double>")
    c = ann.train(m)
    q = m.select("id", "vector").toDF("query_id", "query")
    key = lambda r: (r.query_id, r.memory_type, r["rank"], r.id, r.score)
    assert sorted(map(key, ann.search_many(ann.assign(m, c), c, q, 5, 6).collect())) == sorted(map(key, arms.dense_many(m, q, 5, 6).collect()))
    one = [(r.id, r["rank"], r.score) for r in ann.search(ann.assign(m, c), c, list(x[3]), 5, digits=6).collect()]
    assert sorted(one) == sorted((r.id, r["rank"], r.score) for r in arms.dense(m, list(x[3]), 5, digits=6).collect())
