import time

import pytest
from pyspark.sql import functions as F

from anamnesis.client import Client
from anamnesis.operators.predicates import Predicate
from anamnesis.plans.requests import Request
from anamnesis.sources import synthetic, traces
from anamnesis.sources.log import Log
from anamnesis.streaming.trickle import trickle


def test_a_namespace_from_writes_to_answers(spark, tmp_path):
    c = Client(spark, str(tmp_path))
    assert c.create_namespace("bank", ("src",)) and not c.create_namespace("bank") and c.list_namespaces() == ["bank"]
    m = synthetic.memories(spark, 120, 8).drop("batch").withColumn("id", F.concat(F.lit("m"), F.lpad(F.col("id").cast("string"), 3, "0")))
    edges = F.transform("causal_out", lambda e: F.struct(F.concat(F.lit("m"), F.lpad(e["target"].cast("string"), 3, "0")).alias("target"), e["link_type"].alias("link_type"), e["weight"].alias("weight")))
    ops = m.withColumn("causal_out", edges).withColumn("kind", F.lit("upsert"))
    assert c.write("bank", ops, wait_for_index=True) == 1
    rows = c.query("bank", Request(synthetic.query_vector(120, 8), "topic1 memory", start=0, end=60_000)).collect()
    assert {r.memory_type for r in rows} == {1, 2, 3} and all(r.text.startswith("memory") for r in rows)
    assert any(r.dense_score is not None for r in rows) and any(r.text_score is not None for r in rows) and any(r.temporal_score is not None for r in rows)
    assert c.write("bank", spark.createDataFrame([("patch", "m001", 4)], "kind string, id string, proof_delta long")) == 2
    assert c.delete_by_predicate("bank", Predicate(metadata_equals={"src": "s3"})) == 3 and c.delete_by_predicate("bank", Predicate(metadata_equals={"src": "s4"}), eager=True) == 4
    assert c.get("bank", ["m001", "m003"]).collect()[0].proof_count == 4 and c.get("bank", ["m003"]).count() == 0
    left = [i for i in range(120) if i % 7 not in (3, 4)]
    s = c.stats("bank")
    assert s["doc_count"] == len(left) and s["backlog"] == 3 and s["has_index"] and s["wal_head"] == 4
    assert [r.id for r in c.scan("bank", 5).collect()] == [f"m{i:03d}" for i in left if i % 3 == 0][:5]
    assert {r.value for r in c.metadata_stats("bank", "src").collect()} == {f"s{k}" for k in (0, 1, 2, 5, 6)} and c.metadata_stats("bank", "document_id").count() == 0
    assert c.list_wal("bank").count() == 4 and c.entity_stats("bank").count() > 0 and c.link_stats("bank").count() > 0
    before = {r.id for r in c.view("bank").collect()}
    c.refresh("bank")
    assert {r.id for r in c.view("bank").collect()} == before == {r.id for r in c.index("bank").memories.collect()}
    assert c.list_objects("bank").where("live").count() > 0 and isinstance(c.cache_stats(), list)
    assert c.delete_namespace("bank") > 0 and c.list_namespaces() == []
    with pytest.raises(ValueError):
        c.delete_by_predicate("bank", Predicate())


def test_made_up_memories_depend_on_seed_and_id_only(spark):
    a, b = synthetic.memories(spark, 30, 4), synthetic.memories(spark, 30, 4).repartition(7)
    key = lambda df: sorted(((r.id, tuple(r.vector), tuple(r.tags), r.text) for r in df.collect()))
    assert key(a) == key(b) and all(r.target < i for i, e in ((r.id, r.causal_out) for r in a.collect()) for r in e)


def test_traces(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:30:00", "n1", "bank", "query", 2.0 * h, h != 2, None) for h in (1, 2, 3)]
    t = spark.createDataFrame(rows, traces.SCHEMA.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts"))
    traces.write(t, f"{tmp_path}/t")
    assert traces.read(spark, f"{tmp_path}/t", since="2024-01-01-02", namespace="bank").count() == 2 and traces.read(spark, f"{tmp_path}/t", node="n2").count() == 0
    assert traces.expire(spark, f"{tmp_path}/t", "2024-01-01-02") == 1 and traces.read(spark, f"{tmp_path}/t").count() == 2


def test_trickle(spark, tmp_path):
    log = Log(spark, str(tmp_path), "drip")
    q = trickle(spark, log, f"{tmp_path}/cp", 20)
    end = time.time() + 60
    while time.time() < end and not log.listed():
        time.sleep(1)
    q.stop()
    assert log.listed() and log.view().count() > 0
