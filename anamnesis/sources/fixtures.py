"""Memories and an operation log derived from the provided tables, in Spark and as SQL."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch

BASE = 1_704_067_200_000
HOUR = 3_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    e = table(spark, sf_dir, "embeddings")
    j = d.join(e, d["doc_id"] == e["vec_id"], "full")
    i = F.coalesce("doc_id", "vec_id")

    def unless(n: int, value: Column) -> Column:
        return F.when(i % n != 0, value)

    start = unless(6, BASE + i * HOUR)
    kinds = F.array(*map(F.lit, ("CAUSES", "CAUSED_BY", "ENABLES", "PREVENTS")))
    edge = F.struct((i - 3).alias("target"), F.element_at(kinds, ((F.floor(i / 10) % 4) + 1).cast("int")).alias("link_type"), F.lit(0.75).alias("weight"))
    no_edge = F.array().cast("array<struct<target:bigint,link_type:string,weight:double>>")
    entities = F.array_compact(F.array(i % 7, i % 11 + 100, F.when(i % 2 == 0, i % 13 + 200)))
    return j.select(
        i.alias("id"), F.col("embedding").alias("vector"), F.coalesce("text", F.lit("")).alias("text"), (F.coalesce("label", i) % 3 + 1).cast("int").alias("memory_type"),
        F.when((i % 5 == 0) | F.col("lang").isNull(), F.array().cast("array<string>")).otherwise(F.array("lang", "source")).alias("tags"),
        F.array_sort(F.array_distinct(entities)).alias("entity_ids"), start.alias("occurred_start"), F.when(i % 2 == 1, start + 2 * HOUR).alias("occurred_end"),
        unless(4, BASE + i * (HOUR // 2)).alias("mentioned_at"), unless(17, BASE + i * 60_000).alias("updated_at"), (i % 4).alias("proof_count"),
        F.when(i % 10 == 3, F.array(edge)).otherwise(no_edge).alias("causal_out"),
        F.create_map(F.lit("document_id"), F.concat(F.lit("d"), (i % 50).cast("string")), F.lit("consolidated"), (i % 3).cast("string"), F.lit("src"), F.coalesce("source", F.lit("none"))).alias("metadata"),
        (F.floor(i / 20) + 1).alias("batch"),
    )


MEMORIES_SQL = f"""
WITH j AS (SELECT coalesce(doc_id, vec_id) AS id, embedding::DOUBLE[] AS vector, coalesce(text, '') AS text, lang, source, label FROM documents FULL JOIN embeddings ON doc_id = vec_id),
m0 AS (SELECT id, vector, text, (coalesce(label, id) % 3 + 1)::INT AS memory_type, source,
  CASE WHEN id % 5 = 0 OR lang IS NULL THEN []::VARCHAR[] ELSE [lang, source] END AS tags,
  list_sort(list_distinct(CASE WHEN id % 2 = 0 THEN [id % 7, id % 11 + 100, id % 13 + 200] ELSE [id % 7, id % 11 + 100] END)) AS entity_ids,
  CASE WHEN id % 6 <> 0 THEN {BASE} + id * {HOUR} END AS occurred_start,
  CASE WHEN id % 4 <> 0 THEN {BASE} + id * {HOUR // 2} END AS mentioned_at,
  CASE WHEN id % 17 <> 0 THEN {BASE} + id * 60000 END AS updated_at, id % 4 AS proof_count,
  'd' || (id % 50) AS document_id, (id % 3)::VARCHAR AS consolidated, id // 20 + 1 AS batch FROM j),
m1 AS (SELECT *, CASE WHEN id % 2 = 1 THEN occurred_start + {2 * HOUR} END AS occurred_end FROM m0),
m AS (SELECT *, coalesce(occurred_start, mentioned_at, occurred_end) AS effective_ts,
  coalesce(occurred_start + (occurred_end - occurred_start) // 2, occurred_start, occurred_end, mentioned_at) AS best_date FROM m1),
causal AS (SELECT memory_type, id AS src, id - 3 AS dst, 'causal' AS kind, ['CAUSES', 'CAUSED_BY', 'ENABLES', 'PREVENTS'][(id // 10) % 4 + 1] AS link_type, 0.75 AS weight FROM m WHERE id % 10 = 3),
q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0)
"""


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first().embedding)


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as operations on users: view and signup upsert, click patches, purchase tags, error deletes; eight to an entry.

    The order is that of (ts, event_id).  Numbering all rows needs one order over the whole table: it is a fixture's
    job, done by a range sort and offsets per partition rather than by one task.  The sorted rows are written with
    their places: ranges come from a sample and merge by size, so a second run of the sort may cut elsewhere.
    """
    order = (F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))
    e = table(spark, sf_dir, "events").repartitionByRange(*order).sortWithinPartitions(*order)
    path = scratch(spark, "events")
    e.withColumn("__m", F.monotonically_increasing_id()).write.parquet(path)  # partition << 33 | place in it
    e = spark.read.parquet(path)
    part, place = F.shiftright("__m", 33).cast("int"), F.col("__m").bitwiseAND((1 << 33) - 1)
    counts = dict(e.groupBy(part.alias("p")).agg(F.max(place) + 1).collect())
    before = list(accumulate((counts.get(p, 0) for p in range(max(counts, default=0))), initial=0))
    n = F.array(*(F.lit(x).cast("long") for x in before))[part] + place
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    up = kind.isin("view", "signup")
    return e.select(
        (F.floor(n / 8) + 1).alias("seq"), (n % 8).cast("int").alias("op_index"),
        F.when(up, "upsert").when(kind == "error", "tombstone").otherwise("patch").alias("kind"), F.col("user_id").alias("id"),
        F.when(up, F.col("value")).alias("value"), F.when(up, F.create_map(F.lit("k"), k)).alias("metadata"), F.when(up, F.lit(0).cast("long")).alias("proof_count"),
        F.when(up, F.array().cast("array<string>")).alias("tags"), F.when(kind == "click", F.lit(1).cast("long")).alias("proof_delta"),
        F.when(kind == "click", F.create_map(F.lit("k"), k)).alias("merge_metadata"), F.when(kind == "purchase", F.array(F.lit("buyer"))).alias("set_tags"),
    )


OPS_SQL = """
WITH o0 AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS n, CASE WHEN event_type IN ('view', 'signup') THEN 'upsert' WHEN event_type = 'error' THEN 'tombstone' ELSE 'patch' END AS kind FROM events),
ops AS (SELECT n // 8 + 1 AS seq, n % 8 AS op_index, n, kind, event_type, user_id AS id, value, json_extract_string(props, '$.k') AS k FROM o0)
"""
