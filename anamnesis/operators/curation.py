"""Consolidation queue, observations and archive moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .predicates import Predicate, require_constraint, tag_filter


def unconsolidated(m: DataFrame, limit: int, tags: list[str] | None = None) -> DataFrame:
    """Oldest first, flag "0", within the tag scope."""
    return m.where((F.col("metadata")["consolidated"] == "0") & tag_filter(tags or [], "all") & F.col("updated_at").isNotNull()).orderBy("updated_at", "id").limit(limit)


def failed(m: DataFrame) -> DataFrame:
    return m.where(F.col("metadata")["consolidated"] == "2")


def mark(ids: DataFrame, flag: str) -> DataFrame:
    """Patch operations that set the flag."""
    return ids.select("id", F.lit("patch").alias("kind"), F.create_map(F.lit("consolidated"), F.lit(flag)).alias("merge_metadata"))


def _sources(m: DataFrame) -> DataFrame:
    keys = F.filter(F.map_keys("metadata"), lambda k: k.startswith("src:"))
    return m.select("id", F.explode(keys).alias("k")).select("id", F.substring("k", 5, 1 << 20).alias("source"))


def observations_for(m: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows that name one of the sources in their metadata (src:<id>), once each."""
    hit = _sources(m).join(sources.select(F.col("id").cast("string").alias("source")), "source", "left_semi").select("id").distinct()
    return m.join(hit, "id", "left_semi")


def requeue(stale: DataFrame, deleted: DataFrame) -> DataFrame:
    """Patches that put the surviving sources of stale observations back into the queue."""
    left = _sources(stale).select(F.col("source").alias("id")).distinct().join(deleted.select(F.col("id").cast("string").alias("id")), "id", "left_anti")
    return mark(left, "0")


def inherited_entities(m: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, entity_ids): distinct entities of an observation's sources (id, pos, source), in the order in which they are first seen."""
    own = m.select(F.col("id").cast("string").alias("source"), "entity_ids")
    seen = sources.select("id", "pos", F.col("source").cast("string").alias("source")).join(own, "source").select("id", "pos", F.posexplode("entity_ids").alias("i", "e"))
    first = seen.groupBy("id", "e").agg(F.min(F.struct("pos", "i")).alias("at"))
    return first.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "e"))), lambda x: x["e"]).alias("entity_ids"))


def invalidate(live: DataFrame, archive: DataFrame, which: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """(live, archive) after the rows moved; restore is the same the other way round."""
    moved = live.where(which).withColumn("reason", F.lit(reason))
    return live.where(~F.coalesce(which, F.lit(False))), archive.unionByName(moved, allowMissingColumns=True)


def restore(live: DataFrame, archive: DataFrame, which: Column) -> tuple[DataFrame, DataFrame]:
    """(live, archive) after archived rows came back, without their reason."""
    moved = archive.where(which).drop("reason")
    return live.unionByName(moved, allowMissingColumns=True), archive.where(~F.coalesce(which, F.lit(False)))


def set_reason(archive: DataFrame, which: Column, reason: str) -> DataFrame:
    return archive.withColumn("reason", F.when(which, F.lit(reason)).otherwise(F.col("reason")))


# --- operations for the log ---


def insert_facts(facts: DataFrame) -> DataFrame:
    """Upserts of facts (id, text, text_signals and other fields): what is indexed is the text and its signals."""
    signals = F.coalesce("text_signals", F.lit("")) if "text_signals" in facts.columns else F.lit("")
    indexed = F.when(signals == "", F.lit("")).otherwise(F.concat(F.col("text"), F.lit(" "), signals))
    return facts.withColumn("index_text", indexed).drop("text_signals").withColumn("kind", F.lit("upsert"))


def _upserts(rows: DataFrame) -> DataFrame:
    return rows.drop("write_seq").withColumn("kind", F.lit("upsert"))


def record_entities(live: DataFrame, pairs: DataFrame) -> DataFrame:
    """Upserts of rows with entities added: pairs are (id, entity)."""
    more = pairs.groupBy("id").agg(F.collect_set("entity").alias("more"))
    rows = live.join(more, "id").withColumn("entity_ids", F.array_sort(F.array_distinct(F.concat("entity_ids", F.col("more").cast(live.schema["entity_ids"].dataType))))).drop("more")
    return _upserts(rows.select(*live.columns))


def updates(changes: DataFrame, now_ms: int) -> DataFrame:
    """Patches (id and any of the delta columns), each ending in a touch."""
    return changes.withColumn("touch", F.lit(now_ms).cast("long")).withColumn("kind", F.lit("patch"))


def set_embedding(ids: DataFrame, vector: list[float], now_ms: int) -> DataFrame:
    return updates(ids.select("id", F.array(*(F.lit(float(x)) for x in vector)).alias("set_vector")), now_ms)


def apply_edit(live: DataFrame, which: Column, text: str, vector: list[float] | None, now_ms: int) -> DataFrame:
    """Upserts that rewrite rows: new text and vector, and consolidation to be done again."""
    rows = live.where(which).withColumn("text", F.lit(text)).withColumn("updated_at", F.lit(now_ms).cast("long"))
    if vector is not None:
        rows = rows.withColumn("vector", F.array(*(F.lit(float(x)) for x in vector)).cast(live.schema["vector"].dataType))
    kept = F.map_filter("metadata", lambda k, _: k != "consolidated")
    return _upserts(rows.withColumn("metadata", F.map_concat(kept, F.create_map(F.lit("consolidated"), F.lit("0")))))


def tombstones(ids: DataFrame) -> DataFrame:
    return ids.select("id", F.lit("tombstone").alias("kind")).distinct()


def delete_where(spark, predicate: Predicate, delete_all: bool = False) -> DataFrame:  # type: ignore[no-untyped-def]
    """One lazy predicate delete; an empty predicate needs delete_all."""
    require_constraint(predicate, delete_all)
    return spark.createDataFrame([("tombstone_where", predicate.to_json())], "kind string, predicate string")


def delete_document(spark, document_id: str) -> DataFrame:  # type: ignore[no-untyped-def]
    return delete_where(spark, Predicate(metadata_equals={"document_id": document_id}))


def delete_stale(observations: DataFrame, deleted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tombstones of the observations that name a deleted source, patches that put their other sources back into the queue)."""
    stale = observations_for(observations, deleted)
    return tombstones(stale), requeue(stale, deleted)


def upsert_observation(row: DataFrame, sources: DataFrame, m: DataFrame) -> DataFrame:
    """Upsert of observations that name their sources (id, pos, source) in the metadata and inherit their entities."""
    named = sources.groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct(F.concat(F.lit("src:"), F.col("source").cast("string")), F.lit("1")))).alias("names"))
    full = row.join(named, "id").join(inherited_entities(m, sources).withColumnRenamed("entity_ids", "inherited"), "id", "left")
    own = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    return _upserts(full.withColumn("metadata", F.map_concat(own, "names")).withColumn("entity_ids", F.coalesce("inherited", F.array().cast(m.schema["entity_ids"].dataType))).drop("names", "inherited"))


STATES = {"done": "1", "pending": "0", "failed": "2"}


def list_units(m: DataFrame, limit: int, offset: int = 0, state: str | None = None, predicate: Column | None = None) -> DataFrame:
    """A filtered page, newest first, of what a list shows: id, text, memory_type, tags, updated_at, state."""
    rows = m if predicate is None else m.where(predicate)
    flag = F.col("metadata")["consolidated"]
    if state is not None:
        rows = rows.where(flag == STATES[state])
    shown = F.coalesce(*(F.when(flag == v, F.lit(k)) for k, v in STATES.items())).alias("state")
    return rows.orderBy(F.desc_nulls_last("updated_at"), "id").offset(offset).limit(limit).select("id", "text", "memory_type", "tags", "updated_at", shown)


def unit(m: DataFrame, key) -> DataFrame:  # type: ignore[no-untyped-def]
    """One row, with its edges, by its id."""
    return m.where(F.col("id") == key).drop("vector")


def graph_units(m: DataFrame, limit: int, predicate: Column | None = None) -> DataFrame:
    """Nodes of a graph view, the first by id."""
    rows = m if predicate is None else m.where(predicate)
    return rows.orderBy("id").limit(limit).select("id", "memory_type", "text", "entity_ids")


def graph_entity_rows(nodes: DataFrame) -> DataFrame:
    """(id, entity) of the nodes."""
    return nodes.select("id", F.explode("entity_ids").alias("entity"))


def latest_by(m: DataFrame, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("updated_at"), "id")
    return m.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
