"""Counting and curation analytics on the live view; counts are exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import schema as S
from ..functions.scores import effective_ts


def type_stats(m: DataFrame) -> DataFrame:
    return m.groupBy("memory_type").agg(F.count("*").alias("doc_count"))


def entity_stats(m: DataFrame, ids: list | None = None) -> DataFrame:
    out = m.select(F.explode("entity_ids").alias("entity"))
    if ids:
        out = out.where(F.col("entity").isin(*ids))
    return out.groupBy("entity").agg(F.count("*").alias("n"))


def shared_entities(m: DataFrame, entities: list) -> DataFrame:
    """(id, n): how many of the entities each row has."""
    wanted = F.array(*map(F.lit, entities)).cast(m.schema["entity_ids"].dataType)
    return m.select("id", F.size(F.array_intersect("entity_ids", wanted)).cast("long").alias("n"))


def entity_link_total(m: DataFrame) -> DataFrame:
    """Sum over entities of min(n - 1, 10), for n > 1."""
    n = entity_stats(m).where("n > 1")
    return n.agg(F.coalesce(F.sum(F.least(F.col("n") - 1, F.lit(S.ENTITY_LINK_CAP))), F.lit(0)).cast("long").alias("total"))


def metadata_stats(m: DataFrame, key: str, declared: list[str]) -> DataFrame:
    """Rows per value of a declared key; an undeclared one gives nothing."""
    rows = m.where(F.map_contains_key("metadata", key)) if key in declared else m.where(F.lit(False))
    return rows.groupBy(F.col("metadata")[key].alias("value")).agg(F.count("*").alias("n"))


def temporal_links(m: DataFrame) -> DataFrame:
    """Sum of min(others within a day, 20) over all types together.

    Counts by hour bucket would not be exact, so distinct times are counted first and the range window runs over
    days: each day with the two beside it, so no single task sees the whole table.
    """
    ts = m.select(effective_ts().alias("ts")).where("ts IS NOT NULL").groupBy("ts").agg(F.count("*").alias("n"))
    day = F.floor(F.col("ts") / S.SPREAD_MS)
    spread = ts.select("ts", "n", day.alias("own"), F.explode(F.array(day - 1, day, day + 1)).alias("day"))
    w = Window.partitionBy("day").orderBy("ts").rangeBetween(-S.SPREAD_MS, S.SPREAD_MS)
    counted = spread.withColumn("c", F.sum("n").over(w)).where("day = own")
    return counted.agg(F.coalesce(F.sum(F.col("n") * F.least(F.col("c") - 1, F.lit(S.MAX_TEMPORAL_LINKS))), F.lit(0)).cast("long").alias("total"))


def link_stats(edges: DataFrame) -> DataFrame:
    """Links by kind, causal and semantic."""
    return edges.groupBy("kind").agg(F.count("*").alias("n"))


def tag_facet(m: DataFrame) -> DataFrame:
    return m.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def scope_counts(m: DataFrame) -> DataFrame:
    return m.groupBy(F.array_join(F.array_sort("tags"), ",").alias("scope")).agg(F.count("*").alias("n"))


def timeseries(m: DataFrame, field: str, unit: str = "day", since: int | None = None, fallback: str = "updated_at") -> DataFrame:
    """Rows by bucket of UTC time and type; a null time falls back."""
    ts = F.coalesce(field, fallback)
    rows = m.select("memory_type", ts.alias("ts")).where("ts IS NOT NULL")
    if since is not None:
        rows = rows.where(F.col("ts") >= since)
    bucket = F.unix_millis(F.date_trunc(unit, F.timestamp_millis("ts")))
    return rows.groupBy(bucket.alias("bucket"), "memory_type").agg(F.count("*").alias("n"))


def list_total(m: DataFrame, predicate: Column | None = None) -> DataFrame:
    """The total of a filtered list, whatever its page."""
    return (m if predicate is None else m.where(predicate)).agg(F.count("*").alias("total"))


def timestamp_counts(m: DataFrame) -> DataFrame:
    """(memory_type, ts, n): rows at each effective time."""
    return m.select("memory_type", effective_ts().alias("ts")).where("ts IS NOT NULL").groupBy("memory_type", "ts").agg(F.count("*").alias("n"))


def times_after(m: DataFrame, ts: int, most: int) -> DataFrame:
    """The oldest rows at or after a time, most a type at most."""
    w = Window.partitionBy("memory_type").orderBy("ts", "id")
    rows = m.select("memory_type", "id", effective_ts().alias("ts")).where(F.col("ts") >= ts)
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")


def existing(m: DataFrame, ids: list) -> DataFrame:
    """Which of the ids there are."""
    return m.where(F.col("id").isin(*ids)).select("id")


def names_like(registry: DataFrame, needle: str) -> DataFrame:
    """Registry rows whose name holds the text, whatever its case; % and _ stand for themselves."""
    plain = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return registry.where(F.col("name").ilike(f"%{plain}%"))


def trace_rollup(traces: DataFrame) -> DataFrame:
    """Requests, errors and latency of traces (ts, namespace, op, ms, ok) by hour, namespace and kind."""
    return traces.groupBy(F.date_format("ts", "yyyy-MM-dd-HH").alias("hour"), "namespace", "op").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("errors"), F.sum("ms").alias("total_ms"), F.max("ms").alias("max_ms"))


def freshness(m: DataFrame) -> DataFrame:
    """Pending ("0") and failed ("2") rows and the last consolidation."""
    c = F.col("metadata")["consolidated"]
    return m.agg(F.count_if(c == "0").alias("pending"), F.count_if(c == "2").alias("failed"), F.max(F.when(c == "1", F.coalesce("updated_at", "mentioned_at"))).alias("last"))


def document_counts(m: DataFrame) -> DataFrame:
    return m.groupBy(F.col("metadata")["document_id"].alias("document_id")).agg(F.count("*").alias("n"))


def entities_listed(registry: DataFrame, m: DataFrame) -> DataFrame:
    """Registry rows (entity, name) with their count, 0 where none."""
    return registry.join(entity_stats(m), "entity", "left").select("entity", "name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def orphans(registry: DataFrame, m: DataFrame) -> DataFrame:
    return registry.join(entity_stats(m), "entity", "left_anti")


def any_since(m: DataFrame, ts: int) -> DataFrame:
    """One row: whether any row was updated after ts."""
    return m.where(F.col("updated_at") > ts).limit(1).agg((F.count("*") > 0).alias("found"))


def search_text(m: DataFrame, needle: str) -> Column:
    """In the text or, where the metadata has one, the context."""
    text = F.col("text")
    if "metadata" in m.columns:
        text = F.concat(text, F.lit(" "), F.coalesce(F.col("metadata")["context"], F.lit("")))
    return F.contains(F.lower(text), F.lit(needle.lower()))


def layout(assigned: DataFrame) -> DataFrame:
    """Clusters of each type: size, tags, whether some row is untagged, range of updates."""
    return assigned.groupBy("memory_type", "cluster_id").agg(
        F.count("*").alias("size"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"), F.max(F.size("tags") == 0).alias("has_untagged"),
        F.min("updated_at").alias("updated_from"), F.max("updated_at").alias("updated_to"),
    )


def block_means(assigned: DataFrame) -> DataFrame:
    """(cluster_id, pos, mean): the mean vector of each cluster, a row per dimension."""
    rows = assigned.where("cluster_id IS NOT NULL").select("cluster_id", F.posexplode("vector").alias("pos", "x"))
    return rows.groupBy("cluster_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
