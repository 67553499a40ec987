"""The live view: an ordered log of operations folded into current rows.

Log columns: seq, op_index, kind ('upsert', 'patch', 'tombstone',
'tombstone_where', 'guard'), id, the record's fields for upserts, and for patches
the deltas: proof_delta, set_tags, set_text, set_vector, set_entity_ids,
merge_metadata, set_times (a struct that replaces all times, absent ones too),
merge_* times, touch.  A tombstone_where has its predicate as JSON in the column
predicate.  Patches apply in order to the live version (absent or deleted: no
effect); a predicate at S deletes what matches then and has write_seq < S; a
guard has done its work when its entry was committed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import schema as S
from ..operators.predicates import Predicate

TIMES = ("occurred_start", "occurred_end", "mentioned_at", "event_at")
KEYED = ("upsert", "tombstone", "patch")
MOST_PREDICATES = 256


def latest(log: DataFrame, as_of: int | None = None) -> DataFrame:
    """Last writer wins over upserts and tombstones: the fast path, one shuffle on id."""
    ops = log.where(F.col("kind").isin("upsert", "tombstone"))
    if as_of is not None:
        ops = ops.where(F.col("seq") <= as_of)
    order = Window.partitionBy("id").orderBy(F.desc("seq"), F.desc("op_index"))
    return ops.withColumn("__r", F.row_number().over(order)).where("__r = 1 AND kind = 'upsert'").drop("__r", "kind", "op_index").withColumnRenamed("seq", "write_seq")


def promoted(fields: dict[str, Column]) -> dict[str, Column]:
    """Sets of entities sorted and metadata in the order of its keys, as stored."""
    if "entity_ids" in fields:
        fields["entity_ids"] = F.array_sort(F.array_distinct(fields["entity_ids"]))
    if "metadata" in fields:
        fields["metadata"] = F.map_from_entries(F.array_sort(F.map_entries(fields["metadata"])))
    return fields


def predicates_of(log: DataFrame, as_of: int | None = None) -> dict[int, list[Predicate]]:
    """Predicate deletes of the log by seq.  They become part of the plan, so there may be MOST_PREDICATES at most: fold more often else."""
    if "predicate" not in log.columns:
        return {}
    rows = log.where("kind = 'tombstone_where' AND predicate IS NOT NULL")
    if as_of is not None:
        rows = rows.where(F.col("seq") <= as_of)
    out: dict[int, list[Predicate]] = {}
    found = rows.select("seq", "predicate").distinct().limit(MOST_PREDICATES + 1).collect()
    if len(found) > MOST_PREDICATES:
        raise ValueError(f"more than {MOST_PREDICATES} predicate deletes that are not folded")
    for r in sorted(found):
        out.setdefault(r.seq, []).append(Predicate.from_json(r.predicate))
    return out


def squash(log: DataFrame) -> DataFrame:
    """The log without what can have no effect any more: operations on an id before its last upsert or tombstone.

    Patches of a base that is elsewhere stay, and so do predicate deletes: folding this gives what folding the log does,
    also together with earlier and later parts.
    """
    order = F.struct("seq", "op_index")
    reset = F.max(F.when(F.col("kind").isin("upsert", "tombstone"), order)).over(Window.partitionBy("id"))
    keyed = log.where(F.col("kind").isin(*KEYED)).withColumn("__reset", reset)
    kept = keyed.where(F.col("__reset").isNull() | (order >= F.col("__reset"))).drop("__reset")
    return kept.union(log.where("kind = 'tombstone_where'").select(*kept.columns))


def as_log(snapshot: DataFrame) -> DataFrame:
    """Folded rows as the upserts that made them, so that a later part of the log can be folded on top."""
    return snapshot.withColumnRenamed("write_seq", "seq").withColumn("op_index", F.lit(-1)).withColumn("kind", F.lit("upsert"))


def with_tail(snapshot: DataFrame, tail: DataFrame, as_of: int | None = None) -> DataFrame:
    """Read-your-writes: rows folded through some seq, with the operations after it: upserts, tombstones, patches and predicate deletes."""
    rows = as_log(snapshot)
    return live(rows.unionByName(tail, allowMissingColumns=True), as_of=as_of).select(*snapshot.columns)


def fold_proof_count(start: int, deltas: list[int]) -> int:
    """Sum of all deltas, clamped once at the end (a fold in order clamps after each)."""
    return max(0, min(S.MAX_PROOF, start + sum(deltas)))


def live(log: DataFrame, predicates: dict[int, Predicate] | None = None, as_of: int | None = None) -> DataFrame:
    """Current rows.  Per id only the operations since its last upsert or tombstone are gathered and folded, JVM-side.

    Predicate deletes, of the log and given ones by seq, are few and compiled into columns.
    """
    given: dict[int, list[Predicate]] = predicates_of(log, as_of)
    for s, p in (predicates or {}).items():
        if as_of is None or s <= as_of:
            given.setdefault(s, []).append(p)
    ops = log.where(F.col("kind").isin("upsert", "tombstone", "patch"))
    if as_of is not None:
        ops = ops.where(F.col("seq") <= as_of)
    base = [c for c in log.columns if c in (*S.FIELDS, "batch") and c not in ("id", "write_seq")]
    types = {f.name: f.dataType for f in log.schema.fields}
    order = F.struct("seq", "op_index")
    reset = F.max(F.when(F.col("kind") != "patch", order)).over(Window.partitionBy("id"))
    since = ops.withColumn("__reset", reset).where((order >= F.col("__reset"))).drop("__reset")

    def earlier(a: Column, b: Column) -> Column:
        before = (a["seq"] < b["seq"]) | ((a["seq"] == b["seq"]) & (a["op_index"] < b["op_index"]))
        return F.when(before, -1).when((a["seq"] == b["seq"]) & (a["op_index"] == b["op_index"]), 0).otherwise(1)

    gathered = F.collect_list(F.struct("seq", "op_index", *(c for c in log.columns if c not in ("seq", "op_index", "id"))))
    events = since.groupBy("id").agg(F.array_sort(gathered, earlier).alias("ops"))
    state = F.struct(F.lit(False).alias("alive"), F.lit(None).cast("long").alias("write_seq"), *(F.lit(None).cast(types[c]).alias(c) for c in base))
    has = set(log.columns)

    def patched(s: Column, op: Column, c: str) -> Column:
        old = s[c]
        if c == "proof_count" and "proof_delta" in has:
            return F.greatest(F.lit(0), F.least(F.lit(S.MAX_PROOF), F.coalesce(old, F.lit(0)) + F.coalesce(op["proof_delta"], F.lit(0)))).cast(types[c])
        if c == "metadata" and "merge_metadata" in has:
            new = op["merge_metadata"]
            kept = F.map_filter(old, lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
            return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(F.map_concat(kept, new))
        if c == "updated_at" and "touch" in has:
            return F.coalesce(op["touch"], old)
        if c in TIMES and "set_times" in has:
            old = F.when(op["set_times"].isNotNull(), op["set_times"][c]).otherwise(old)
        for name in (f"set_{c}", f"merge_{c}"):
            if name in has:
                return F.coalesce(op[name], old)
        return old

    def step(s: Column, op: Column) -> Column:
        up, down = op["kind"] == "upsert", op["kind"] == "tombstone"
        new = promoted({c: op[c] for c in base})
        fields = [F.when(up, new[c]).when(s["alive"], patched(s, op, c)).otherwise(s[c]).alias(c) for c in base]
        return F.struct(F.when(up, True).when(down, False).otherwise(s["alive"]).alias("alive"), F.when(up, op["seq"]).otherwise(s["write_seq"]).cast("long").alias("write_seq"), *fields)

    def upto(ops_: Column, seq: int | None, after: int | None) -> Column:
        return F.filter(ops_, lambda o: (F.lit(True) if seq is None else o["seq"] <= seq) & (F.lit(True) if after is None else o["seq"] > after))

    cuts = sorted(given)
    folded = events.withColumn("s", state)
    before: int | None = None
    for cut in [*cuts, None]:
        folded = folded.withColumn("s", F.aggregate(upto(F.col("ops"), cut, before), F.col("s"), step))
        if cut is not None:
            flat = folded.select("id", "ops", "s", *(F.col(f"s.{c}").alias(c) for c in base))
            hit = F.lit(False)
            for p in given[cut]:
                hit = hit | F.coalesce(p.column(), F.lit(False))
            alive = F.col("s.alive") & ~(hit & F.coalesce(F.col("s.write_seq") < cut, F.lit(False)))
            folded = flat.select("id", "ops", F.struct(alive.alias("alive"), F.col("s.write_seq").alias("write_seq"), *(F.col(c) for c in base)).alias("s"))
        before = cut
    return folded.where("s.alive").select("id", "s.write_seq", *(F.col(f"s.{c}") for c in base))
