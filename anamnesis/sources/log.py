"""The operation log of a namespace: entries, manifest, folded segments.

Under ``root/<namespace>``: ``claims/<seq>`` (one empty file a number, created if
absent: of two writers one gets it), ``wal/<seq>`` (an entry's Parquet files,
moved there whole), ``manifests/<generation>.json`` (created if absent, so a
swap compares and sets), ``segments/<id>`` (folded parts), ``head`` (a hint).
A claim without entry is a gap; readers skip it.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .files import Files

_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")
ATTEMPTS = 32
SEGMENTS = 8
KINDS = ("upsert", "patch", "tombstone", "tombstone_where")


def check_namespace(name: str) -> str:
    """Names that begin with an underscore are reserved."""
    if not _NAME.fullmatch(name):
        raise ValueError(f"bad or reserved namespace {name!r}")
    return name


def minor_run_len(counts: list[int]) -> int:
    """How many of the newest segments (counts from the oldest to the newest) make the longest run that isn't larger than the one before it; 0 if fewer than two."""
    best = 0
    for n in range(2, len(counts)):
        if sum(counts[-n:]) <= counts[-n - 1]:
            best = n
    return best


class Log:
    def __init__(self, spark: SparkSession, root: str, namespace: str):
        self.spark, self.path, self.files = spark, f"{root.rstrip('/')}/{check_namespace(namespace)}", Files(spark)

    # --- manifest ---

    def create(self, declared: tuple[str, ...] = (), tokenizer: str = "") -> bool:
        """Pin the declared metadata keys and the tokenizer; False if the namespace is there already, whose pins stay."""
        first = {"generation": 0, "cursor": 0, "head": 0, "declared": sorted(declared), "tokenizer": tokenizer, "segments": [], "format": 1}
        return not self.exists() and self.files.put_if_absent(f"{self.path}/manifests/{0:020d}.json", json.dumps(first))

    def exists(self) -> bool:
        return bool(self.files.names(f"{self.path}/manifests"))

    def manifest(self, generation: int | None = None) -> dict:
        """The current one, or that of a generation; ValueError for a format that isn't known."""
        names = self.files.names(f"{self.path}/manifests")
        name = names[-1] if generation is None else f"{generation:020d}.json"
        out = json.loads(self.files.read(f"{self.path}/manifests/{name}"))
        if out["format"] != 1:
            raise ValueError(f"manifest format {out['format']}")
        return out

    def swap(self, expected: int, changes: dict) -> bool:
        """The next generation with the changes, if the current one is the expected; False if another was faster."""
        new = self.manifest(expected) | changes | {"generation": expected + 1}
        return self.files.put_if_absent(f"{self.path}/manifests/{expected + 1:020d}.json", json.dumps(new))

    # --- entries ---

    def listed(self) -> list[int]:
        return [int(n) for n in self.files.names(f"{self.path}/wal")]

    def head(self) -> int:
        """The last entry: of the log, or what a fold has recorded of it."""
        return max([0, *self.listed()[-1:], self.manifest()["head"] if self.exists() else 0])

    def next_seq(self) -> int:
        """Never a number that was used, even if the log was emptied or a claim has no entry."""
        return max([self.head(), *(int(n) for n in self.files.names(f"{self.path}/claims")[-1:])]) + 1

    def commit(self, ops: DataFrame, now_ms: int | None = None, expect_below: int | None = None) -> tuple[int, int]:
        """One atomic entry; its seq and the attempts to claim one.  expect_below is the guard: the entry is rejected if its seq reaches it."""
        self.create()
        for attempt in range(1, ATTEMPTS + 1):
            seq = self.next_seq()
            if expect_below is not None and seq >= expect_below:
                raise RuntimeError(f"guard failed: seq {seq} is not below {expect_below}")
            if self.files.put_if_absent(f"{self.path}/claims/{seq:020d}", ""):
                self._write(self._prepared(ops, now_ms), seq)
                return seq, attempt
        raise RuntimeError(f"no seq claimed in {ATTEMPTS} attempts")

    def append(self, ops: DataFrame, now_ms: int | None = None, expect_below: int | None = None) -> int:
        return self.commit(ops, now_ms, expect_below)[0]

    def commit_many(self, batches: list[DataFrame], now_ms: int | None = None) -> list[int]:
        """An entry for each batch that isn't empty, with contiguous seqs unless another writer is at work; no guards."""
        return [self.append(b, now_ms) for b in batches if not b.isEmpty()]

    def load(self, ops: DataFrame) -> int:
        """Entries whose seqs are given (an import into an empty log): one write, entries by directory; the last seq."""
        if self.head():
            raise RuntimeError("the log isn't empty")
        self.create()
        tmp = f"{self.path}/_tmp-{uuid.uuid4().hex}"
        ops.withColumn("entry", F.lpad(F.col("seq").cast("string"), 20, "0")).repartition("entry").write.partitionBy("entry").parquet(tmp)
        for name in self.files.names(tmp):
            if name.startswith("entry="):
                self.files.rename(f"{tmp}/{name}", f"{self.path}/wal/{name.removeprefix('entry=')}")
        self.files.delete(tmp)
        return self.head()

    @staticmethod
    def _prepared(ops: DataFrame, now_ms: int | None) -> DataFrame:
        """In the order of the rows; an upsert without updated_at gets the server's time."""
        if "op_index" not in ops.columns:
            ops = ops.withColumn("op_index", F.monotonically_increasing_id())
        if now_ms is not None and "updated_at" in ops.columns:
            ops = ops.withColumn("updated_at", F.when(F.col("kind") == "upsert", F.coalesce("updated_at", F.lit(now_ms))).otherwise(F.col("updated_at")))
        return ops

    def _write(self, ops: DataFrame, seq: int) -> None:
        tmp = f"{self.path}/_tmp-{uuid.uuid4().hex}"
        ops.withColumn("seq", F.lit(seq).cast("long")).write.parquet(tmp)
        self.files.rename(tmp, f"{self.path}/wal/{seq:020d}")
        if seq > int(self.files.read(f"{self.path}/head") or 0):
            self.files.replace(f"{self.path}/head", str(seq))  # a hint for listings; readers trust the entries

    def read(self, after: int = 0, through: int | None = None) -> DataFrame | None:
        """Operations with after < seq <= through, of those entries' files only; None if there are none."""
        seqs = [s for s in self.listed() if s > after and (through is None or s <= through)]
        if not seqs:
            return None
        return self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.path}/wal/{s:020d}" for s in seqs))

    def entries(self, start: int = 1, limit: int = 50, cursor: int | None = None) -> DataFrame:
        """A page of the log: operations by kind, and whether the entry is folded."""
        cursor = self.manifest()["cursor"] if cursor is None else cursor
        seqs = [s for s in self.listed() if s >= start][: min(limit, 500)]
        if not seqs:
            return self.spark.createDataFrame([], "seq long, upsert long, patch long, tombstone long, tombstone_where long, folded boolean")
        rows = self.read(start - 1, seqs[-1])
        counts = rows.groupBy("seq").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in KINDS))
        return counts.withColumn("folded", F.col("seq") <= cursor).orderBy("seq")

    # --- folds ---

    def _parts(self, manifest: dict) -> tuple[DataFrame | None, list[DataFrame]]:
        """Folded rows, and the operations folded since."""
        rows = [s for s in manifest["segments"] if s["kind"] == "rows"]
        ops = [s for s in manifest["segments"] if s["kind"] == "ops"]
        read = lambda s: self.spark.read.parquet(f"{self.path}/segments/{s['id']}")
        return (read(rows[0]) if rows else None), [read(s) for s in ops]

    def view(self, as_of: int | None = None) -> DataFrame:
        """Current rows: segments and tail; as_of (at least the seq that rows were folded through) reads an earlier state."""
        from ..plans import live

        m = self.manifest()
        base, ops = self._parts(m)
        if as_of is not None and base is not None and as_of < min(s["hi"] for s in m["segments"] if s["kind"] == "rows"):
            raise ValueError("rows are folded beyond that seq")
        tail = self.read(m["cursor"], as_of)
        parts = [*ops, *([] if tail is None else [tail])]
        if not parts:
            if base is None:
                raise ValueError("the namespace is empty")
            return base
        log = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return live.live(log, as_of=as_of) if base is None else live.with_tail(base, log, as_of)

    def fold(self) -> str:
        """Fold the tail; 'full', 'minor', 'flush', 'lost' if another fold was faster, or 'none' without a tail."""
        from ..plans import live

        m = self.manifest()
        head = self.head()
        tail = self.read(m["cursor"], head)
        if tail is None:
            return "none"
        segments = m["segments"]
        run = minor_run_len([s["count"] for s in segments])
        new = {"id": uuid.uuid4().hex, "hi": head}
        if not segments or len(segments) >= SEGMENTS:
            how, rows, kept, new = "full", self.view(head), [], new | {"kind": "rows", "lo": 0}
        else:
            merged = [s for s in segments[len(segments) - run :] if s["kind"] == "ops"] if run else []
            how, kept = ("minor" if merged else "flush"), [s for s in segments if s not in merged]
            parts = [self.spark.read.parquet(f"{self.path}/segments/{s['id']}") for s in merged] + [tail]
            rows = live.squash(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))
            new |= {"kind": "ops", "lo": min([s["lo"] for s in merged] + [m["cursor"] + 1])}
        path = f"{self.path}/segments/{new['id']}"
        rows.write.parquet(path)
        new["count"] = self.spark.read.parquet(path).count()
        return how if self.swap(m["generation"], {"segments": [*kept, new], "cursor": head, "head": head}) else "lost"

    def optimize(self) -> DataFrame:
        """Fold everything into rows, patches and predicate deletes too; the rows."""
        m = self.manifest()
        head = self.head()
        new = {"id": uuid.uuid4().hex, "hi": head, "lo": 0, "kind": "rows"}
        path = f"{self.path}/segments/{new['id']}"
        self.view(head).write.parquet(path)
        out = self.spark.read.parquet(path)
        new["count"] = out.count()
        if not self.swap(m["generation"], {"segments": [new], "cursor": head, "head": head}):
            raise RuntimeError("another fold was faster")
        return out

    def gc(self, min_age_ms: int = 3_600_000, now_ms: int | None = None) -> int:
        """Delete segments that neither this manifest nor the one before names, entries folded before that one, and older manifests; the number of files."""
        now = now_ms if now_ms is not None else int(time.time() * 1000)
        m = self.manifest()
        before = self.manifest(m["generation"] - 1) if m["generation"] else m
        live = {s["id"] for x in (m, before) for s in x["segments"]}
        gone = 0
        for name, _, changed in self.files.walk(self.path):
            top, _, rest = name.partition("/")
            old = now - changed >= min_age_ms
            part = rest.split("/")[0]
            dead = top == "segments" and part not in live or top == "wal" and int(part) <= min(before["cursor"], m["cursor"]) or top == "manifests" and int(part.split(".")[0]) < before["generation"] or top.startswith("_tmp-")
            if old and dead:
                self.files.delete(f"{self.path}/{name}")
                gone += 1
        for name in self.files.names(f"{self.path}/wal"):
            if not self.files.walk(f"{self.path}/wal/{name}"):
                self.files.delete(f"{self.path}/wal/{name}")
        return gone

    def stats(self) -> dict:
        m = self.manifest()
        head = self.head()
        return {"generation": m["generation"], "wal_head": head, "cursor": m["cursor"], "backlog": sum(s > m["cursor"] for s in self.listed()), "segments": len(m["segments"]), "has_index": bool(m["segments"])}

    def delete(self) -> int:
        """The manifests first, so that nobody reads what is being deleted, then the rest; the number of files."""
        n = len(self.files.walk(self.path))
        self.files.delete(f"{self.path}/manifests")
        self.files.delete(self.path)
        return n

    def objects(self) -> DataFrame:
        """Stored files: path, size, kind, and whether the current manifest needs them."""
        m = self.manifest()
        live = {s["id"] for s in m["segments"]}
        rows = []
        for name, size, _ in self.files.walk(self.path):
            top, _, rest = name.partition("/")
            part = rest.split("/")[0]
            needed = {"segments": part in live, "wal": top == "wal" and int(part) > m["cursor"], "manifests": part == f"{m['generation']:020d}.json", "head": True}.get(top, False)
            rows.append((name, size, {"segments": "segment", "wal": "entry", "manifests": "manifest", "claims": "claim"}.get(top, top if top == "head" else "other"), bool(needed)))
        return self.spark.createDataFrame(rows, "path string, size long, kind string, live boolean")

    def decode(self, path: str, limit: int = 100) -> list[str]:
        """A stored object as JSON, one string a row, at most so many."""
        if path.endswith(".json"):
            return [self.files.read(f"{self.path}/{path}") or ""]
        return [r.j for r in self.spark.read.parquet(f"{self.path}/{path}").select(F.to_json(F.struct("*")).alias("j")).limit(limit).collect()]


def namespaces(spark: SparkSession, root: str) -> list[str]:
    """Those with a manifest, sorted; no data is read."""
    files = Files(spark)
    return [n for n in files.names(root) if not n.startswith("_") and files.names(f"{root}/{n}/manifests")]
