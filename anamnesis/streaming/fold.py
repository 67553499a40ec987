"""Incremental fold of the operation log with Structured Streaming.

Each micro-batch becomes one file set of its operations without what they
supersede among themselves (``live.squash``): patches of a base in an earlier
batch and predicate deletes are kept.  The view folds all of them, so a batch
that runs twice changes nothing (its directory is overwritten).  ``compact``
folds everything so far into rows, from which later views start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..plans import live
from ..sources.files import Files


def fold(spark: SparkSession, source: str, schema: StructType, state: str, checkpoint: str, files_per_trigger: int = 16) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        live.squash(batch).write.mode("overwrite").parquet(f"{state}/log/batch={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _snapshot(spark: SparkSession, state: str) -> tuple[str | None, int]:
    """Path of the last complete snapshot, and the last batch in it."""
    found = [int(n.split("=")[1]) for n in Files(spark).names(f"{state}/rows") if Files(spark).exists(f"{state}/rows/{n}/_SUCCESS")]
    return (f"{state}/rows/through={max(found)}", max(found)) if found else (None, -1)


def view(spark: SparkSession, state: str) -> DataFrame:
    """Current rows: the last snapshot and the batches after it."""
    path, through = _snapshot(spark, state)
    tail = spark.read.parquet(f"{state}/log").where(F.col("batch") > through).drop("batch")
    return live.live(tail) if path is None else live.with_tail(spark.read.parquet(path), tail)


def compact(spark: SparkSession, state: str) -> int:
    """Fold all batches into rows; the last batch that is in them.  Run it between batches; the batches folded may be removed then."""
    last = spark.read.parquet(f"{state}/log").agg(F.max("batch")).first()[0]
    view(spark, state).write.mode("overwrite").parquet(f"{state}/rows/through={last}")
    return last
