"""An endless trickle of small entries, to try readers against a log that grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.log import Log


def trickle(spark: SparkSession, log: Log, checkpoint: str, rows_per_second: int = 5, seconds: int = 1) -> StreamingQuery:
    """Commit an entry of upserts each so many seconds until the query is stopped; a batch that runs again writes the same rows again, which changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            log.append(batch)

    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    rows = rate.select(F.lit("upsert").alias("kind"), F.col("value").alias("id"), (F.col("value") % 3 + 1).cast("int").alias("memory_type"), F.concat(F.lit("note "), F.col("value")).alias("text"), F.unix_millis("timestamp").alias("updated_at"))
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()
