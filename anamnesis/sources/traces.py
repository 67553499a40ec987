"""Request traces as JSON lines by hour: sink, reader, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .files import Files

SCHEMA = "ts timestamp, node string, namespace string, op string, ms double, ok boolean, detail string"


def write(traces: DataFrame, path: str) -> None:
    """Append a batch of traces (SCHEMA)."""
    traces.withColumn("hour", F.date_format("ts", "yyyy-MM-dd-HH")).write.mode("append").partitionBy("hour").json(path)


def read(spark: SparkSession, path: str, since: str | None = None, until: str | None = None, namespace: str | None = None, node: str | None = None) -> DataFrame:
    """Traces of the hours from since to until (as their partitions are named, inclusive): other hours' files are not read."""
    out = spark.read.schema(f"{SCHEMA}, hour string").json(path)
    for column, value, hold in (("hour", since, lambda c, v: c >= v), ("hour", until, lambda c, v: c <= v), ("namespace", namespace, lambda c, v: c == v), ("node", node, lambda c, v: c == v)):
        if value is not None:
            out = out.where(hold(F.col(column), F.lit(value)))
    return out


def expire(spark: SparkSession, path: str, before: str) -> int:
    """Delete whole hours before one; how many."""
    files, gone = Files(spark), 0
    for name in files.names(path):
        if name.startswith("hour=") and name.removeprefix("hour=") < before:
            files.delete(f"{path}/{name}")
            gone += 1
    return gone
