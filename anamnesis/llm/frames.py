"""DataFrame helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, lower: bool = True) -> DataFrame:
    """doc_id and text of the documents, the text lower-cased, null as empty; other columns don't matter."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), (F.lower(text) if lower else text).alias("text"))


def written(df: DataFrame, name: str) -> DataFrame:
    """df through a Parquet table in the shared folder, which cuts its lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.parquet(path)
    out._written = path  # type: ignore[attr-defined]
    return out


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete what no later step reads."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def dropped(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, which no later step reads."""
    for t in tables:
        removed(t.sparkSession, t._written)  # type: ignore[attr-defined]


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map whose worker, kept for later tasks, gives its memory back when the map is over."""

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim is not None:
            trim(0)

    return lean_run
