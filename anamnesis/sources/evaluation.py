"""Readers of retrieval benchmarks (corpus.jsonl, queries.jsonl, qrels tsv) and of .npy matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def corpus(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema("_id string, title string, text string").json(path)
    return df.select(F.col("_id").alias("doc"), F.trim(F.concat_ws(" ", "title", "text")).alias("text"))


def queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("_id string, text string").json(path).select(F.col("_id").alias("qid"), "text")


def qrels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("qid string, doc string, rel int").csv(path, sep="\t", header=True)


def npy(spark: SparkSession, path: str, rows: int = 1 << 14) -> DataFrame:
    """Rows of a matrix file that all executors see: each task maps the file and reads its range."""
    n = len(np.load(path, mmap_mode="r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                part = np.load(path, mmap_mode="r")[i : i + rows].astype(np.float32)
                at = pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(part))), pa.ListArray.from_arrays(at, pa.array(part.ravel()))], ["row", "vector"])

    return spark.range(0, n, rows).mapInArrow(run, "row long, vector array<float>")
