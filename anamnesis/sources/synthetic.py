"""Made-up memories for load tests: vectors about centres, tags and entities by Zipf's law, a few causal edges, a second apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..operators.blocks import unit

SCHEMA = (
    "id long, memory_type int, text string, vector array<float>, tags array<string>, entity_ids array<long>, occurred_start long, updated_at long, proof_count long, "
    "causal_out array<struct<target:long,link_type:string,weight:double>>, metadata map<string,string>, batch long"
)
KINDS = ("CAUSES", "CAUSED_BY", "ENABLES", "PREVENTS")


def memories(spark: SparkSession, n: int, dim: int = 32, types: int = 3, tags: int = 2000, entities: int = 5000, untagged: float = 0.2, edges: float = 0.05, seed: int = 7, batch: int = 1000, start: int = 0) -> DataFrame:
    """n rows that depend on the seed and their ids only, made where they are needed."""
    centres = unit(np.random.default_rng(seed).normal(size=(max(1, round(n**0.5)), dim)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i in f["id"]:
                rng = np.random.default_rng((seed, i))
                zipf = lambda most, k: sorted({int(x - 1) % most for x in rng.zipf(1.3, k)})
                v = unit(centres[rng.integers(len(centres))][None] + rng.normal(0, 0.35 / dim**0.5, (1, dim)))[0]
                out = [{"target": int(rng.integers(i)), "link_type": KINDS[int(rng.integers(4))], "weight": float(rng.uniform(0.5, 1))}] if i and rng.random() < edges else []
                own = [] if rng.random() < untagged else [f"tag{t}" for t in zipf(tags, 3)]
                rows.append((i, i % types + 1, f"memory {i} about " + " ".join(f"topic{t}" for t in zipf(500, 5)), v.astype(np.float32), own, zipf(entities, 2), i * 1000, i * 1000, 0, out, {"document_id": f"d{i // 10}", "src": f"s{i % 7}"}, i // batch))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return spark.range(start, start + n).mapInPandas(run, SCHEMA)


def query_vector(n: int, dim: int = 32, seed: int = 7, which: int = 0) -> list[float]:
    """A query near one of the centres."""
    rng = np.random.default_rng((seed, -1 - which) if which < 0 else (seed, 1 << 40, which))
    centres = unit(np.random.default_rng(seed).normal(size=(max(1, round(n**0.5)), dim)))
    return unit(centres[rng.integers(len(centres))][None] + rng.normal(0, 0.35 / dim**0.5, (1, dim)))[0].tolist()
