"""Helpers for sessions and for shipping the library to executors."""

from __future__ import annotations

import os
import uuid
import zipfile
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; on a local master, where that is unset, a temporary one."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        path = tempfile.mkdtemp(prefix="anamnesis-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Give the executors the package, once per application, unless PYTHONPATH already holds it."""
    root = Path(__file__).resolve().parent
    if str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    shared = urlparse(shared_dir(spark))
    if shared.scheme in ("", "file"):
        folder = shared.path
    else:  # the driver's own file, which addPyFile copies to the executors
        import tempfile

        folder = tempfile.mkdtemp(prefix="anamnesis-")
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/anamnesis-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
