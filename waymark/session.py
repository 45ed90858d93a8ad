"""Makes the package importable on the executors, wherever the driver's Python found it."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="waymark-py-")) / f"{top.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def width(spark: SparkSession) -> int:
    """Partitions for work that costs much more than its bytes show, which Spark would otherwise coalesce to a few tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def checkpointed(spark: SparkSession) -> None:
    """A checkpoint folder for the session: spark.checkpoint.dir, or one of our own where that is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="waymark-checkpoint-"))
