"""Session settings that Python workers need: where this package is, and how much they get at once."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

#: Spark hands 10,000 rows to a worker by default; of long texts or vectors that is more than a worker should hold.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Freed arrays go back to the system: else a worker's heap stays as large as it ever was (glibc; others ignore it).
ALLOCATOR = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(16 << 20), "MALLOC_TRIM_THRESHOLD_": str(32 << 20)}


def ship(spark: SparkSession) -> SparkSession:
    """Let workers that start from now on find the package where the driver has it (on clusters: install it there)."""
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    for key, value in ALLOCATOR.items():
        environment.setdefault(key, value)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark
