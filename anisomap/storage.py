"""Storage that all executors see, for results that must outlive an executor."""

from __future__ import annotations

import gc
import tempfile
import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``; a temporary one only where it is unset and all is on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = kept.get() if kept.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="anisomap-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; Spark's file system removes it when the driver ends."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, path = _path(spark, at)
    fs.deleteOnExit(path)
    return at


def _path(spark: SparkSession, at: str) -> tuple[JavaObject, JavaObject]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and kept if executors are lost."""
    spark = df.sparkSession
    at = scratch(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def written_with(df: DataFrame, name: str, *totals: Column) -> tuple[DataFrame, tuple]:
    """``written``, and aggregates over its rows, which the writing tasks gather: no job of their own."""
    seen = Observation()
    named = [x.alias(f"t{i}") for i, x in enumerate(totals)]
    out = written(df.observe(seen, F.count(F.lit(1)).alias("rows"), *named), name)
    got = seen.get
    return out, (got["rows"], *(got[f"t{i}"] for i in range(len(totals))))


def drop(df: DataFrame) -> None:
    """Delete the files of a written table that nothing reads any more."""
    for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        fs, path = _path(df.sparkSession, at)
        fs.delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what is written already; else they stay until the driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
