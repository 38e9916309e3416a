"""Reading and writing of embeddings, tables of runs, boundary plans, and exchange files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anisomap.operators.evaluate import boundary_plan, plan_hash


def save_tables(path: str, **tables: DataFrame) -> None:
    """A Parquet folder for each named table."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_tables(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def save_embedding(path: str, embedding: DataFrame, stress: float, full_stress: float | None = None, metadata: dict | None = None) -> None:
    """(id, y) with the stresses and metadata as JSON with sorted keys."""
    meta = json.dumps(metadata or {}, sort_keys=True)
    row = embedding.sparkSession.createDataFrame([(float(stress), full_stress, meta)], "stress double, full_stress double, metadata string")
    save_tables(path, embedding=embedding, summary=row)


def load_embedding(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    found = spark.read.parquet(f"{path}/embedding")
    return found if ids is None else align(ids, found)


def align(ids: DataFrame, saved: DataFrame) -> DataFrame:
    """Rows of ``saved`` for exactly the wanted ids; raises if one is missing."""
    if not ids.join(saved, "id", "left_anti").isEmpty():
        raise ValueError("some wanted ids were not saved")
    return ids.select("id").join(saved, "id")


def read_metadata(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.parquet(f"{path}/summary").first()["metadata"])


def matches(spark: SparkSession, path: str, **wanted) -> bool:
    """Whether stored metadata has the wanted values; folders without metadata do not match."""
    try:
        return all(read_metadata(spark, path).get(k) == v for k, v in wanted.items())
    except Exception:  # no such folder, or not one of ours
        return False


def newest_compatible(spark: SparkSession, pattern: str, n: int, dimensions: int) -> str | None:
    """Of the saved embeddings that match a glob and have n rows of that many dimensions, the one changed last."""
    for path in _by_age(spark, pattern):
        try:
            y = load_embedding(spark, path)
            row = y.agg(F.count("*").alias("n"), F.min(F.size("y")).alias("lo"), F.max(F.size("y")).alias("hi")).first()
        except Exception:  # not one of ours
            continue
        if tuple(row) == (n, dimensions, dimensions):
            return path
    return None


def newest(spark: SparkSession, pattern: str) -> str | None:
    """The path that matches a glob and was changed last."""
    return next(iter(_by_age(spark, pattern)), None)


def _by_age(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, those changed last first."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [p for _, p in sorted(((s.getModificationTime(), s.getPath().toString()) for s in found or []), reverse=True)]


def save_plan(path: str, plan: DataFrame, labels: DataFrame, cluster_edges: DataFrame, knn: DataFrame, n_neighbors: int) -> None:
    meta = plan_hash(labels, cluster_edges, knn).select("hash", F.lit(n_neighbors).alias("n_neighbors"), F.lit(knn.select("src").distinct().count()).alias("n_samples"))
    save_tables(path, plan=plan, plan_meta=meta)


def load_or_compute_plan(spark: SparkSession, path: str, labels: DataFrame, cluster_edges: DataFrame, knn: DataFrame, n_neighbors: int, on_mismatch: str = "error") -> DataFrame:
    """The stored plan if it was made from these labels, transitions and neighbours; else an error, or a new one that is stored."""
    if on_mismatch not in ("recompute", "error"):
        raise ValueError("on_mismatch is recompute or error")
    try:
        meta = spark.read.parquet(f"{path}/plan_meta").first()
    except Exception:  # nothing stored yet
        meta = None
    if meta and (meta["hash"], meta["n_neighbors"]) == (plan_hash(labels, cluster_edges, knn).first()["hash"], n_neighbors):
        return spark.read.parquet(f"{path}/plan")
    if meta and on_mismatch == "error":
        raise ValueError("the stored plan was made from other labels, transitions or neighbours")
    plan = boundary_plan(labels, cluster_edges, knn)
    save_plan(path, plan, labels, cluster_edges, knn, n_neighbors)
    return spark.read.parquet(f"{path}/plan")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """All rows with all columns of both."""
    return old.unionByName(new, allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same keys, compared as text; of repeated new keys the last by ``order`` counts."""
    if order is not None:
        last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
        new = new.withColumn("_r", last).where("_r = 1").drop("_r")
    text = lambda k: F.coalesce(F.col(k).cast("string"), F.lit(""))
    replaced = new.select(*[text(k).alias(f"_{k}") for k in keys]).distinct()
    same = [text(k) == F.col(f"_{k}") for k in keys]
    kept = old.join(replaced, same, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def sniff_embedding(df: DataFrame) -> DataFrame:
    """(id, y) from the first usual name of an array column, or from the only one."""
    arrays = [f.name for f in df.schema if f.dataType.typeName() == "array"]
    for name in ("embedding", "X", "x", "umap", "isomap", "y"):
        if name in arrays:
            break
    else:
        if len(arrays) != 1:
            raise ValueError("no column is an embedding for sure")
        name = arrays[0]
    key = next((c for c in ("id", "vec_id", "cell_id") if c in df.columns), None)
    if key is None:
        raise ValueError("there is no id column")
    return df.select(F.col(key).alias("id"), F.col(name).cast("array<double>").alias("y"))


def write_matrix_market(entries: DataFrame, path: str, rows: int, columns: int) -> None:
    """Coordinate text of (i, j, value), 1-based: a header part and the entries, to be read as one stream of lines."""
    spark = entries.sparkSession
    n = entries.count()
    head = spark.createDataFrame([("%%MatrixMarket matrix coordinate real general",), (f"{rows} {columns} {n}",)], "value string").coalesce(1)
    head.write.mode("overwrite").text(f"{path}/head")
    entries.select(F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, "value").alias("value")).write.mode("overwrite").text(f"{path}/entries")


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", r"\s+")
    return spark.read.text(f"{path}/entries").select((parts[0].cast("long") - 1).alias("i"), (parts[1].cast("long") - 1).alias("j"), parts[2].cast("double").alias("value"))


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def token(c: Column) -> Column:
    """A number's text for file names: minus as m, point as p."""
    return F.translate(c.cast("string"), "-.", "mp")


def method_of(path: Column) -> Column:
    """The method that a file name begins with, and ``unknown``."""
    name = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    return F.coalesce(F.nullif(F.regexp_extract(name, r"^(smacof|path_frozen|umap|isomap|gd|soft_bf|datasp)(?:_|$)", 1), F.lit("")), F.lit("unknown"))


def dimension_of(path: Column) -> Column:
    """3 for names with a token 3d, else 2."""
    return F.when(path.rlike(r"(^|_|/)3d(_|\.|$)"), 3).otherwise(2)
