"""Helpers that the training-data operators share: tables, folds, bounded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anisomap.session import ship
from anisomap.storage import release, scratch, written

__all__ = ["fold", "labelled_sample", "release", "scratch", "table", "whole_texts", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int):
    """crc32 of the id's text, modulo ``modulus``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(-1))


def whole_texts(rows: DataFrame, keys: list[str], chosen: list[tuple], chars: int, longest: int) -> dict[tuple, str]:
    """Whole texts of the chosen keys of ``rows`` (keys, text), in that order, until ``chars`` characters are reached.

    Texts of more than ``longest`` characters, and of repeated keys all but the least text, are left out. Both bounds
    hold for what goes to the driver, so lengths are asked for first.
    """
    spark, schema = rows.sparkSession, rows.select(*keys).schema
    if not chosen:
        return {}
    usable = rows.where(F.length("text") <= longest)
    sizes = usable.join(F.broadcast(spark.createDataFrame(chosen, schema)), keys).groupBy(*keys).agg(F.max(F.length("text")).alias("n")).collect()
    size, room, kept = {tuple(r[:-1]): r[-1] for r in sizes}, chars, []
    for key in chosen:
        if size.get(key, room + 1) <= room:
            kept.append(key)
            room -= size[key]
    if not kept:
        return {}
    got = usable.join(F.broadcast(spark.createDataFrame(kept, schema)), keys).groupBy(*keys).agg(F.min("text").alias("text")).toArrow().to_pydict()
    found = dict(zip(zip(*(got[k] for k in keys), strict=True), got["text"], strict=True))
    return {k: found[k] for k in kept if k in found}


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, rows: int, modulus: int, held_out: int, chars: int, longest: int
) -> tuple[list[str], list[int]]:
    """At most ``rows`` labelled training texts and ``chars`` characters, the same for the same tables; texts are whole.

    Rows whose id falls into the held-out fold are never read as labels. Repeated labels of a document count as
    their maximum. The sample is taken by a hash of the id and bounded, so that it fits in the driver at any size.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold("doc_id", modulus) != held_out))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
        .collect()
    )
    texts = whole_texts(documents.select("doc_id", "text").where(F.col("text").isNotNull()), ["doc_id"], [(r.doc_id,) for r in ids], chars, longest)
    y = {r.doc_id: r.y for r in ids}
    return list(texts.values()), [y[k] for (k,) in texts]
