"""The corpus pipeline: quality, language, near-duplicates, decontamination, packing.

Each stage takes all that its predecessor kept and returns a DataFrame, which is written and read again; all but the
last return the columns of ``documents``, further ones too. An empty table gives an empty one in every stage, and
repeated rows are handled like others, except that near-duplicates keep or drop all rows of an id together. What a
stage does with nulls and with empty texts is said with it; no stage drops a row for a null id, language or source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anisomap.llm.common import table, written
from anisomap.llm.decontamination import remove_spans
from anisomap.llm.language import identify, train_language
from anisomap.llm.neardup import keep_one
from anisomap.llm.packing import pack
from anisomap.llm.quality import score_quality, train_quality
from anisomap.session import ship

#: What the language stage asks of the best language's mean marginal.
LEAST_SCORE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality probability is at least 0.3; the classifier learns from those of ``docs`` with a label.

    Null and empty texts have the probability that padding has. Without labels all documents stay.
    """
    model = train_quality(docs, table(spark, sf_dir, "labels"), needed=False)
    if model is None:
        return docs
    return score_quality(docs, model).where("quality_predicted = 1").select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter of which one known language has at least ``LEAST_SCORE`` by the mean over their words.

    Null texts and those without a letter go. If no row has a language to learn from, all documents with a letter stay.
    """
    model = train_language(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return identify(docs, model).where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near copies (five words, similarity 0.8).

    Null and empty texts are no copies of each other, and rows without an id stay.
    """
    return keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of benchmark items; those of which no word is left, and null texts, go.

    A column n_chars, if there is one, is made anew.
    """
    cleaned = remove_spans(docs, table(spark, sf_dir, "benchmark"))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.where(F.col("text").rlike(r"\S")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens, with sources in their proportions; null texts are empty."""
    return pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
#: Learned classifiers and the tokenizer cannot be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage keeps is written to the shared folder."""
    docs = table(ship(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
