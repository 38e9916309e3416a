"""The registered queries of the training-data operators: each applies one operator to its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from anisomap.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anisomap.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anisomap.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anisomap.llm.decontamination import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anisomap.llm.suffixtree import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anisomap.llm.ann import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anisomap.llm.tokencounts import rollup_of

    return rollup_of(table(spark, sf_dir, "documents"))


def token_counts_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6's operator with those versions that SQL can count."""
    from anisomap.llm.tokencounts import rollup_of

    return rollup_of(table(spark, sf_dir, "documents"), {"words_v1": None, "bytes_v1": None})


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anisomap.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anisomap.llm.language import language

    return language(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anisomap.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anisomap.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anisomap.llm.mixing import taken

    return taken(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anisomap.llm.filteraudit import audit_filters

    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from anisomap.llm.divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_toxicity": op2_toxicity,
    "op3_decontamination": op3_decontamination,
    "op4_suffix_tree": op4_suffix_tree,
    "op5_ann": op5_ann,
    "op6_token_counts": op6_token_counts,
    "op7_minhash": op7_minhash,
    "op8_packing": op8_packing,
    "op9_language": op9_language,
    "op10_warc": op10_warc,
    "op11_mixing": op11_mixing,
    "op12_filter_audit": op12_filter_audit,
    "op13_divergence": op13_divergence,
    "token_counts_plain": token_counts_plain,
}
