import numpy as np

import corpus_pipeline as P
from anisomap.llm.common import written
from anisomap.llm.decontamination import contamination
from anisomap.llm.language import WordCRF
from anisomap.llm.neardup import near_duplicates


def test_stages_on_a_small_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{small}/labels.parquet")
    seen = {}
    for name, stage in P.STAGES:
        before, docs = docs, written(stage(spark, docs, small), name)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns and docs.count() > 0.8 * before.count()
    gone = labels.join(seen["quality"], "doc_id", "left_anti").where("quality is not null")
    assert gone.where("quality = 1").count() <= 0.02 * labels.where("quality = 1").count()
    assert gone.where("quality = 0").count() >= 0.5 * labels.where("quality = 0").count()
    dup = near_duplicates(seen["language"], 5)
    assert {r.doc_id for r in seen["near_duplicates"].collect()} == {r.doc_id for r in dup.where("kept").collect()}
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    assert contamination(seen["near_duplicates"], bench).where("contaminated").count() > 0
    assert contamination(seen["decontamination"], bench).where("contaminated").count() == 0
    clean = contamination(seen["near_duplicates"], bench).where("not contaminated").select("doc_id")
    same = seen["near_duplicates"].join(clean, "doc_id").select("doc_id", "text").exceptAll(seen["decontamination"].select("doc_id", "text"))
    assert same.count() == 0
    pieces = docs.toPandas()
    whole = pieces.groupby("doc_id").agg({"length": "sum", "doc_tokens": "first"})
    assert (whole.length == whole.doc_tokens).all() and set(whole.index) == {r.doc_id for r in seen["decontamination"].collect()}
    sizes = pieces.groupby("sequence_id").length.sum().to_numpy()
    assert ((sizes == 1024) | np.array([n & (n - 1) == 0 for n in sizes])).all()


def test_odd_rows_pass_all_stages(spark, odd, small):
    docs = odd.withColumnRenamed("score", "n_chars")
    for name, stage in P.STAGES[1:]:
        docs = written(stage(spark, docs, small), name)
    assert docs.count() > 0
    for _, stage in P.STAGES:
        assert stage(spark, odd.withColumnRenamed("score", "n_chars").limit(0), small).count() == 0


def test_language_stage_decides_on_scores(spark, monkeypatch):
    rows = [(1, "the cat and the dog", None, "a", 19), (2, "12 34", None, "a", 5), (3, None, None, "a", 0), (4, "été", None, "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    assert {r.doc_id for r in P.language_stage(spark, docs, "").collect()} == {1, 4}
    # A model that has learned nothing gives each of three languages a third.
    monkeypatch.setattr(P, "train_language", lambda d: WordCRF(["a", "b", "c"]))
    assert P.language_stage(spark, docs, "").count() == 0


def test_stages_without_labels_or_counts_of_characters(spark, odd, tmp_path):
    docs, at = odd.drop("score"), f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([("1", "the cat sat on the mat with the other cats")], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    assert P.quality_stage(spark, docs, at).count() == odd.count()
    cleaned = P.decontamination_stage(spark, docs, at)
    assert cleaned.columns == docs.columns and cleaned.where("text is null").count() == 0 and cleaned.where("text like '%the cat sat%'").count() == 0
