import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from anisomap.llm import language as L
from anisomap.llm import quality as Q
from anisomap.llm import subwords as W
from anisomap.llm import toxicity as T


@pytest.fixture(scope="module")
def labelled(spark, small):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return d.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").select("doc_id", "text", "lang", "quality", "toxic").toPandas().sort_values("doc_id")


def held_out(ids, modulus, remainder):
    return np.array([zlib.crc32(str(i).encode()) % modulus == remainder for i in ids])


def area(score, y):
    """Area under the ROC curve."""
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_quality_on_held_out_texts(labelled):
    out = held_out(labelled.doc_id, 5, 0)
    train, test = labelled[~out], labelled[out]
    model = Q.ByteConv().fit(train.text.tolist(), train.quality.tolist())
    score, y = model.score(test.text.tolist()), test.quality.to_numpy()
    assert area(score, y) > 0.9 and ((score >= 0.3) == y).mean() > 0.94


def test_quality_gradients_by_differences():
    model = Q.ByteConv(filters=3, width=2, hidden=2, seed=1)
    for k in model.p:
        model.p[k] = model.p[k].astype(np.float64)
    texts, y = [bytes(np.random.default_rng(5).integers(32, 127, 700).astype(np.uint8)), b"xyz w", b""], np.array([1.0, 0, 1])

    def loss():
        z = np.array([model.score([t.decode()])[0] for t in texts])
        return -(y * np.log(z) + (1 - y) * np.log(1 - z)).mean()

    grads = model._step(texts, y)
    for k in ("E", "W", "V", "u", "a", "c"):
        flat = model.p[k].reshape(-1)
        for i in range(0, flat.size, max(1, flat.size // 5)):
            if k == "E" and i < 2:
                continue  # padding
            old, step = flat[i], 1e-5
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert np.asarray(grads[k]).reshape(-1)[i] == pytest.approx((up - down) / (2 * step), rel=8e-2, abs=3e-5)


def test_quality_scores_do_not_depend_on_pieces(monkeypatch):
    r = np.random.default_rng(3)
    texts = [bytes(r.integers(32, 127, n).astype(np.uint8)).decode() for n in (1, 255, 256, 1020, 1024, 1025, 2048, 9000, 40_000)]
    model = Q.ByteConv(seed=2)
    whole = model.score([*texts, None, ""])
    for piece in (256, 1024, 4096):
        monkeypatch.setattr(Q, "PIECE", piece)
        assert model.score([*texts, None, ""]) == pytest.approx(whole, abs=1e-6)
        assert [model.score([t])[0] for t in texts] == pytest.approx(whole[: len(texts)], abs=1e-6)


def test_quality_gradients_do_not_depend_on_parts(monkeypatch):
    texts, y = [b"a few words", b"and others " * 90, b"xyz" * 200], np.array([1.0, 0, 1], np.float32)
    model = Q.ByteConv(seed=4)
    whole = model._step(texts, y)
    monkeypatch.setattr(Q, "STEP_BYTES", 300)
    parts = model._gradients(texts, np.arange(3), y)
    assert all(np.allclose(whole[k], parts[k], atol=1e-6) for k in whole)


def test_toxicity_on_held_out_texts_and_misspellings(labelled):
    out = held_out(labelled.doc_id, 4, 2)
    train, test = labelled[~out], labelled[out]
    model = T.SubwordBag().fit(train.text.tolist(), train.toxic.tolist())
    score, y = model.score(test.text.tolist()), test.toxic.to_numpy()
    assert area(score, y) > 0.95 and (score >= 0.3)[y == 1].mean() > 0.85 and (score >= 0.3)[y == 0].mean() < 0.01
    bad, good = model.score(["what an idiiot and stupidd losser", "ther and the of an onre"])
    assert bad > 0.3 > good
    # Length alone does not make clean texts toxic, nor a toxic passage clean.
    clean = " ".join(t for t, k, s in zip(test.text, y, score, strict=True) if k == 0 and s < 0.3)[:1_000_000]
    assert len(clean) == 1_000_000
    assert model.score([clean])[0] < 0.3 and model.score([clean[:500_000] + " what an idiot and stupid loser " + clean[500_000:]])[0] > 0.9
    longest = " ".join([clean] * 10)
    assert model.score([longest])[0] < 0.3 and model.score([longest + " what an idiot and stupid loser"])[0] > 0.8


def test_toxicity_gradients_by_differences(monkeypatch):
    monkeypatch.setattr(T, "BITS", 8)
    model, texts, y = T.SubwordBag(width=3, seed=1), ["some words here", "others there and more", "one"], np.array([1, 0, 1])
    model.E, model.w = model.E.astype(np.float64), model.w.astype(np.float64)

    def loss():
        model.__dict__.pop("frozen", None)
        p = T.WRONG + (1 - 2 * T.WRONG) * model.score(texts)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()

    ((rows, t, by_bias),) = model._gradients(texts, y)
    for i in range(0, len(rows), 5):
        for j in range(3):
            old, step, ends = model.E[rows[i], j], 1e-5, []
            for sign in (1, -1):
                model.E[rows[i], j] = old + sign * step
                ends.append(loss())
            model.E[rows[i], j] = old
            assert t[i] * model.w[j] == pytest.approx((ends[0] - ends[1]) / (2 * step), abs=1e-4)
    old, ends = float(model.bias), []
    for sign in (1, -1):
        model.bias = old + sign * 1e-5
        ends.append(loss())
    assert by_bias == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-4)


def test_toxicity_scores_do_not_depend_on_pieces(monkeypatch):
    model, text = T.SubwordBag(seed=3), "several words that are not so many, " * 300
    whole = model.score([text, "short one", None])
    for limit in (64, 300, 4096):
        monkeypatch.setattr(W, "BLOCK", limit)
        monkeypatch.setattr(W.blocks, "__defaults__", (False, limit, 0))
        # Only windows at seams are met twice, which a soft maximum of equal windows shows.
        assert model.score([text, "short one", None]) == pytest.approx(whole, rel=0.05)


def test_classifiers_learn_from_whole_texts_within_bounds(spark):
    from anisomap.llm.common import labelled_sample

    docs = spark.createDataFrame([(i, "ab " * i) for i in range(1, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, quality int")
    texts, y = labelled_sample(docs, labels, "quality", 40, 5, 0, 600, 120)
    assert texts and sum(map(len, texts)) <= 600 and all(t == "ab " * (len(t) // 3) and len(t) <= 120 and k == len(t) // 3 % 2 for t, k in zip(texts, y, strict=True))
    assert labelled_sample(docs.limit(0), labels, "quality", 40, 5, 0, 600, 120) == ([], [])


def test_language_on_held_out_texts(labelled):
    out = held_out(labelled.doc_id, 4, 2)
    train, test = labelled[~out], labelled[out]
    model = L.WordCRF(sorted(set(train.lang))).fit(train.text[:1200].tolist(), train.lang[:1200].tolist())
    got, score = model.predict(test.text.tolist())
    assert (np.array(got) == test.lang.to_numpy()).mean() > 0.98 and ((score > 0) & (score <= 1)).all()
    mixed = model.words("the and of that was with und der die nicht ist das")
    assert [w[1] for w in mixed[1:5]] == ["en"] * 4 and [w[1] for w in mixed[-5:]] == ["de"] * 5


def test_marginals_are_those_of_all_paths():
    model, r = L.WordCRF(["a", "b", "c"]), np.random.default_rng(0)
    model.T, model.S = r.normal(size=(3, 3)).astype(np.float32), r.normal(size=3).astype(np.float32)
    e = r.normal(size=(4, 3)).astype(np.float32)
    weight = np.zeros((4, 3))
    for path in np.ndindex(3, 3, 3, 3):
        p = np.exp(model.S[path[0]] + sum(e[t, path[t]] for t in range(4)) + sum(model.T[path[t], path[t + 1]] for t in range(3)))
        for t in range(4):
            weight[t, path[t]] += p
    gamma, pairs = model._marginals(e, np.array([0]), np.array([4]))
    assert np.allclose(gamma[:, 0], weight / weight.sum(1, keepdims=True), atol=1e-5) and pairs.sum() == pytest.approx(3, rel=1e-4)


def test_word_hashes_are_those_of_the_words():
    for a, _, _ in W.blocks(["one two one", "two"]):
        h = W.word_hashes(a, *W.words(a))
        assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1]


@pytest.mark.parametrize("op", ["quality", "toxicity", "language"])
def test_odd_rows(spark, odd, op):
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, 0), (6, 0, 1), (6, 1, 1), (None, 1, 1), (99, 0, 0), (8, None, None)], "doc_id long, quality int, toxic int")
    run = {"quality": lambda d, x: Q.quality(d, x), "toxicity": lambda d, x: T.toxicity(d, x), "language": lambda d, x: L.language(d)}[op]
    got = run(odd, labels).toPandas()
    assert len(got) == odd.count() and got["score"].between(0, 1).all()
    if op == "language":
        assert set(got[got.doc_id.isin([1, 2, 5])].lang_pred) == {"und"} and "und" not in set(got[got.doc_id.isin([3, 6, 7, 8])].lang_pred)
    assert run(odd.limit(0), labels.limit(0)).count() == 0
    assert run(odd.where("doc_id = 3"), labels.limit(0)).count() == 1


def test_clashing_columns_are_replaced(spark, odd):
    named = odd.selectExpr("*", "1 as quality_score", "2 as toxic_predicted", "3 as lang_pred", "4 as lang_score")
    assert Q.score_quality(named, Q.ByteConv()).select("quality_score").dtypes == [("quality_score", "double")]
    assert T.score_toxicity(named, T.SubwordBag()).where("toxic_predicted not in (0, 1)").count() == 0
    assert L.identify(named, L.WordCRF([])).select("lang_pred").distinct().count() == 1


def test_general_interfaces_keep_columns(spark, odd):
    assert Q.score_quality(odd, Q.ByteConv()).columns == [*odd.columns, "quality_score", "quality_predicted"]
    assert L.identify(odd, L.WordCRF([])).where("lang_pred <> 'und'").count() == 0
    assert T.score_toxicity(odd, T.SubwordBag()).where("toxic_score = 0").count() >= 2


def test_query_folds(spark, small):
    from anisomap.llm.queries import op1_quality

    got = op1_quality(spark, small)
    assert got.count() == 1000
    assert got.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)).count() == 0


def test_languages_of_few_documents_are_learned(spark):
    rows = [(i, "the cat and the dog of the town", "en") for i in range(600)] + [(1000 + i, "kissa ja koira talossa " * 30, "fi") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.train_language(docs, rows=40)
    assert model.languages == ["en", "fi"]
    assert model.predict(["kissa ja koira"])[0] == ["fi"]
