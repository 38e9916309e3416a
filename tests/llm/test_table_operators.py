import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from anisomap.llm import ann as A
from anisomap.llm import packing as K
from anisomap.llm import tokencounts as C
from anisomap.llm import warc as W
from anisomap.llm.oracles import ORACLES
from anisomap.llm.queries import op5_ann, op6_token_counts, op10_warc
from anisomap.llm.tokens import encode, encoder, public_ranks
from tests.comparing import assert_same, connection


def exact(x, ids, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    d[q] = np.inf
    return [(int(ids[i]), float(d[i])) for i in np.lexsort((ids, d))[:k]]


def test_recall_and_scores(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    x, ids = np.stack(rows["embedding"]).astype(float), rows["vec_id"].to_numpy()
    got = op5_ann(spark, sf).toPandas()
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        own = got[got.query_id == ids[q]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and own["score"].is_monotonic_increasing and ids[q] not in set(own.vec_id)
        want = dict(exact(x, ids, q, 10))
        for v, s in zip(own.vec_id, own.score, strict=True):
            assert s == pytest.approx(float(np.sqrt(((x[np.searchsorted(ids, v)] - x[q]) ** 2).sum())), rel=1e-12)
        hits, total = hits + len(set(want) & set(own.vec_id)), total + 10
    assert hits / total >= 0.9


def test_odd_vectors_blocks_and_few_candidates(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 8)
    monkeypatch.setattr(A, "LEAST_BLOCK", 8)
    monkeypatch.setattr(A, "QUERIES", 3)
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, [float("inf"), 0.0]), (2, [1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in A.nearest(v, v.where("vec_id in (0, 3, 4)")).orderBy("rank").collect()]
    assert got == [(0, 1, 2), (0, 2, 1)]
    assert A.nearest(v.limit(0), v).count() == 0 and A.nearest(v, v.limit(0)).count() == 0
    x = np.random.default_rng(0).normal(size=(90, 6))
    many = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = A.nearest(many, many.where("vec_id % 10 = 0"), k=5).toPandas()
    hits = sum(len(set(got[got.query_id == q].vec_id) & {i for i, _ in exact(x, np.arange(90), q, 5)}) for q in range(0, 90, 10))
    assert hits >= 43


def test_neighbours_in_a_tight_group_of_near_copies(spark):
    """Many more vectors share their codes than are asked for; near copies differ less than codes can tell."""
    r = np.random.default_rng(7)
    x = np.concatenate([r.normal(size=(9000, 16)), r.normal(size=16) + 1e-7 * r.normal(size=(6000, 16)), np.repeat(r.normal(size=(1, 16)), 40, 0)])
    ids = r.permutation(len(x))
    x, ids = x[np.argsort(ids)], np.arange(len(x))
    v = spark.createDataFrame([(int(i), row.tolist()) for i, row in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(8)
    got = A.nearest(v, v.where("vec_id % 100 = 0")).toPandas()
    hits = total = 0
    for q in range(0, len(x), 100):
        own = got[got.query_id == q].sort_values("rank")
        want = exact(x, ids, q, 10)
        hits, total = hits + len({i for i, _ in want} & set(own.vec_id)), total + 10
    assert hits / total >= 0.95


def test_counts_are_those_of_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").toPandas()
    e, want = encoder(*public_ranks()), {}
    for r in docs.itertuples():
        for version, n in (("words_v1", len((r.text or "").encode().split())), ("byte_bpe_50k", len(encode(e, r.text or "")))):
            a = want.setdefault((r.source, r.lang, version), [0, 0])
            a[0], a[1] = a[0] + 1, a[1] + n
    got = {(r.source, r.lang, r.tokenizer_version): [r.n_docs, r.n_tokens] for r in op6_token_counts(spark, small).collect()}
    assert got == want


def test_special_tokens_count_as_the_tokenizer_counts_them(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["mixed <|endoftext|> text", "<|endoftext|><|endoftext|>", "a<|endoftext|>", "<|endoftext", None, ""]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in C.count_tokens(docs, {"byte_bpe_50k": public_ranks()}).collect()}
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}


def test_commits(spark, odd, tmp_path):
    versions = {"words_v1": None}
    first = C.count_tokens(odd.select("doc_id", "source", "lang", "text"), versions)
    r = C.Rollup(spark, f"file://{tmp_path}/rollup")
    assert r.totals().count() == 0
    assert r.commit("a", C.signed(first)) and not r.commit("a", C.signed(first))
    total = r.totals().agg(F.sum("n_docs"), F.sum("n_tokens")).first()
    assert total[0] == odd.count()
    old = first.where("doc_id = 3")
    new = old.withColumn("n_tokens", F.col("n_tokens") + 5)
    assert r.commit("b", C.revised(old, new))
    assert r.totals().agg(F.sum("n_tokens")).first()[0] == total[1] + 5
    assert r.commit("c", C.signed(first.where("doc_id <> 3"), -1)) and r.commit("d", C.signed(new, -1))
    left = r.totals().agg(F.sum("n_docs"), F.sum("n_tokens")).first()
    assert (left[0], left[1]) == (1, 0 + first.where("doc_id is null").first().n_tokens)
    assert {b.batch for b in r.batches().collect()} == {"a", "b", "c", "d"}
    again = C.Rollup(spark, f"file://{tmp_path}/rollup")
    assert not again.commit("d", C.signed(new)) and C.rollup_of(odd.limit(0)).count() == 0


def test_a_writer_that_dies_does_no_harm(spark, tmp_path):
    path = f"file://{tmp_path}/rollup"
    r = C.Rollup(spark, path)
    one = spark.createDataFrame([("s", "en", "words_v1", 1, 5)], C.TOTALS)
    assert r.commit("a", one)
    (tmp_path / "rollup/commits/000000000002").touch()  # a commit without content
    (tmp_path / "rollup/commits/_half").write_text('{"number": 9, "batch"')  # one that was never renamed
    assert r.totals().collect() == one.collect() and r.commit("b", one) and not r.commit("b", one)
    assert r.totals().first().n_tokens == 10 and sorted(x.batch for x in r.batches().collect()) == ["a", "b"]
    assert not r._publish(3, {"number": 3, "batch": "c", "folder": "nowhere"}) and r.totals().first().n_tokens == 10
    assert r.commit("c", one) and r.commit("d", one)
    assert len(list((tmp_path / "rollup").glob("data-*"))) == 2 and r.totals().first().n_tokens == 20


def test_plain_counts_are_those_of_sql(spark, sf):
    from anisomap.llm.queries import token_counts_plain

    assert_same(token_counts_plain(spark, sf).toPandas(), connection(sf).execute(ORACLES["token_counts_plain"]).df())


def test_counting_replaces_clashing_columns(spark, odd):
    got = C.count_tokens(odd.selectExpr("*", "7 as n_tokens", "'x' as tokenizer_version"), {"words_v1": None, "bytes_v1": None})
    assert got.where("tokenizer_version = 'bytes_v1' and doc_id = 7").first().n_tokens == 700_000 and got.count() == 2 * odd.count()


def test_pieces_are_the_tokenizer_s(spark, odd):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = odd.where("doc_id <> 6 and doc_id <> 7").union(spark.createDataFrame([(20, "mixed\n\n  spaces\tand <|endoftext|> 12'll ’ü 漢字   end ", "en", "q", 0)], odd.schema)).union(spark.createDataFrame([(21, "ab cd ef " * 900, "en", "q", 0)], odd.schema))
    got = K.pack(docs, window=64, least=16, part_tokens=256, with_ids=True).toPandas()
    ids = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids + [0] for r in docs.where("doc_id is not null").collect()}
    for doc, own in got[got.doc_id.notna() & (got.doc_id != 4)].groupby("doc_id"):
        own, at = own.sort_values("start"), 0
        for r in own.itertuples():
            assert r.start == at and r.doc_tokens == len(ids[doc]) and list(r.ids) == ids[doc][at : at + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            at += r.length
        assert at == len(ids[doc])
    assert got[got.doc_id == 4].length.sum() == 2 * len(ids[4]) and set(ids) | {None} >= {None if x != x else x for x in got.doc_id}
    sizes = got.groupby("sequence_id").length.sum()
    assert (sizes <= 64).all() and all(n == 64 or n & (n - 1) == 0 for n in sizes)
    for _, own in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert own.offset.tolist() == np.append(0, own.length.cumsum()[:-1]).tolist()
    whole = K.sequences(spark.createDataFrame(got[["sequence_id", "offset", "ids"]].assign(ids=got.ids.map(list))), 64)
    assert whole.where((F.size("ids") != 64) & (F.size("ids") > 32)).count() == 0
    big = spark.createDataFrame([((1 << 60) + 1, "a b", "s"), (None, "c", "s")], "doc_id long, text string, source string")
    assert {r.doc_id for r in K.pack(big).collect()} == {(1 << 60) + 1, None}
    assert K.pack(odd.limit(0)).count() == 0
    # Cutting documents before they are dealt leaves their ids as they are.
    cut = K.pack(docs.where("doc_id > 4"), window=64, least=16, part_tokens=256, with_ids=True, chunk=100).toPandas()
    for doc, own in cut.groupby("doc_id"):
        own = own.sort_values("start")
        assert np.concatenate([np.array(x) for x in own.ids]).tolist() == ids[doc] and (own.doc_tokens == len(ids[doc])).all()


def test_rows_of_one_id_and_long_texts_are_dealt_over_parts(spark):
    same = spark.range(400).selectExpr("7L as doc_id", "repeat('some words here ', 17) as text", "'a' as source")
    parts = K.pack(same, part_tokens=1024).select(F.floor(F.col("sequence_id") / F.lit(1 << 32)).alias("p")).distinct().count()
    assert parts >= 15
    long = spark.createDataFrame([(1, "some words here " * 20_000, "a")], "doc_id long, text string, source string")
    got = K.pack(long, part_tokens=4096, chunk=512)
    assert got.select(F.floor(F.col("sequence_id") / F.lit(1 << 32)).alias("p")).distinct().count() >= 10
    assert got.agg(F.sum("length"), F.max("doc_tokens")).first()[0] == got.first().doc_tokens


def test_any_number_of_sources_keeps_its_shares(spark, monkeypatch):
    monkeypatch.setattr(K, "GROUP", 2)
    docs = spark.range(3000).selectExpr("id as doc_id", "repeat('one two three ', 30) as text", "concat('s', id % 300) as source")
    got = K.pack(docs, part_tokens=60_000).toPandas()
    assert got.source.nunique() == 300
    own = got.groupby("source").length.sum()
    assert own.min() == own.max()
    targets = {"s0": 0.5, "s1": 0.5}
    two = K.pack(docs.where("source in ('s0', 's1')").union(docs.where("source = 's0'")), targets=targets, window=64, least=8, part_tokens=1 << 20).toPandas()
    first = two[two.sequence_id.isin(sorted(two.sequence_id.unique())[:5])]
    assert first[first.source == "s0"].length.sum() == pytest.approx(first.length.sum() / 2, rel=0.1)


def test_sums_before_parts(spark, monkeypatch):
    monkeypatch.setattr(K, "GROUP", 3)
    cells = spark.createDataFrame([(p, q, 10 * p + len(q)) for p in range(11) for q in ("a", "bb") if (p + len(q)) % 3], "part long, queue string, n long")
    got = {(r.part, r.queue): r.before for r in K._before(cells, "queue").collect()}
    rows = cells.collect()
    assert got == {(r.part, r.queue): sum(x.n for x in rows if x.queue == r.queue and x.part < r.part) for r in rows}


def test_deficits_keep_the_mixture():
    r = np.random.default_rng(0)
    queues = [r.integers(50, 400, n).tolist() for n in (300, 200, 100)]
    share = np.array([sum(q) for q in queues], float)
    share /= share.sum()
    used, worst, done = np.zeros(3), 0.0, 0
    for q, _, _, n, _, _ in K.round_robin(queues, share, np.zeros(3), 1024, 256):
        used[q] += n
        done += n
        if done < 0.9 * sum(map(sum, queues)):
            worst = max(worst, np.abs(used - share * done).max())
    assert worst < 2048 and done == sum(map(sum, queues))


def test_archives_round_trip(spark, sf):
    assert_same(op10_warc(spark, sf).toPandas(), connection(sf).execute(ORACLES["op10_warc"]).df())


def test_odd_pages_and_segments(spark, tmp_path):
    long = "é漢字\r\n\r\nWARC/1.1\r\n" * 9000
    big = (1 << 60) + 1
    rows = [(big, "u", "a large id"), (1, "http://a/ b\r\n", long), (2, None, long), (3, "u", None), (4, "u", ""), (5, "u", "x"), (5, "u", "x"), (None, "u", "x"), (None, "v", "only nobody")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    W.write_archives(pages, path)
    got = W.read_archives(spark, path, with_payload=True).toPandas()
    assert len(got) == 9 and (got.page_id == big).sum() == 1
    by = {(r.page_id, r.record_type): r for r in got.itertuples()}
    assert bytes(by[2, "response"].payload).decode() == long and by[1, "revisit"].refers_to == 2 and by[3, "revisit"].refers_to == 4
    assert by[1, "revisit"].payload_bytes == len(long.encode()) and by[1, "revisit"].payload_digest == by[2, "response"].payload_digest
    assert sorted(got[got.page_id == 5].record_type) == ["response", "revisit"]
    assert set(W.round_trip(pages, least=2).where("payload_bytes < 2").toPandas().record_type) == {"response"}
    assert W.round_trip(pages.limit(0)).count() == 0


def test_archives_of_many_members(spark, tmp_path, monkeypatch):
    import gzip

    monkeypatch.setattr(W, "PART_BYTES", 7)
    monkeypatch.setattr(W, "BATCH_BYTES", 100)
    digest = lambda t: hashlib.sha1(t.encode()).hexdigest()
    texts = {1: "first", 2: "second é " * 50, 3: "", 4: "fourth"}
    made = [[(r + "\r\n\r\n").encode() for r in W.records_of(str(i), "u", t, digest(t), "response", None, i, 60)] for i, t in texts.items()]
    each = b"".join(gzip.compress(r) for page in made for r in page)  # a member a record
    two = b"".join(gzip.compress(b"".join(b"".join(p) for p in half)) for half in (made[:2], made[2:])) + b"\0" * 8
    plain = b"".join(r for page in made for r in page)
    for name, content in (("each", each), ("two", two), ("plain", plain)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc.gz").write_bytes(content)
        got = {r.page_id: bytes(r.payload).decode() for r in W.read_archives(spark, f"file://{tmp_path}/{name}", with_payload=True).collect()}
        assert got == texts
    with pytest.raises(ValueError):
        list(W.members(each[:-20]))
    assert b"".join(W.members(gzip.compress(b"abc" * 9) + gzip.compress(b"d"))) == b"abc" * 9 + b"d"


def test_repeated_pages_have_one_response(spark):
    rows = [(9, "u", "same"), (9, "u", "same"), (9, "a", "same"), (9, None, "same"), (9, None, "same"), (3, "u", "same"), (None, "u", "same"), (5, "u", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = W.round_trip(pages.repartition(4)).toPandas()
    assert len(got) == 8 and (got.record_type == "response").sum() == 2
    assert set(got[got.record_type == "revisit"].refers_to) == {9}


def test_broken_archives(spark):
    good = W.records_of("1", "u", "abc" * 99, "00" * 20, "response", None, 0, 40)
    raw = "".join(r + "\r\n\r\n" for r in good).encode()
    assert len(list(W.parse(raw))) == len(good)
    with pytest.raises(ValueError):
        list(W.parse(raw[:-2]))
    with pytest.raises(ValueError):
        W.unchunked(b"5\r\nabc\r\n0\r\n\r\n")
