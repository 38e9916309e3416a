import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from anisomap.llm import decontamination as D
from anisomap.llm import fmindex as I
from anisomap.llm import neardup as N
from anisomap.llm import suffixtree as S
from anisomap.llm.queries import op3_decontamination, op7_minhash
from anisomap.llm.oracles import ORACLES
from anisomap.operators.components import connected_components
from tests.comparing import assert_same, connection

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


@given(st.lists(st.lists(st.integers(1, 4), max_size=12), min_size=1, max_size=8), st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=4), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_index_finds_all_occurrences(sequences, phrases):
    symbols = np.array([x for s in sequences for x in [*s, 0]], np.int64)
    index = I.FMIndex(symbols, 5, every=3)
    rows = np.zeros((len(phrases), 4), np.int64)
    for i, p in enumerate(phrases):
        rows[i, : len(p)] = p
    lo, hi = index.search(rows, np.array([len(p) for p in phrases]))
    for i, p in enumerate(phrases):
        want = [at for at in range(len(symbols)) if symbols[at : at + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(lo[i], hi[i])).tolist()) == want


def brute_hits(texts, items, window):
    wins = {}
    for i, t in items:
        w = WORD.findall(lower(t or ""))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for t in texts:
        w, hit, its = WORD.findall(lower(t or "")), set(), set()
        for p, found in wins.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    its |= found
        out.append((len(w), len(hit), sorted(its)))
    return out


@given(st.lists(st.text("ab éB.1", max_size=40), min_size=1, max_size=6), st.lists(st.text("ab éB", max_size=15), min_size=1, max_size=4), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_hits_are_those_of_brute_force(texts, items, window):
    items = [(str(i), t) for i, t in enumerate(items)]
    got = [(n, sum(b - a for a, b, _, _ in spans), its) for n, spans, its in D.Phrases(items, window).scan(texts)]
    assert got == brute_hits(texts, items, window)


def test_long_texts_over_several_shards(monkeypatch):
    monkeypatch.setattr(D, "SHARD_WORDS", 16)
    text = " ".join(f"w{i % 37}" for i in range(400))
    item = " ".join(f"w{i}" for i in range(12, 24))
    (n, spans, items), = D.Phrases([("7", item)], 10).scan([text])
    assert (n, sum(b - a for a, b, _, _ in spans), items) == brute_hits([text], [("7", item)], 10)[0]


def test_spans_are_cut_until_none_is_left(spark, odd):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "short item"), (3, None), (None, "lost words"), (2, "short item")], "item_id long, text string")
    rows = [(1, "Before. One two three four five SIX seven, eight nine ten! after"), (2, "a short short item item b"), (3, None), (4, "lost words stay"), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in D.remove_spans(docs, bench).collect()}
    assert got[4] == "lost words stay" and got[3] is None and got[5] == ""
    assert "two" not in got[1].lower() and got[1].startswith("Before.") and got[1].endswith("after")
    assert D.contamination(D.remove_spans(docs, bench), bench).where("contaminated").count() == 0
    many = {r.doc_id: r.text for r in D.remove_spans(docs, bench, block_chars=20).collect()}
    assert many.keys() == got.keys() and D.contamination(D.remove_spans(docs, bench, block_chars=20), bench).where("contaminated").count() == 0
    blocks = D.find_hits(docs, bench, block_chars=20).select("doc_id", "hits.*").toPandas().sort_values("doc_id")
    one = D.find_hits(docs, bench).select("doc_id", "hits.*").toPandas().sort_values("doc_id")
    assert_same(blocks, one)
    out = D.contamination(odd, bench)
    assert out.count() == odd.count() and D.contamination(odd.limit(0), bench.limit(0)).count() == 0
    assert out.where("doc_id = 1").first().n_words == 0


def test_queries_give_what_sql_gives(spark, sf):
    con = connection(sf)
    assert_same(op3_decontamination(spark, sf).toPandas(), con.execute(ORACLES["op3_decontamination"]).df())
    assert_same(op7_minhash(spark, sf).toPandas(), con.execute(ORACLES["op7_minhash"]).df())


def brute_components(texts, size, percent):
    space = re.compile(rb"[^\x20\x09-\x0D]+")
    sets = {}
    for i, t in texts:
        w = space.findall(re.sub(b"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        s = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        sets[i] = s
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize(("size", "chunk"), [(2, 512), (2, 4), (5, 512)])
def test_components_are_those_of_brute_force(spark, monkeypatch, size, chunk):
    monkeypatch.setattr(N, "CHUNK", chunk)
    r = np.random.default_rng(size)
    rows, base = [], [f"w{i}" for i in r.integers(0, 500, 60)]
    for i in range(60):  # a chain of copies, each a little further from the first, and some others
        words = list(base)
        for k in r.choice(60, i // 6, replace=False):
            words[k] = f"x{r.integers(0, 50)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"v{x}" for x in r.integers(0, 400, 40))) for i in range(10)]
    rows += [(200, None), (201, ""), (202, "One"), (203, "one"), (204, " \t "), (205, "two words"), (206, "two words")]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size).collect()}
    assert got == brute_components(rows, size, 80)


def test_near_duplicates_of_odd_rows(spark, odd):
    got = N.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[4].component_id == 3 and not by[4].kept and by[3].kept and by[1].kept and by[None].component_id is None
    assert N.near_duplicates(odd.limit(0)).count() == 0
    kept = N.keep_one(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {None, 1, 2, 3, 5, 6, 7, 8}
    twice = spark.createDataFrame([(1, "a b c d e f g h"), (5, "a b c d e f g h"), (5, "q r s t u v w x"), (9, "q r s t u v w x")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in N.near_duplicates(twice).collect()} == {(1, 1), (5, 1), (9, 1)}


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=14))
@settings(max_examples=5, deadline=None)
def test_star_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long") if edges else spark.createDataFrame([], "a long, b long")
    root = {i: i for e in edges for i in e}
    for _ in range(20):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    touched = {i for a, b in edges if a != b for i in (a, b)}
    assert {(r.id, r.root) for r in connected_components(df).collect()} == {(i, root[i]) for i in touched}


def test_signatures_estimate_similarity():
    a = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64))
    x, y = a[:800], a[200:]
    s = N.signatures([x, y])
    assert (s[0] == s[1]).mean() == pytest.approx(0.6, abs=0.12)


def tokens(t):
    return (t or "").encode().translate(S._LOWER).split() + [b"\n"]


def test_base_scores_and_counts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r for r in S.lm_scores(docs, word_share=1e-3).collect()}
    rows = docs.select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).alias("out")).collect()
    c = Counter(w for r in rows if not r.out for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    for r in rows:
        t, g = tokens(r.text), got[r.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (r.out, len(t), sum(w in c for w in t), n)
        assert g.base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
        assert g.score < 0


def test_held_out_scores_are_better_than_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    row = S.lm_scores(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert row[0] > row[1]


def test_tree_is_a_distribution_of_the_longest_suffix(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    texts = [r.text for r in docs.collect()]
    p, streams = brute_model(texts, [True] * len(texts))
    _, grams = S.counted(docs, F.lit(True))
    rows = S.gram_logs(grams, 0.002).collect()
    seen = {s[at - S.DEPTH : at + 1] for s in streams for at in range(S.DEPTH, len(s))}
    assert len(rows) == len(seen) and sum(r.m for r in rows) == sum(len(s) - S.DEPTH for s in streams)
    for r in rows:
        gram = int(r.key).to_bytes(8, "big", signed=True)[-S.DEPTH - 1 :]
        assert gram in seen and r.log == pytest.approx(np.log10(p(gram[:-1])[gram[-1]]), rel=1e-9)
        assert p(gram[:-1]).sum() == pytest.approx(1)


def test_counting_is_bounded(spark, monkeypatch):
    """Letters by chance have a gram at every place: what a task holds is handed on, and sums are the same."""
    r = np.random.default_rng(0)
    texts = ["".join(map(chr, r.integers(33, 127, 3000))) + " end" for _ in range(30)]
    frames = [pd.DataFrame({"text": texts[i : i + 3], "train": [True, False, True]}) for i in range(0, 30, 3)]
    count = lambda: pd.concat(S._counting(iter(frames))).groupby(["kind", "key"])[["n", "m"]].sum()
    want = count()
    monkeypatch.setattr(S, "HELD", 5000)
    monkeypatch.setattr(S, "BLOCK_BYTES", 4000)
    parts = list(S._counting(iter(frames)))
    assert len(parts) > 10 and max(map(len, parts)) < 5000 + 2 * 4000
    assert count().equals(want)


def test_scores_of_odd_rows(spark, odd):
    got = S.lm_scores(odd)
    assert got.count() == odd.count()
    empty = {r.doc_id: r for r in got.where("doc_id in (1, 2)").collect()}
    assert empty[1].n_tokens == 1 and empty[1].score == pytest.approx(empty[2].score)
    assert S.lm_scores(odd.limit(0)).count() == 0
    none = S.lm_scores(odd.where("doc_id = 3"), modulus=1, held_out=0).first()
    assert none.train_tokens == 0 and none.base_score == 0 and none.score < 0


def brute_model(texts, train, divergence=0.002):
    """Distributions after all contexts, by dictionaries, and the texts' bytes."""
    streams = [bytes([S.END] * S.DEPTH) + b" ".join(tokens(t)[:-1]) + b"\n" for t in texts]
    counts = {}
    for s, own in zip(streams, train, strict=True):
        for at in range(S.DEPTH, len(s)) if own else ():
            for k in range(S.DEPTH + 1):
                counts.setdefault(s[at - k : at], Counter())[s[at]] += 1
    known = {}

    def p(context):
        if context not in known:
            c = counts.get(context, Counter())
            n = np.bincount(list(c), list(c.values()), 256) if c else np.zeros(256)
            if not context:
                known[context] = (n + 1) / (n.sum() + 256)
            else:
                below = p(context[1:])
                mixed = (n + len(c) * below) / (n.sum() + len(c)) if c else below
                known[context] = mixed if (mixed * np.log(mixed / below)).sum() >= divergence else below
        return known[context]

    return p, streams


def brute_scores(texts, train):
    p, streams = brute_model(texts, train)
    return [sum(np.log10(p(s[at - S.DEPTH : at])[s[at]]) for at in range(S.DEPTH, len(s))) for s in streams]


def test_all_contexts_and_bytes_count_at_any_size(spark, monkeypatch):
    # Many bytes, and contexts that are a small part of the text.
    rows = [(i, " ".join(f"w{(i * 7 + j) % 23}" for j in range(60))) for i in range(40)]
    rows += [(100 + i, "".join(chr(c) for c in range(0x3B1, 0x3C9)) + " Ж" + "".join(chr(c) for c in range(0x430, 0x450)) + " qu!z") for i in range(6)]
    rows += [(200, None), (201, ""), (None, "été 12"), (202, bytes(range(0x21, 0x7F)).decode())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(S, "HEAD", 20)
    got = {r.doc_id: r for r in S.lm_scores(docs).collect()}
    want = brute_scores([t for _, t in rows], [not got[i].held_out for i, _ in rows])
    assert any(r.held_out for r in got.values())
    for (i, _), w in zip(rows, want, strict=True):
        assert got[i].score == pytest.approx(w, rel=1e-9)
