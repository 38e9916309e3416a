"""op11 to op13: exact margins, draws against exact distributions, SQL, and brute force with small bounds."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from anisomap.llm import divergence as D
from anisomap.llm import filteraudit as A
from anisomap.llm import mixing as M
from anisomap.llm.oracles import ORACLES
from anisomap.llm.queries import op11_mixing, op12_filter_audit, op13_divergence
from tests.comparing import assert_same, connection


def filled(sizes: list[float], weights=(5, 2, 1), share=1.5, most=2) -> np.ndarray:
    """Targets by the rule itself: shares by weight, excess shared again, until none is above."""
    s, w = np.array(sizes, float), np.resize(np.array(weights, float), len(sizes))
    full, t = np.zeros(len(s), bool), np.zeros(len(s))
    while not full.all():
        rest = share * s.sum() - most * s[full].sum()
        t = np.where(full, most * s, rest * w / w[~full].sum())
        if not (more := ~full & (t > most * s)).any():
            break
        full |= more
    return np.minimum(t, most * s)


def test_mixture_of_all_documents(spark, small):
    got = op11_mixing(spark, small).toPandas()
    docs = spark.read.parquet(f"{small}/documents.parquet").toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id)
    size = {k: len((t or "").encode().split()) for k, t in zip(docs.doc_id, docs.text, strict=True)}
    assert (got["size"] == got.doc_id.map(size)).all() and (got.taken <= 2 * got["size"]).all()
    got["source"] = got.doc_id.map(dict(zip(docs.doc_id, docs.source, strict=True)))
    by = got.groupby("source").agg({"size": "sum", "source_size": ["min", "max"], "target": "first", "taken": "sum"})
    by.columns = ["size", "low", "high", "target", "taken"]
    assert (by["size"] == by.low).all() and (by["size"] == by.high).all()
    assert np.allclose(by.target, filled(by["size"].tolist()), rtol=1e-12)
    assert (abs(by.taken - by.target) <= 0.001 * by.target + 1).all()
    assert_same(got.drop(columns="source"), op11_mixing(spark, small).toPandas())


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1000, 10], [0, 5, 0], [7], [0], [1000, 1, 1, 1, 1, 1000]])
def test_targets(spark, sizes):
    rows = [(f"s{i}", x) for i, x in enumerate(sizes)]
    got = M.source_targets(spark.createDataFrame(rows, "source string, size long")).orderBy("number").collect()
    assert [r.source for r in got] == [r[0] for r in rows] and np.allclose([r.target for r in got], filled(sizes))


def test_hypergeometric_draws_follow_their_distribution(spark):
    n, k, m, draws = 60, 25, 18, 20_000
    x = lambda v: F.lit(v).cast("long")
    got = spark.range(draws).select(M.hypergeometric(x(n), x(k), x(m), M._uniform(F.lit(3), F.col("id"))).alias("x")).groupBy("x").count().collect()
    p = {i: math.comb(k, i) * math.comb(n - k, m - i) / math.comb(n, m) for i in range(m + 1)}
    seen = {r.x: r["count"] for r in got}
    chi = sum((seen.get(i, 0) - draws * q) ** 2 / (draws * q) for i, q in p.items() if draws * q >= 5)
    assert set(seen) <= set(p) and chi < 45  # 14 degrees of freedom
    # All uniform numbers, by the exact inverse outwards from the mode, and extreme arguments.
    mode = (k + 1) * (m + 1) // (n + 2)
    edges, at = np.cumsum([p.get(i, 0) for i in [mode, *(v for j in range(1, n) for v in (mode + j, mode - j))]]), [0.01 + 0.02 * i for i in range(49)]
    order = [mode, *(v for j in range(1, n) for v in (mode + j, mode - j))]
    us = spark.createDataFrame([(u,) for u in at], "u double")
    assert [r[0] for r in us.select(M.hypergeometric(x(n), x(k), x(m), F.col("u"))).collect()] == [order[int(np.searchsorted(edges, u, "right"))] for u in at]
    big = [(10**9, 10**9, 5), (10**9, 1, 10**9 - 1), (2 * 10**8, 10**8, 10**8), (1, 0, 1), (1, 1, 0)]
    for a, b, c in big:
        v = spark.range(3).select(M.hypergeometric(x(a), x(b), x(c), M._uniform(F.lit(5), F.col("id")))).collect()
        assert all(max(0, b + c - a) <= r[0] <= min(b, c) for r in v)
    mid = spark.range(200).select(M.hypergeometric(x(2 * 10**6), x(10**6), x(10**6), M._uniform(F.lit(7), F.col("id"))).alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    assert abs(mid[0] - 5 * 10**5) < 4 * 354 / 14 and 300 < mid[1] < 410


def test_splitting_tree_keeps_all_margins(spark):
    quotas = [5000, 17, 0, 1, 900, 3]
    sources = spark.createDataFrame([(i, max(1, q // 2), q) for i, q in enumerate(quotas)], "number int, blocks long, quota long")
    got = M.split_quotas(sources, 16, 0).toPandas()
    assert got.groupby("number").visits.sum().to_dict() == {i: q for i, q in enumerate(quotas) if q}
    assert set(got.groupby("shard").visits.sum()) <= {sum(quotas) // 16, sum(quotas) // 16 + 1} and got.shard.nunique() == 16
    for number, own in got.sort_values(["number", "start"]).groupby("number"):
        assert own.start.tolist() == [0, *np.cumsum(own.visits)[:-1]]
        assert (abs(own.visits - quotas[number] / 16) <= 6 * math.sqrt(quotas[number] / 16) + 1).all()
    assert_same(got, M.split_quotas(sources, 16, 0).toPandas())
    assert M.split_quotas(sources.where("quota < 0"), 4, 0).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(M.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(1), F.lit("a"))).collect()]
    assert sorted(got) == list(range(n))
    if n == 1000:
        assert abs(np.corrcoef(got, range(n))[0, 1]) < 0.15 and sum(a == b for a, b in enumerate(got)) < 10


def test_shards_of_a_mixture(spark, docs):
    mix = M.mix(docs, shard=8000).toPandas()
    assert mix.shard.nunique() == 16 and (mix.groupby("shard").position.apply(lambda p: sorted(p) == list(range(1, len(p) + 1)))).all()
    sizes = {r.doc_id: r.n for r in docs.select("doc_id", M.word_count("text").alias("n")).collect()}
    seen = Counter()
    for r in mix.itertuples():
        assert r.length > 0 and 0 <= r.start and r.start + r.length <= sizes[r.doc_id]
        seen.update((r.doc_id, w) for w in range(r.start, r.start + r.length))
    assert max(seen.values()) <= 2
    full = M._blocks(M.source_targets(docs.select("source", M.word_count("text").alias("size")))).toPandas()
    for name, own in mix.groupby("source"):
        row = full[full.source == name].iloc[0]
        if row.target == 2 * row.source_size:
            assert own.length.sum() == 2 * row.source_size
        per = own.groupby("shard").length.sum()
        assert len(per) >= min(16, row.quota / 40)


def test_mixing_odd_rows(spark, odd):
    got = M.taken(odd.withColumn("size", F.lit("clash")).withColumn("place", F.lit(1)).withColumn("blocks", F.lit(1))).toPandas()
    assert len(got) == 10 and got[got["size"] == 0].taken.sum() == 0 and (got.taken <= 2 * got["size"]).all()
    sizes = Counter()
    for r in odd.collect():
        sizes[r.source] += len((r.text or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s))
    assert sorted(got.target.unique()) == pytest.approx(sorted(filled([sizes[s] for s in names])))
    assert M.taken(odd.limit(0)).count() == 0 and M.mix(odd.where("text is null")).count() == 0
    whole = got.groupby("source_size").agg({"taken": "sum", "target": "first"})
    assert (abs(whole.taken - whole.target) <= 1 + 0.001 * whole.target).all()


def masks(rows):
    """(part, mask, good, toxic) by the definitions, one by one."""
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t, lang, q, x in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > first[t]]
        yield lang or "", f, q == 1, x == 1


def test_filter_audit_is_what_sql_gives(spark, small):
    assert_same(op12_filter_audit(spark, small).toPandas(), connection(small).execute(ORACLES["op12_filter_audit"]).df())


def test_filter_audit_by_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(300))
    texts = [(1, None, None), (2, "", "en"), (3, long, "en"), (3, long, "en"), (4, long, "en"), (4, long, "fr"), (5, "A B# " * 300, ""), (6, "a " * 500_000, "de"), (None, long, "en"), (None, None, "en"), (7, long + " Ü$", "en")]
    marks = [(3, 1, 0), (3, 0, 1), (4, 1, None), (5, 0, 1), (9, 1, 1), (None, 1, 1), (6, None, 1)]
    docs = spark.createDataFrame([(i, t, g, 1, 2) for i, t, g in texts], "doc_id long, text string, lang string, mask int, part int")
    labels = spark.createDataFrame([(*m, "x") for m in marks], "doc_id long, quality int, toxic int, text string")
    got = A.audit_filters(docs, labels).toPandas()
    best = {i: (max((q for j, q, _ in marks if j == i and q is not None), default=None), max((t for j, _, t in marks if j == i and t is not None), default=None)) for i in {t[0] for t in texts} if i is not None}
    rows = list(masks([(i, t, g, *best.get(i, (None, None))) for i, t, g in texts]))
    assert set(got.part) == {"", "en", "fr", "de"} and len(got) == 4 * 600
    for r in got.itertuples():
        at = ["ABCDE".index(x) for x in r.filter_order]
        own = [(f, q, x) for g, f, q, x in rows if g == r.part]
        before, now = at[: r.step - 1], at[r.step - 1]
        gone = [(q, x) for f, q, x in own if f[now] and not any(f[b] for b in before)]
        want = (
            sum(not any(f[b] for b in at[: r.step]) for f, _, _ in own), len(gone), sum(f[now] and any(f[b] for b in before) for f, _, _ in own),
            sum(f[now] and sum(f) == 1 for f, _, _ in own), sum(q for q, _ in gone), sum(x for _, x in gone),
        )
        assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) == want
    assert (got.groupby(["part", "filter_order"]).removed.sum() * 120 == got.drop_duplicates(["part", "shapley", "filter_order", "step"]).groupby(["part", "filter_order"]).shapley.sum()).all()
    assert A.audit_filters(docs.limit(0), labels).count() == 0 and A.audit_filters(docs, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def by_hand(rows, least):
    groups, df, n = {(g or "", s or "") for g, s, _ in rows}, Counter(), defaultdict(Counter)
    for g, s, t in rows:
        words = ["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
        df.update((g or "", w) for w in set(words))
        n[g or "", s or ""].update(words)
    kept = defaultdict(list)
    for (g, w), c in df.items():
        if c >= least:
            kept[g].append(w)
    out = set()
    for g in {g for g, _ in groups}:
        names, v = sorted(s for h, s in groups if h == g), kept[g]
        total = {s: sum(n[g, s][w] for w in v) for s in names}
        p = {s: {w: 1 + 10**9 * (n[g, s][w] + 5) // (total[s] + 5 * len(v)) for w in v} for s in names}
        q = {w: 1 + 10**9 * (sum(n[g, s][w] for s in names) + 5) // (sum(total.values()) + 5 * len(v)) for w in v}
        for s in names:
            pairs = [(u, sum(abs(p[s][w] - p[u][w]) for w in v)) for u in names if u != s]
            best = [(w, p[s][w] - q[w]) for w in v if n[g, s][w] > 0 and p[s][w] > q[w]]
            for part, found in (("pair", pairs), ("term", best)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(g, s, part, i, x, r) for r, (i, x) in enumerate(found, 1) if part == "pair" or r <= 50}
    return out


def test_divergence_is_what_sql_gives(spark, small):
    assert_same(op13_divergence(spark, small).toPandas(), connection(small).execute(ORACLES["op13_divergence"]).df())


def test_divergence_by_brute_force(spark, odd):
    r = np.random.default_rng(1)
    rows = [(str(r.choice(["en", "de"])), f"s{r.integers(5)}", " ".join(f"W{'abcdefghij'[i % 10] * (1 + i // 10)}é" for i in r.zipf(1.4, 30) % 90)) for _ in range(300)]
    rows += [(None, None, None), (None, "s1", "one Two"), ("en", None, ""), ("fr", "s0", "mot"), ("fr", "s0", "mot"), ("fr", "s9", "12 ...")]
    docs = spark.createDataFrame([(i % 250, *x, "clash", 1) for i, x in enumerate(rows)], "doc_id long, lang string, source string, text string, term string, n int")
    got = {tuple(x) for x in D.divergence(docs, least=3).select("lang", "source", "part", "item", "value", "rank").collect()}
    assert got == by_hand(rows, 3)
    assert D.divergence(docs.limit(0)).count() == 0
    assert {tuple(x) for x in D.divergence(odd, least=2).select("lang", "source", "part", "item", "value", "rank").collect()} == by_hand([(x.lang, x.source, x.text) for x in odd.collect()], 2)


def test_scans_in_small_steps(monkeypatch):
    """Partial counts handed on early, runs over batches, chunks of a block, and tiles of sources give the same sums."""
    r = np.random.default_rng(2)
    rows = [("en", f"s{r.integers(7)}", " ".join("abcdefgh"[i] * 2 for i in r.integers(0, 8, 12))) for _ in range(120)]
    frame = pd.DataFrame([(g, s, i, t.encode()) for i, (g, s, t) in enumerate(rows)], columns=["lang", "source", "document", "raw"])
    batch = lambda rows: pa.RecordBatch.from_pandas(rows, preserve_index=False)
    monkeypatch.setattr(D, "HELD", 5)
    monkeypatch.setattr(D, "ROWS", 7)
    monkeypatch.setattr(D, "CELLS", 30)
    monkeypatch.setattr(D, "TILE", 3)
    partial = pa.Table.from_batches(D._partial(iter([batch(frame[:50]), batch(frame[50:])]))).to_pandas().sort_values(["lang", "term", "source", "document"])
    assert len(partial) > 60
    kept = pa.Table.from_batches(D._scan_terms(3)(iter([batch(partial[i : i + 4]) for i in range(0, len(partial), 4)]))).to_pandas()
    sums = kept.groupby("source", as_index=False).n.sum().assign(lang="en", kind=0, term="", v=int(kept["first"].sum()))
    body = kept[kept.term != ""].assign(kind=1, v=0)
    found = []
    for tile in range(3):
        sort = pd.concat([sums, body])[["lang", "kind", "term", "source", "n", "v"]].assign(block=0, tile=tile).sort_values(["kind", "term", "source"])
        found += list(D._scan_blocks(iter([sort[i : i + 5] for i in range(0, len(sort), 5)])))
    got = pd.concat(found)
    want = {x[:5] for x in by_hand(rows, 3)}
    assert set(got.itertuples(index=False, name=None)) == want


def test_exact_shares():
    r = np.random.default_rng(3)
    whole = r.integers(1, 9 * 10**15, 2000)
    count = (whole * r.random(2000)).astype(np.int64)
    assert D.scaled(count, whole).tolist() == [1 + 10**9 * int(c) // int(w) for c, w in zip(count, whole, strict=True)]
