"""Queries of pair selection, sampling, weighting, stress and fuzzy graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from anisomap.functions import metrics as M
from anisomap.functions import vectors as V
from anisomap.operators import fuzzy as U
from anisomap.operators import objectives as O
from anisomap.operators import pairs as P
from anisomap.plans.inputs import EDGE, EMB, KNN, PTS, cluster_edges, direct_pairs, embedding, hashed, knn, labels, points, sql

R = V.rounded
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


#: Directed neighbour dissimilarities, and weights that leave out some pairs.
_K = "k AS (SELECT src, dst, dist AS d FROM knn)"
_W = "w AS (SELECT src, dst, CASE WHEN (src + dst) % 7 = 0 THEN 0.0 ELSE 1.0 + (src % 3) END AS w FROM knn)"
_ALLOWED = "p AS (SELECT k.src, k.dst, d, w FROM k JOIN w ON w.src = k.src AND w.dst = k.dst WHERE k.src <> k.dst AND w <> 0)"
_SYM = "sy AS (SELECT src, dst, avg(d) AS s FROM (SELECT src, dst, d FROM k UNION ALL SELECT dst, src, d FROM k) GROUP BY 1, 2)"
_LOCAL = "lo AS (SELECT src, dst, d, w FROM (SELECT p.*, row_number() OVER (PARTITION BY p.src ORDER BY s, p.dst) AS r FROM p JOIN sy ON sy.src = p.src AND sy.dst = p.dst) WHERE r <= 3)"


_MARKS = f"lm AS (SELECT id FROM pts ORDER BY {hashed(7, 'id')}, id LIMIT 50)"


def dissim(s, d, near=None):
    return direct_pairs(s, d, near).select("src", "dst", "d")


def weights(near):
    w = F.when((F.col("src") + F.col("dst")) % 7 == 0, 0.0).otherwise(1.0 + F.col("src") % 3)
    return near.select("src", "dst", w.alias("w"))


def allowed(s, d, near=None):
    near = knn(s, d) if near is None else near
    return P.allowed_pairs(dissim(s, d, near), weights(near))


def local(s, d, near):
    return P.local_pairs(allowed(s, d, near), dissim(s, d, near), 3)


@query("allowed_pairs", sql(PTS, KNN, _K, _W, _ALLOWED, body="SELECT src, dst, round(d, 6) AS d, w::DOUBLE AS w FROM p"))
def allowed_pairs(s, d):
    return allowed(s, d).select("src", "dst", R("d").alias("d"), "w")


@query("symmetric_selection", sql(PTS, KNN, _K, _SYM, body="SELECT src, dst, round(s, 6) AS s FROM sy"))
def symmetric_selection(s, d):
    return P.symmetric_selection(dissim(s, d)).select("src", "dst", R("s").alias("s"))


@query("local_pairs", sql(PTS, KNN, _K, _W, _ALLOWED, _SYM, _LOCAL, body="SELECT src, dst, round(d, 6) AS d FROM lo"))
def local_pairs(s, d):
    return local(s, d, knn(s, d)).select("src", "dst", R("d").alias("d"))


@query("landmark_pairs", sql(PTS, KNN, _K, _W, _ALLOWED, _SYM, _LOCAL, _MARKS, body="SELECT p.src, p.dst, round(p.d, 6) AS d FROM p JOIN lm ON lm.id = p.src ANTI JOIN lo ON lo.src = p.src AND lo.dst = p.dst"))
def landmark_pairs(s, d):
    marks = P.select_landmarks(points(s, d), 50, seed=7)
    near = knn(s, d)
    return P.landmark_pairs(allowed(s, d, near), marks, local(s, d, near)).select("src", "dst", R("d").alias("d"))


@query("sampled_pairs", sql(PTS, KNN, _K, _W, _ALLOWED, body=f"""SELECT src, dst, round(d, 6) AS d, round(w * greatest(1.0, n / 4.0), 6) AS w FROM
  (SELECT *, row_number() OVER (PARTITION BY src ORDER BY {hashed(3, 'src', 'dst')}, dst) AS r, count(*) OVER (PARTITION BY src) AS n FROM p) WHERE r <= 4"""))
def sampled_pairs(s, d):
    return P.sample_targets(allowed(s, d), 4, seed=3).select("src", "dst", R("d").alias("d"), R("w").alias("w"))


@query("merged_pairs", sql(PTS, KNN, _K, _W, _ALLOWED, _SYM, _LOCAL, body="SELECT src, dst, round(d, 6) AS d, w::DOUBLE AS w FROM p UNION ALL SELECT src, dst, round(d, 6), w FROM lo"))
def merged_pairs(s, d):
    near = knn(s, d)
    return P.merge_pairs(allowed(s, d, near), local(s, d, near).select("src", "dst", "d", "w")).select("src", "dst", R("d").alias("d"), "w")


@query("pair_totals", sql(PTS, KNN, _K, _W, _ALLOWED, body="SELECT count(*) AS n_pairs, count(DISTINCT src) AS n_sources, round(sum(w), 6)::DOUBLE AS mass, round(sum(w * d * d), 6) AS denom FROM p"))
def pair_totals(s, d):
    return P.pair_totals(allowed(s, d)).select("n_pairs", "n_sources", R("mass").alias("mass"), R("denom").alias("denom"))


_REST = "re AS (SELECT p.* FROM p ANTI JOIN lo ON lo.src = p.src AND lo.dst = p.dst)"


def _group_reweight(s, d, mode):
    near = knn(s, d)
    return P.build_pairs(dissim(s, d, near), weights(near), n_local=3, mode=mode, local_weight=0.5).select("src", "dst", "grp", R("w").alias("w"))


for _mode, _sum in (("count", "w"), ("energy", "w * d * d")):
    QUERIES[f"group_reweight_{_mode}"] = lambda s, d, m=_mode: _group_reweight(s, d, m)
    ORACLES[f"group_reweight_{_mode}"] = sql(
        PTS, KNN, _K, _W, _ALLOWED, _SYM, _LOCAL, _REST, f"ms AS (SELECT (SELECT sum({_sum}) FROM lo) AS ml, (SELECT sum({_sum}) FROM re) AS mr)",
        body="SELECT src, dst, 'local' AS grp, round(w * 0.5 * greatest(ml, mr) / ml, 6)::DOUBLE AS w FROM lo, ms UNION ALL SELECT src, dst, 'global', round(w * greatest(ml, mr) / mr, 6) FROM re, ms",
    )

_CW = "sz AS (SELECT label, count(*) AS n FROM pts GROUP BY 1), cw AS (SELECT id, sqrt((SELECT quantile_cont(n, 0.5) FROM sz) / n) AS w FROM pts JOIN sz USING (label))"


@query("cluster_weights", sql(PTS, _CW, body="SELECT id, round(w, 6) AS w FROM cw"))
def cluster_weights(s, d):
    return P.cluster_weights(labels(s, d)).select("id", R("w").alias("w"))


_DM = "dm AS (SELECT quantile_cont(d, 0.5) AS m FROM k WHERE d > 0)"


@query("distance_reweight", sql(PTS, KNN, _K, _DM, body="SELECT src, dst, round(pow(d / m + 0.000001, -2), 6) AS w FROM k, dm"))
def distance_reweight(s, d):
    return P.distance_weights(direct_pairs(s, d), 2.0).select("src", "dst", R("w").alias("w"))


@query("normalized_weights", sql(PTS, KNN, _K, _DM, body="SELECT src, dst, round(pow(d / m + 0.000001, -1) / avg(pow(d / m + 0.000001, -1)) OVER (), 6) AS w FROM k, dm"))
def normalized_weights(s, d):
    return P.normalized_weights(P.distance_weights(direct_pairs(s, d))).select("src", "dst", R("w").alias("w"))


_FRONT = "bo AS (SELECT src, dst FROM knn JOIN pts a ON a.id = src JOIN pts b ON b.id = dst WHERE b.label = (a.label + 1) % 10), bs AS (SELECT src, dst FROM bo UNION SELECT dst, src FROM bo)"


@query("frontier_weights", sql(PTS, KNN, _K, _FRONT, body="SELECT k.src, k.dst, CASE WHEN bs.src IS NOT NULL THEN 3.0 ELSE 1.0 END::DOUBLE AS w FROM k LEFT JOIN bs ON bs.src = k.src AND bs.dst = k.dst"))
def frontier_weights(s, d):
    from anisomap.operators.evaluate import boundary_plan

    near = knn(s, d)
    plan = boundary_plan(labels(s, d), cluster_edges(s), near)
    return P.frontier_weights(direct_pairs(s, d, near), plan, 3.0).select("src", "dst", "w")


@query("pair_weight_pipeline", sql(PTS, KNN, _K, _CW, _FRONT, "c AS (SELECT k.src, k.dst, k.d, a.w * b.w AS w FROM k JOIN cw a ON a.id = k.src JOIN cw b ON b.id = k.dst)", _DM,
    "f AS (SELECT c.src, c.dst, c.w * pow(d / m + 0.000001, -1) * CASE WHEN bs.src IS NOT NULL THEN 3.0 ELSE 1.0 END AS w FROM c LEFT JOIN bs ON bs.src = c.src AND bs.dst = c.dst, dm)",
    body="SELECT src, dst, round(w / avg(w) OVER (), 6) AS w FROM f"))
def pair_weight_pipeline(s, d):
    from anisomap.operators.evaluate import boundary_plan

    near = knn(s, d)
    plan = boundary_plan(labels(s, d), cluster_edges(s), near)
    return P.pair_weight_pipeline(direct_pairs(s, d, near), labels(s, d), 0.5, 1.0, plan, 3.0).select("src", "dst", R("w").alias("w"))


_STRESS = "m AS (SELECT dist AS d, r * (1 + 0.5 * s) AS e FROM e)"


@query("stress_direct", sql(PTS, EMB, KNN, EDGE, _STRESS, body="SELECT count(*) AS n_pairs, round(sum((e - d) * (e - d)), 6) AS raw, round(sum(d * d), 6) AS denom, round(sqrt(sum((e - d) * (e - d)) / sum(d * d)), 6) AS normalized FROM m"))
def stress_direct(s, d):
    got = O.stress(O.with_lengths(direct_pairs(s, d), embedding(s, d), M.Randers(0.5)))
    return got.select("n_pairs", *[R(c).alias(c) for c in ("raw", "denom", "normalized")])


@query("hinge_stress", sql(PTS, EMB, KNN, EDGE, _STRESS, body="SELECT round(sum(pow(greatest(0, 0.5 * d - e), 2)), 6) AS raw, round(sum(0.25 * d * d), 6) AS denom, round(sqrt(sum(pow(greatest(0, 0.5 * d - e), 2)) / sum(0.25 * d * d)), 6) AS normalized FROM m"))
def hinge_stress(s, d):
    got = O.hinge_stress(O.with_lengths(direct_pairs(s, d), embedding(s, d), M.Randers(0.5)))
    return got.select(*[R(c).alias(c) for c in ("raw", "denom", "normalized")])


_PULL = "pu AS (SELECT src, dst, 2 * (r * (1 + 0.5 * s) - dist) AS c, u0 / r AS g0, u1 / r AS g1, u2 / r + 0.5 AS g2 FROM e)"


@query("stress_gradient", sql(PTS, EMB, KNN, EDGE, _PULL, body="""SELECT id, round(sum(c * g0), 6) + 0.0 AS g0, round(sum(c * g1), 6) + 0.0 AS g1, round(sum(c * g2), 6) + 0.0 AS g2
  FROM (SELECT dst AS id, c, g0, g1, g2 FROM pu UNION ALL SELECT src, -c, g0, g1, g2 FROM pu) GROUP BY 1"""))
def stress_gradient(s, d):
    g = O.direct_gradient(direct_pairs(s, d), embedding(s, d), M.Randers(0.5))
    return g.select("id", *[R(F.get("g", F.lit(i))).alias(f"g{i}") for i in range(3)])


#: Two-edge paths src -> nearest neighbour of src -> its nearest neighbour, as a frozen table that has no ties.
_TWO = "o AS (SELECT src, dst FROM knn WHERE rank = 1), fz AS (SELECT a.src, b.dst, a.dst AS mid FROM o a JOIN o b ON b.src = a.dst WHERE b.dst <> a.src)"


def frozen(near):
    one = near.where("rank = 1").select("src", "dst")
    b = one.select(F.col("src").alias("mid"), F.col("dst").alias("end"))
    two = one.withColumnRenamed("dst", "mid").join(b, "mid").where("end <> src")
    return two.select("src", F.col("end").alias("dst"), F.explode(F.array(F.struct(F.lit(1).alias("hop"), F.col("src").alias("tail"), F.col("mid").alias("head")), F.struct(F.lit(2).alias("hop"), F.col("mid").alias("tail"), F.col("end").alias("head")))).alias("x")).select("src", "dst", "x.*")


def frozen_pairs(near):
    return frozen(near).select("src", "dst").distinct().select("src", "dst", F.lit(1.0).alias("d"), F.lit(1.0).alias("w"))


_LEN = "le AS (SELECT a.id AS t, b.id AS h, b.y0 - a.y0 AS u0, b.y1 - a.y1 AS u1, b.y2 - a.y2 AS u2, sqrt((b.y0 - a.y0) * (b.y0 - a.y0) + (b.y1 - a.y1) * (b.y1 - a.y1) + (b.y2 - a.y2) * (b.y2 - a.y2)) AS r FROM o JOIN emb a ON a.id = src JOIN emb b ON b.id = dst), lr AS (SELECT t, h, u0, u1, u2, r, r + 0.5 * u2 AS f FROM le)"
_PLEN = "pl AS (SELECT fz.*, a.f + b.f AS plen FROM fz JOIN lr a ON a.t = fz.src AND a.h = fz.mid JOIN lr b ON b.t = fz.mid AND b.h = fz.dst)"


@query("frozen_path_stress", sql(PTS, EMB, KNN, _TWO, _LEN, _PLEN, body="SELECT count(*) AS n_pairs, round(sum((plen - 1) * (plen - 1)), 6) AS raw, round(sqrt(sum((plen - 1) * (plen - 1)) / count(*)), 6) AS normalized FROM pl"))
def frozen_path_stress(s, d):
    near = knn(s, d)
    return O.frozen_stress(frozen(near), frozen_pairs(near), embedding(s, d), M.Randers(0.5)).select("n_pairs", R("raw").alias("raw"), R("normalized").alias("normalized"))


@query("frozen_path_gradient", sql(PTS, EMB, KNN, _TWO, _LEN, _PLEN, """ad AS (SELECT t, h, sum(c) AS c FROM (SELECT src AS t, mid AS h, 2 * (plen - 1) AS c FROM pl UNION ALL SELECT mid, dst, 2 * (plen - 1) FROM pl) GROUP BY 1, 2),
gr AS (SELECT t, h, c * u0 / r AS g0, c * u1 / r AS g1, c * (u2 / r + 0.5) AS g2 FROM ad JOIN lr USING (t, h)), al AS (SELECT h AS id, g0, g1, g2 FROM gr UNION ALL SELECT t, -g0, -g1, -g2 FROM gr)""",
    body="SELECT pts.id, round(coalesce(sum(g0), 0), 6) + 0.0 AS g0, round(coalesce(sum(g1), 0), 6) + 0.0 AS g1, round(coalesce(sum(g2), 0), 6) + 0.0 AS g2 FROM pts LEFT JOIN al ON al.id = pts.id GROUP BY 1"))
def frozen_path_gradient(s, d):
    near = knn(s, d)
    g = O.frozen_gradient(frozen(near), frozen_pairs(near), embedding(s, d), M.Randers(0.5))
    return g.select("id", *[R(F.get("g", F.lit(i))).alias(f"g{i}") for i in range(3)])


def all_pairs(s, d, dist=None, both=False):
    """A dense asymmetric table over all points, as majorization and Gram matrices need all pairs (or of given distances).

    With ``both`` pairs have the other direction's dissimilarity beside their own.
    """
    from anisomap.operators.graph import all_distances, with_vectors

    first = points(s, d).select("id", F.slice("x", 1, 1).alias("x"))
    ends = with_vectors(all_distances(points(s, d)) if dist is None else dist, F.broadcast(first))
    tilted = lambda a, b: F.col("dist") + 0.1 * F.get(b, F.lit(0)) - 0.1 * F.get(a, F.lit(0))
    return ends.select("src", "dst", tilted("a", "b").alias("d"), *[tilted("b", "a").alias("back")] * both)


_ALL = "q AS (SELECT a.id AS src, b.id AS dst, list_distance(a.x, b.x) + 0.1 * b.x[1] - 0.1 * a.x[1] AS d FROM pts a JOIN pts b ON a.id <> b.id)"


@query("centered_gram", sql(PTS, _ALL, "z AS (SELECT a.src, a.dst, pow((a.d + b.d) / 2, 2) AS q FROM q a JOIN q b ON a.src = b.dst AND a.dst = b.src UNION ALL SELECT id, id, 0.0 FROM pts)",
    "rm AS (SELECT src, avg(q) AS m FROM z GROUP BY 1)", body="SELECT z.src, z.dst, round(-0.5 * (q - a.m - b.m + (SELECT avg(m) FROM rm)), 6) + 0.0 AS g FROM z JOIN rm a ON a.src = z.src JOIN rm b ON b.src = z.dst"))
def centered_gram(s, d):
    return O.centered_gram(all_pairs(s, d, both=True)).select("src", "dst", R("g").alias("g"))


@query("smacof_uniform_step", sql(PTS, EMB, _ALL, """v AS (SELECT a.src, (a.d + b.d) / 2 / sqrt((x.y0 - y.y0) * (x.y0 - y.y0) + (x.y1 - y.y1) * (x.y1 - y.y1) + (x.y2 - y.y2) * (x.y2 - y.y2)) AS b, x.y0 - y.y0 AS u0, x.y1 - y.y1 AS u1, x.y2 - y.y2 AS u2, a.d - b.d AS sk
  FROM q a JOIN q b ON a.src = b.dst AND a.dst = b.src JOIN emb x ON x.id = a.src JOIN emb y ON y.id = a.dst), rr AS (SELECT src AS id, sum(b * u0) AS r0, sum(b * u1) AS r1, sum(b * u2) - 0.5 * 0.5 * sum(sk) AS r2 FROM v GROUP BY 1)""",
    body="SELECT id, round((r0 - avg(r0) OVER ()) / (SELECT count(*) FROM pts), 6) + 0.0 AS y0, round((r1 - avg(r1) OVER ()) / (SELECT count(*) FROM pts), 6) + 0.0 AS y1, round((r2 - avg(r2) OVER ()) / ((SELECT count(*) FROM pts) * 1.25), 6) + 0.0 AS y2 FROM rr"))
def smacof_uniform_step(s, d):
    y = O.smacof_uniform_step(all_pairs(s, d, both=True), embedding(s, d), 0.5)
    return y.select("id", *[R(F.get("y", F.lit(i))).alias(f"y{i}") for i in range(3)])


_SCALE = """ro AS (SELECT src AS id, min(dist) FILTER (dist > 0) AS rho, list(dist) AS ds, avg(dist) AS mean FROM knn GROUP BY 1),
bi(h, id, rho, ds, mean, lo, hi, mid) AS (SELECT 0, id, rho, ds, mean, 0.0::DOUBLE, 'infinity'::DOUBLE, 1.0::DOUBLE FROM ro
  UNION ALL SELECT h + 1, id, rho, ds, mean, CASE WHEN v > w THEN lo ELSE mid END, CASE WHEN v > w THEN mid ELSE hi END,
    CASE WHEN v > w THEN (lo + mid) / 2 WHEN hi = 'infinity' THEN mid * 2 ELSE (mid + hi) / 2 END
    FROM (SELECT *, list_sum(list_transform(ds, lambda d: CASE WHEN d > rho THEN exp(-(d - rho) / mid) ELSE 1.0 END)) AS v, log2(10) AS w FROM bi) WHERE h < 64 AND abs(v - w) >= 1e-5),
sc AS (SELECT id, arg_max(rho, h) AS rho, greatest(arg_max(mid, h), 0.000001 * arg_max(mean, h)) AS sigma FROM bi GROUP BY 1)"""
_MEMBER = "me AS (SELECT src, dst, exp(-greatest(0, dist - (a.rho + b.rho) / 2) / (2 * a.sigma * b.sigma / (a.sigma + b.sigma))) AS p FROM knn JOIN sc a ON a.id = src JOIN sc b ON b.id = dst)"


@query("fuzzy_scales", sql(PTS, KNN, _SCALE, body="SELECT id, round(rho, 6) AS rho, round(sigma, 4) AS sigma FROM sc", recursive=True))
def fuzzy_scales(s, d):
    return U.smooth_scales(knn(s, d), 10).select("id", R("rho").alias("rho"), R("sigma", 4).alias("sigma"))


@query("fuzzy_membership", sql(PTS, KNN, _SCALE, _MEMBER, body="SELECT src, dst, round(p, 5) AS p FROM me WHERE p > 0", recursive=True))
def fuzzy_membership(s, d):
    return U.directed_fuzzy_graph(dissim(s, d), 10).select("src", "dst", R("p", 5).alias("p"))


@query("fuzzy_union", sql(PTS, KNN, _SCALE, _MEMBER, body="SELECT coalesce(a.src, b.dst) AS src, coalesce(a.dst, b.src) AS dst, round(coalesce(a.p, 0) + coalesce(b.p, 0) - coalesce(a.p, 0) * coalesce(b.p, 0), 5) AS p FROM me a FULL JOIN me b ON a.src = b.dst AND a.dst = b.src", recursive=True))
def fuzzy_union(s, d):
    return U.fuzzy_union(U.directed_fuzzy_graph(dissim(s, d), 10)).select("src", "dst", R("p", 5).alias("p"))


@query("epochs_per_sample", sql(PTS, KNN, "p AS (SELECT src, dst, exp(-dist) AS p FROM knn)", body="SELECT src, dst, round((SELECT max(p) FROM p) / p, 6) AS every FROM p WHERE (SELECT max(p) FROM p) / p <= 2"))
def epochs_per_sample(s, d):
    p = knn(s, d).select("src", "dst", F.exp(-F.col("dist")).alias("p"))
    return U.epochs_per_sample(p, 2).select("src", "dst", R("every").alias("every"))


def _farthest_sql(n: int = 5) -> str:
    parts = [f"f1 AS (SELECT id FROM pts ORDER BY {hashed(1, 'id')}, id LIMIT 1)"]
    for i in range(2, n + 1):
        chosen = " UNION ALL ".join(f"SELECT id FROM f{j}" for j in range(1, i))
        parts.append(f"f{i} AS (SELECT dst AS id FROM sq WHERE src IN ({chosen}) AND dst NOT IN ({chosen}) GROUP BY dst ORDER BY min(s) DESC, dst LIMIT 1)")
    every = " UNION ALL ".join(f"SELECT id FROM f{j}" for j in range(1, n + 1))
    return sql(PTS, _ALL, "sq AS MATERIALIZED (SELECT src, dst, avg(d) AS s FROM (SELECT src, dst, d FROM q UNION ALL SELECT dst, src, d FROM q) GROUP BY 1, 2)", *parts, body=every)


@query("farthest_landmarks", _farthest_sql())
def farthest_landmarks(s, d):
    from anisomap.operators.graph import all_distances

    p = points(s, d)

    def touching(ids):
        one = all_distances(p, sources=p.join(ids, "id", "left_semi"))
        return all_pairs(s, d, one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")))

    return P.farthest_points(p, touching, 5, seed=1)


@query("prepared_pairs", sql(PTS, KNN, _K, _W, _ALLOWED, body="SELECT src, dst, round(d, 6) AS d, w::DOUBLE AS w FROM p"))
def prepared_pairs(s, d):
    """Allowed pairs that passed the check of what a fit is given."""
    p = allowed(s, d)
    P.validate_pairs(p)
    return p.select("src", "dst", R("d").alias("d"), "w")
