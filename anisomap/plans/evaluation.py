"""Queries of distance, asymmetry, velocity and gap scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from anisomap.functions import metrics as M
from anisomap.functions import vectors as V
from anisomap.operators import evaluate as E
from anisomap.operators import graph as G
from anisomap.plans.inputs import EDGE, EMB, GSYM, KNN, LANDMARKS, PTS, TIME, VEL, cluster_edges, direct_pairs, embedding, graph, knn, labels, landmarks, points, sql, times, velocity

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


_M = "m AS (SELECT src, dst, dist AS d, r * (1 + 0.5 * s) AS e FROM e)"
_STRETCH = """round(avg(e / d), 6) AS mean, round(stddev_pop(e / d), 6) AS std, round(quantile_cont(e / d, 0.5), 6) AS median, round(quantile_cont(e / d, 0.05), 6) AS q05,
  round(quantile_cont(e / d, 0.25), 6) AS q25, round(quantile_cont(e / d, 0.75), 6) AS q75, round(quantile_cont(e / d, 0.95), 6) AS q95, round(min(e / d), 6) AS min, round(max(e / d), 6) AS max"""


@query("evaluate_direct", sql(PTS, EMB, KNN, EDGE, _M, body=f"SELECT count(*) AS n_pairs, 0::BIGINT AS n_unreachable, round(sum((e - d) * (e - d)), 6) AS raw, round(sum(d * d), 6) AS denom, round(sqrt(sum((e - d) * (e - d)) / sum(d * d)), 6) AS normalized, {_STRETCH} FROM m"))
def evaluate_direct(s, d):
    row = E.evaluate_distances(direct_pairs(s, d), embedding(s, d), M.Randers(0.5))
    return row.select("n_pairs", "n_unreachable", *[R(c).alias(c) for c in ("raw", "denom", "normalized", "mean", "std", *E.QUANTILES, "min", "max")])


@query("stretch_summary", sql(PTS, EMB, KNN, EDGE, _M, body=f"SELECT count(*) AS n, {_STRETCH} FROM m WHERE d > 1e-12"))
def stretch_summary(s, d):
    row = E.stretch_summary(E.embedding_distances(embedding(s, d), M.Randers(0.5), direct_pairs(s, d)))
    return row.select("n", *[R(c).alias(c) for c in ("mean", "std", *E.QUANTILES, "min", "max")])


_KE = LANDMARKS + """, ke AS (SELECT src, dst, dist FROM (SELECT a.id AS src, b.id AS dst, sqrt((b.y0 - a.y0) * (b.y0 - a.y0) + (b.y1 - a.y1) * (b.y1 - a.y1) + (b.y2 - a.y2) * (b.y2 - a.y2)) AS dist,
  row_number() OVER (PARTITION BY a.id ORDER BY sqrt((b.y0 - a.y0) * (b.y0 - a.y0) + (b.y1 - a.y1) * (b.y1 - a.y1) + (b.y2 - a.y2) * (b.y2 - a.y2)), b.id) AS k FROM emb a JOIN emb b ON a.id <> b.id) WHERE k <= 10),
ge AS (SELECT src, dst, max(d) AS d FROM (SELECT src, dst, dist AS d FROM ke UNION ALL SELECT dst, src, dist FROM ke) GROUP BY 1, 2 HAVING max(d) > 0),
gm AS (SELECT src, dst, d + 0.5 * (b.y2 - a.y2) AS d FROM ge JOIN emb a ON a.id = src JOIN emb b ON b.id = dst),
bf(h, src, v, dist) AS (SELECT 0, id, id, 0.0::DOUBLE FROM lk UNION ALL SELECT h + 1, src, v, min(dist) FROM (SELECT h, src, v, dist FROM bf UNION ALL SELECT bf.h, bf.src, gm.dst, bf.dist + gm.d FROM bf JOIN gm ON bf.v = gm.src) WHERE h < 24 GROUP BY h, src, v)"""


@query("geodesic_stress", sql(PTS, EMB, KNN, _KE, "m AS (SELECT k.dist AS d, bf.dist AS e FROM knn k LEFT JOIN bf ON bf.h = 24 AND bf.src = k.src AND bf.v = k.dst WHERE k.src IN (SELECT id FROM lk))",
    body="SELECT count(e) AS n_pairs, count(*) FILTER (e IS NULL) AS n_unreachable, round(sum((e - d) * (e - d)), 6) AS raw, round(sum(d * d) FILTER (e IS NOT NULL), 6) AS denom FROM m", recursive=True))
def geodesic_stress(s, d):
    row = E.evaluate_distances(direct_pairs(s, d).join(landmarks(s, d).withColumnRenamed("id", "src"), "src", "left_semi"), embedding(s, d), M.Randers(0.5), "geodesic", most_hops=24)
    return row.select("n_pairs", "n_unreachable", R("raw").alias("raw"), R("denom").alias("denom"))


_ASYM = "ps AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM knn)"
_AP = """ap AS (SELECT (bx - fx) / (fx + bx) AS x, (be - fe) / (fe + be) AS y FROM (SELECT list_distance(a.x, b.x) + 0.3 * (b.x[4] - a.x[4]) AS fx, list_distance(a.x, b.x) - 0.3 * (b.x[4] - a.x[4]) AS bx,
  r + 0.5 * u AS fe, r - 0.5 * u AS be FROM (SELECT ps.*, b.y2 - a.y2 AS u, sqrt((b.y0 - a.y0) * (b.y0 - a.y0) + (b.y1 - a.y1) * (b.y1 - a.y1) + (b.y2 - a.y2) * (b.y2 - a.y2)) AS r FROM ps JOIN emb a ON a.id = src JOIN emb b ON b.id = dst) JOIN pts a ON a.id = src JOIN pts b ON b.id = dst))"""
_RANKED = """st AS (SELECT * FROM ap WHERE abs(x) > 0.02), rk AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM st)"""


def asymmetries(s, d):
    """Neighbour pairs with the score of a distance that is longer along the fourth axis, and that of the embedding."""
    pairs = E.neighbor_pairs(knn(s, d))
    p = G.with_vectors(pairs, points(s, d))
    tilt = 0.3 * (F.get("b", F.lit(3)) - F.get("a", F.lit(3)))
    data = p.select("src", "dst", E.asymmetry_score(V.distance("a", "b") + tilt, V.distance("a", "b") - tilt).alias("a_data"))
    e, metric = G.with_vectors(pairs, embedding(s, d), "y"), M.Randers(0.5)
    emb = e.select("src", "dst", E.asymmetry_score(metric.length_col(V.sub("b", "a")), metric.length_col(V.sub("a", "b"))).alias("a_embedding"))
    return data.join(emb, ["src", "dst"])


@query("asymmetry_scores", sql(PTS, EMB, KNN, _ASYM, _AP.replace("SELECT (bx", "SELECT src, dst, (bx").replace("FROM (SELECT list", "FROM (SELECT src, dst, list"), body="SELECT src, dst, round(x, 6) + 0.0 AS a_data, round(y, 6) + 0.0 AS a_embedding FROM ap"))
def asymmetry_scores(s, d):
    return asymmetries(s, d).select("src", "dst", R("a_data").alias("a_data"), R("a_embedding").alias("a_embedding"))


@query("asymmetry_preservation", sql(PTS, EMB, KNN, _ASYM, _AP, _RANKED, body="""SELECT count(*) AS n_pairs, round(avg((sign(x) = sign(y))::INT), 6) AS sign_accuracy, round(sum(abs(x) * (sign(x) = sign(y))::INT) / sum(abs(x)), 6) AS weighted_sign_accuracy,
  round(corr(rx, ry), 6) AS spearman, round(corr(x, y), 6) AS pearson, round(sum(x * y) / sum(x * x), 6) AS gamma, round(sum((x - y) * (x - y)) / sum(x * x), 6) AS normalized_mse, round(avg(abs(x)), 6) AS mean_abs_data, round(avg(abs(y)), 6) AS mean_abs_embedding FROM rk"""))
def asymmetry_preservation(s, d):
    row = E.asymmetry_preservation(asymmetries(s, d))
    return row.select("n_pairs", *[R(c).alias(c) for c in row.columns if c != "n_pairs"])


@query("opposite_asymmetry", sql(PTS, EMB, KNN, _ASYM, _AP, body="SELECT round(corr(x, y), 6) AS pearson, round(sum(x * y) / sum(x * x), 6) AS beta, round(sqrt(avg((x - y) * (x - y))), 6) AS rmse FROM ap"))
def opposite_asymmetry(s, d):
    row = E.opposite_asymmetry(asymmetries(s, d).select((-F.col("a_data")).alias("f_data"), (-F.col("a_embedding")).alias("f_embedding")))
    return row.select(*[R(c).alias(c) for c in row.columns])


@query("neighbor_pairs", sql(PTS, KNN, _ASYM, body="SELECT src, dst FROM ps"))
def neighbor_pairs(s, d):
    return E.neighbor_pairs(knn(s, d))


_TRANS = "tr AS (SELECT src, dst, 1.0 / (1 + dist) - 0.4 AS p FROM knn)"


def transitions(near):
    return near.select("src", "dst", (1.0 / (1 + F.col("dist")) - 0.4).alias("p"))


_PROJ = """pv AS (SELECT e.src AS id, sum(p / m * u0 / r) AS v0, sum(p / m * u1 / r) AS v1, sum(p / m * u2 / r) AS v2 FROM e JOIN tr ON tr.src = e.src AND tr.dst = e.dst
  JOIN (SELECT src, sum(p) AS m FROM tr WHERE p > 0 GROUP BY 1) q ON q.src = e.src WHERE p > 0 AND r > 1e-12 GROUP BY 1)"""
_MEAN = """pv AS (SELECT e.src AS id, sum((p - m) * u0 / r) AS v0, sum((p - m) * u1 / r) AS v1, sum((p - m) * u2 / r) AS v2 FROM e JOIN tr ON tr.src = e.src AND tr.dst = e.dst
  JOIN (SELECT src, avg(p) AS m FROM tr GROUP BY 1) q ON q.src = e.src WHERE r > 1e-12 GROUP BY 1)"""
for _name, _part, _f in (("transition_projection", _PROJ, E.project_velocity_graph), ("transition_projection_centered", _MEAN, E.project_velocity_mean_corrected)):
    QUERIES[_name] = lambda s, d, f=_f: f(embedding(s, d), transitions(knn(s, d))).select("id", *[R(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(3)])
    ORACLES[_name] = sql(PTS, EMB, KNN, EDGE, _TRANS, _part, body="SELECT pts.id, round(coalesce(v0, 0), 6) + 0.0 AS v0, round(coalesce(v1, 0), 6) + 0.0 AS v1, round(coalesce(v2, 0), 6) + 0.0 AS v2 FROM pts LEFT JOIN pv USING (id)")

_COS = "CASE WHEN r * nv > 1e-12 THEN greatest(-1.0, least(1.0, (u0 * v0 + u1 * v1 + u2 * v2) / (r * nv))) END"
_CB = f"""cb AS (SELECT a.label AS sl, b.label AS dl, src, avg({_COS}) AS score FROM (SELECT e.*, v0, v1, v2, sqrt(v0 * v0 + v1 * v1 + v2 * v2) AS nv FROM e JOIN vel ON vel.id = e.src) e
  JOIN pts a ON a.id = src JOIN pts b ON b.id = dst WHERE b.label = (a.label + 1) % 10 GROUP BY 1, 2, 3)"""


@query("boundary_plan", sql(PTS, KNN, body="SELECT a.label AS src_label, b.label AS dst_label, src AS cell, dst AS nbr FROM knn JOIN pts a ON a.id = src JOIN pts b ON b.id = dst WHERE b.label = (a.label + 1) % 10"))
def boundary_plan(s, d):
    return E.boundary_plan(labels(s, d), cluster_edges(s), knn(s, d))


@query("cbdir", sql(PTS, EMB, KNN, EDGE, VEL, _CB, body="SELECT sl AS src_label, dl AS dst_label, count(score) AS n_cells, round(avg(score), 6) AS score FROM cb GROUP BY GROUPING SETS ((sl, dl), ())"))
def cbdir(s, d):
    plan = E.boundary_plan(labels(s, d), cluster_edges(s), knn(s, d))
    return E.boundary_correctness(plan, embedding(s, d), velocity(s, d)).withColumn("score", R("score"))


_IC = """ic AS (SELECT a.label, src, avg(CASE WHEN na * nb > 1e-12 THEN greatest(-1.0, least(1.0, (x.v0 * y.v0 + x.v1 * y.v1 + x.v2 * y.v2) / (na * nb))) END) AS score FROM knn JOIN pts a ON a.id = src JOIN pts b ON b.id = dst
  JOIN (SELECT *, sqrt(v0 * v0 + v1 * v1 + v2 * v2) AS na FROM vel) x ON x.id = src JOIN (SELECT *, sqrt(v0 * v0 + v1 * v1 + v2 * v2) AS nb FROM vel) y ON y.id = dst WHERE a.label = b.label GROUP BY 1, 2)"""


@query("icvcoh", sql(PTS, EMB, KNN, VEL, _IC, body="SELECT label, count(score) AS n_cells, round(avg(score), 6) AS score FROM ic GROUP BY GROUPING SETS ((label), ())"))
def icvcoh(s, d):
    return E.cluster_coherence(labels(s, d), knn(s, d), velocity(s, d)).withColumn("score", R("score"))


@query("gvcoh", sql(PTS, EMB, VEL, "u AS (SELECT *, sqrt(v0 * v0 + v1 * v1 + v2 * v2) AS r FROM vel)", body="SELECT count(*) AS n, round(sqrt(pow(avg(v0 / r), 2) + pow(avg(v1 / r), 2) + pow(avg(v2 / r), 2)), 6) AS gvcoh FROM u WHERE r > 1e-12"))
def gvcoh(s, d):
    return E.global_coherence(velocity(s, d)).withColumn("gvcoh", R("gvcoh"))


@query("spearman_alignment", sql(PTS, EMB, KNN, EDGE, VEL, _ASYM, f"""dc AS (SELECT src, dst, x.v0 * u0 + x.v1 * u1 + x.v2 * u2 AS q, x.*, u0, u1, u2, r, sqrt(x.v0 * x.v0 + x.v1 * x.v1 + x.v2 * x.v2) AS nv FROM e JOIN vel x ON x.id = src),
al AS (SELECT {_COS} AS x, CASE WHEN abs(u1) + abs(u2) > 0 AND nw * rw > 1e-12 THEN greatest(-1.0, least(1.0, (u1 * v1 + u2 * v2) / (nw * rw))) END AS y FROM (SELECT *, sqrt(v1 * v1 + v2 * v2) AS nw, sqrt(u1 * u1 + u2 * u2) AS rw FROM dc)),
rk AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM al WHERE x IS NOT NULL AND y IS NOT NULL)""",
    body="SELECT count(*) AS n_pairs, round(corr(rx, ry), 6) AS spearman, round(avg((sign(x) = sign(y))::INT) FILTER (abs(x) > 1e-12 AND abs(y) > 1e-12), 6) AS sign_accuracy FROM rk"))
def spearman_alignment(s, d):
    """Agreement of velocity directions in three coordinates and in the last two of them."""
    space, v = embedding(s, d).select("id", F.col("y").alias("x")), velocity(s, d)
    flat, w = embedding(s, d).select("id", F.slice("y", 2, 2).alias("y")), velocity(s, d).select("id", F.slice("v", 2, 2).alias("v"))
    row = E.velocity_alignment(knn(s, d).select("src", "dst"), space, v, flat, w)
    return row.select("n_pairs", R("spearman").alias("spearman"), R("sign_accuracy").alias("sign_accuracy"))


_GAP = """gp AS (SELECT id, 'before' AS grp FROM pts WHERE label = 2 UNION ALL SELECT id, 'after' FROM pts WHERE label = 4), ge AS (SELECT gp.*, y0, y1, y2 FROM gp JOIN emb USING (id)),
dd AS (SELECT a.id, a.grp, b.grp AS g2, sqrt((b.y0 - a.y0) * (b.y0 - a.y0) + (b.y1 - a.y1) * (b.y1 - a.y1) + (b.y2 - a.y2) * (b.y2 - a.y2)) AS r FROM ge a, ge b)"""
_REP = {
    "medoid": "rp AS (SELECT grp, arg_min(id, t) AS id FROM (SELECT id, grp, sum(r) AS t FROM dd WHERE grp = g2 GROUP BY 1, 2) GROUP BY 1), re AS (SELECT rp.grp, y0, y1, y2 FROM rp JOIN emb USING (id))",
    "centroid": "mc AS (SELECT grp, avg(y0) AS c0, avg(y1) AS c1, avg(y2) AS c2 FROM ge GROUP BY 1), rp AS (SELECT grp, arg_min(id, (y0 - c0) * (y0 - c0) + (y1 - c1) * (y1 - c1) + (y2 - c2) * (y2 - c2)) AS id FROM ge JOIN mc USING (grp) GROUP BY 1), re AS (SELECT rp.grp, y0, y1, y2 FROM rp JOIN emb USING (id))",
    "median": "re AS (SELECT grp, quantile_cont(y0, 0.5) AS y0, quantile_cont(y1, 0.5) AS y1, quantile_cont(y2, 0.5) AS y2 FROM ge GROUP BY 1)",
}
for _kind, _part in _REP.items():
    QUERIES[f"gap_distance_{_kind}"] = lambda s, d, k=_kind: E.gap_distance(embedding(s, d), E.gap_selection(labels(s, d), None, [3], [2], [4]), k).select(*[R(c).alias(c) for c in ("gap_distance", "max_distance", "normalized_gap")])
    ORACLES[f"gap_distance_{_kind}"] = sql(PTS, EMB, _GAP, _part, "ga AS (SELECT sqrt((b.y0 - a.y0) * (b.y0 - a.y0) + (b.y1 - a.y1) * (b.y1 - a.y1) + (b.y2 - a.y2) * (b.y2 - a.y2)) AS g FROM re a JOIN re b ON a.grp = 'before' AND b.grp = 'after')",
        "mx AS (SELECT max(sqrt((b.y0 - a.y0) * (b.y0 - a.y0) + (b.y1 - a.y1) * (b.y1 - a.y1) + (b.y2 - a.y2) * (b.y2 - a.y2))) AS r FROM emb a, emb b)",
        body="SELECT round(g, 6) AS gap_distance, round(r, 6) AS max_distance, round(g / greatest(r, 1e-12), 6) AS normalized_gap FROM ga, mx")


@query("gap_selection", sql(PTS, TIME, """lt AS (SELECT tm.id, t, label FROM tm JOIN pts USING (id)), sp AS (SELECT min(t) AS lo, max(t) AS hi FROM lt WHERE label = 3)""",
    body="""SELECT id, 'removed' AS grp FROM pts WHERE label = 3 UNION ALL (SELECT id, 'before' FROM lt, sp WHERE label <> 3 AND t < lo ORDER BY t DESC, id LIMIT 5)
  UNION ALL (SELECT id, 'after' FROM lt, sp WHERE label <> 3 AND t > hi ORDER BY t, id LIMIT 5)"""))  # fmt: skip
def gap_selection(s, d):
    return E.gap_selection(labels(s, d), times(s, d), [3], n=5)


@query("velocity_scale", sql(PTS, EMB, VEL, body="SELECT round(0.05 * greatest(max(y0) - min(y0), max(y1) - min(y1), max(y2) - min(y2)) / (SELECT quantile_cont(sqrt(v0 * v0 + v1 * v1 + v2 * v2), 0.5) FROM vel), 6) AS scale FROM emb"))
def velocity_scale(s, d):
    return E.velocity_scale(embedding(s, d), velocity(s, d)).select(R("scale").alias("scale"))


@query("tempered_velocity", sql(PTS, EMB, VEL, body="SELECT id, round(v0 / sqrt(sqrt(v0 * v0 + v1 * v1 + v2 * v2)), 6) + 0.0 AS v0, round(v1 / sqrt(sqrt(v0 * v0 + v1 * v1 + v2 * v2)), 6) + 0.0 AS v1 FROM vel"))
def tempered_velocity(s, d):
    return E.tempered_velocity(velocity(s, d), 0.5).select("id", R(F.get("v", F.lit(0))).alias("v0"), R(F.get("v", F.lit(1))).alias("v1"))


@query("corner_pair", sql(PTS, EMB, "bx AS (SELECT id, (y0 - min(y0) OVER ()) / (max(y0) OVER () - min(y0) OVER ()) + (y1 - min(y1) OVER ()) / (max(y1) OVER () - min(y1) OVER ()) AS s FROM emb)", body="SELECT arg_min(id, s) AS first, arg_max(id, s) AS last FROM bx"))
def corner_pair(s, d):
    return E.corner_pair(embedding(s, d).withColumnRenamed("y", "x"))


_ROW = f"""pv2 AS MATERIALIZED (SELECT pts.id, coalesce(v0, 0) AS v0, coalesce(v1, 0) AS v1, coalesce(v2, 0) AS v2 FROM pts LEFT JOIN pv USING (id)), pn AS (SELECT *, sqrt(v0 * v0 + v1 * v1 + v2 * v2) AS nv FROM pv2),
cbr AS (SELECT avg(score) AS v FROM (SELECT a.label, b.label, src, avg({_COS}) AS score FROM e JOIN pn ON pn.id = e.src JOIN pts a ON a.id = src JOIN pts b ON b.id = dst WHERE b.label = (a.label + 1) % 10 GROUP BY a.label, b.label, src)),
icr AS (SELECT avg(score) AS v FROM (SELECT src, avg(CASE WHEN x.nv * y.nv > 1e-12 THEN greatest(-1.0, least(1.0, (x.v0 * y.v0 + x.v1 * y.v1 + x.v2 * y.v2) / (x.nv * y.nv))) END) AS score FROM knn JOIN pn x ON x.id = src JOIN pn y ON y.id = dst JOIN pts a ON a.id = src JOIN pts b ON b.id = dst WHERE a.label = b.label GROUP BY src)),
gvr AS (SELECT sqrt(pow(avg(v0 / nv), 2) + pow(avg(v1 / nv), 2) + pow(avg(v2 / nv), 2)) AS v FROM pn WHERE nv > 1e-12),
dt AS (SELECT {_COS} AS x, src, dst FROM (SELECT e.*, v0, v1, v2, sqrt(v0 * v0 + v1 * v1 + v2 * v2) AS nv FROM e JOIN vel ON vel.id = e.src)), em AS (SELECT {_COS} AS y, src, dst FROM e JOIN pn ON pn.id = e.src),
alr AS (SELECT x, y FROM dt JOIN em USING (src, dst) WHERE x IS NOT NULL AND y IS NOT NULL), rka AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM alr),
sp AS (SELECT corr(rx, ry) AS v, avg((sign(x) = sign(y))::INT) FILTER (abs(x) > 1e-12 AND abs(y) > 1e-12) AS w FROM rka)"""


@query("evaluation_row", sql(PTS, EMB, KNN, EDGE, VEL, _TRANS, _MEAN, _ROW, body="SELECT 'first three' AS name, round(cbr.v, 6) AS cbdir, round(icr.v, 6) AS icvcoh, round(gvr.v, 6) AS gvcoh, round(sp.v, 6) AS spearman_cos, round(sp.w, 6) AS sign_correctness FROM cbr, icr, gvr, sp"))
def evaluation_row(s, d):
    space = embedding(s, d).select("id", F.col("y").alias("x"))
    near = knn(s, d)
    row = E.evaluation_row("first three", near.select("src", "dst"), space, velocity(s, d), embedding(s, d), transitions(near), labels(s, d), cluster_edges(s), near)
    return row.select("name", *[R(c).alias(c) for c in row.columns if c != "name"])


@query("gap_scopes", sql(PTS, EMB, _GAP, _REP["medoid"], "ga AS (SELECT sqrt((b.y0 - a.y0) * (b.y0 - a.y0) + (b.y1 - a.y1) * (b.y1 - a.y1) + (b.y2 - a.y2) * (b.y2 - a.y2)) AS g FROM re a JOIN re b ON a.grp = 'before' AND b.grp = 'after')",
    "mx AS (SELECT max(sqrt((b.y0 - a.y0) * (b.y0 - a.y0) + (b.y1 - a.y1) * (b.y1 - a.y1) + (b.y2 - a.y2) * (b.y2 - a.y2))) AS r FROM emb a, emb b)",
    "mg AS (SELECT max(sqrt((b.y0 - a.y0) * (b.y0 - a.y0) + (b.y1 - a.y1) * (b.y1 - a.y1) + (b.y2 - a.y2) * (b.y2 - a.y2))) AS r FROM emb a, emb b WHERE a.label IN (2, 3, 4) AND b.label IN (2, 3, 4))",
    body="SELECT 'full' AS scope, round(g, 6) AS gap_distance, round(r, 6) AS max_distance, round(g / r, 6) AS normalized_gap FROM ga, mx UNION ALL SELECT 'gap', round(g, 6), round(r, 6), round(g / r, 6) FROM ga, mg"))
def gap_scopes(s, d):
    """The gap in the whole embedding, and in that of the cells around it alone."""
    groups = E.gap_selection(labels(s, d), None, [3], [2], [4])
    near = embedding(s, d).join(groups.select("id"), "id", "left_semi")
    rows = [E.gap_distance(y, groups).select(F.lit(scope).alias("scope"), *[R(c).alias(c) for c in ("gap_distance", "max_distance", "normalized_gap")]) for scope, y in (("full", embedding(s, d)), ("gap", near))]
    return rows[0].unionByName(rows[1])


@query("fixed_support_stress", sql(PTS, EMB, KNN, GSYM, LANDMARKS, "ev AS MATERIALIZED (SELECT src, dst, sqrt((b.y0 - a.y0) * (b.y0 - a.y0) + (b.y1 - a.y1) * (b.y1 - a.y1) + (b.y2 - a.y2) * (b.y2 - a.y2)) AS d FROM g JOIN emb a ON a.id = src JOIN emb b ON b.id = dst)",
    "bf(h, src, v, dist) AS (SELECT 0, id, id, 0.0::DOUBLE FROM lk UNION ALL SELECT h + 1, src, v, min(dist) FROM (SELECT h, src, v, dist FROM bf UNION ALL SELECT bf.h, bf.src, ev.dst, bf.dist + ev.d FROM bf JOIN ev ON bf.v = ev.src) WHERE h < 40 GROUP BY h, src, v)",
    "m AS (SELECT k.dist AS d, bf.dist AS e FROM knn k JOIN lk ON lk.id = k.src LEFT JOIN bf ON bf.h = 40 AND bf.src = k.src AND bf.v = k.dst)",
    body="SELECT count(*) AS n_pairs, count(*) FILTER (e IS NULL) AS n_unreachable, round(sum((e - d) * (e - d)), 6) AS raw, round(sqrt(sum((e - d) * (e - d)) / sum(d * d)), 6) AS normalized FROM m", recursive=True))
def fixed_support_stress(s, d):
    """Stress of landmarks' neighbours by ways in the embedding over the neighbours in the data."""
    pairs = direct_pairs(s, d).join(landmarks(s, d).withColumnRenamed("id", "src"), "src", "left_semi")
    row = E.support_stress(pairs, embedding(s, d), graph(s, d))
    return row.select("n_pairs", "n_unreachable", R("raw").alias("raw"), R("normalized").alias("normalized"))


@query("rebuilt_support_stress")
def rebuilt_support_stress(s, d):
    """The same over the embedding's own connected neighbours."""
    pairs = direct_pairs(s, d).join(landmarks(s, d).withColumnRenamed("id", "src"), "src", "left_semi")
    row = E.support_stress(pairs, embedding(s, d))
    return row.select("n_pairs", "n_unreachable", R("raw").alias("raw"), R("normalized").alias("normalized"))
