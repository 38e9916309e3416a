"""Queries of sources, campaign tables and linear maps, on the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from anisomap.functions import campaign as C
from anisomap.functions import vectors as V
from anisomap.operators import initializers as I
from anisomap.plans.inputs import EMB, KNN, PTS, VEL, direct_pairs, embedding, knn, points, sql, table, times, velocity
from anisomap.sources import store as S
from anisomap.storage import scratch

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


#: Runs made of order lines: mode as method, flag as setting, supplier as seed, line number as step.
_RUNS = "runs AS (SELECT l_linestatus AS method, l_returnflag AS setting, l_suppkey % 5 AS seed, l_linenumber AS step, l_quantity AS elapsed, l_extendedprice AS stress FROM lineitem)"


def runs(s, d):
    return table(s, d, "lineitem").select(F.col("l_linestatus").alias("method"), F.col("l_returnflag").alias("setting"), (F.col("l_suppkey") % 5).alias("seed"), F.col("l_linenumber").alias("step"), F.col("l_quantity").alias("elapsed"), F.col("l_extendedprice").alias("stress"))


@query("seed_summary", sql(_RUNS, body="SELECT method, setting, count(DISTINCT seed) AS n_seeds, round(avg(elapsed), 4) AS elapsed_mean, round(stddev_pop(elapsed), 4) AS elapsed_std, round(avg(stress), 4) AS stress_mean, round(stddev_pop(stress), 4) AS stress_std FROM runs GROUP BY 1, 2"))
def seed_summary(s, d):
    got = C.summarize_by_seed(runs(s, d), ["method", "setting"], ["elapsed", "stress"])
    return got.select("method", "setting", "n_seeds", *[R(c, 4).alias(c) for c in ("elapsed_mean", "elapsed_std", "stress_mean", "stress_std")])


@query("curve_average", sql(_RUNS, "f AS (SELECT * FROM runs WHERE NOT (seed = 3 AND step > 5))", "a AS (SELECT method, count(DISTINCT seed) AS n FROM f GROUP BY 1)",
    body="SELECT method, step, count(DISTINCT seed) AS n_seeds, round(avg(elapsed), 4) AS elapsed, round(avg(stress), 4) AS stress FROM f JOIN a USING (method) GROUP BY method, step, n HAVING count(DISTINCT seed) = n"))
def curve_average(s, d):
    got = C.average_curves(runs(s, d).where("not (seed = 3 and step > 5)"), ["method"])
    return got.select("method", "step", "n_seeds", R("elapsed", 4).alias("elapsed"), R("stress", 4).alias("stress"))


@query("run_last_rows", sql("o AS (SELECT l_orderkey AS run, l_linenumber AS step, round(max(l_extendedprice), 2) AS stress FROM lineitem GROUP BY 1, 2)", body="SELECT run, max(step) AS step, arg_max(stress, step) AS stress FROM o GROUP BY 1"))
def run_last_rows(s, d):
    lines = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("p"))
    return C.last_rows(lines.select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("step"), F.round("p", 2).alias("stress")), ["run"])


@query("csv_upsert", "SELECT n_nationkey::VARCHAR AS key, n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'new' END AS note FROM nation UNION ALL SELECT '99', 'ELSEWHERE', 'new'")
def csv_upsert(s, d):
    old = table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("name"))
    new = old.where("key % 3 = 0").unionByName(s.createDataFrame([("99", "ELSEWHERE")], "key string, name string")).withColumn("note", F.lit("new"))
    return S.upsert(old, new, ["key"])


@query("csv_append", "SELECT r_regionkey AS key, r_name AS name, NULL::VARCHAR AS kind FROM region UNION ALL SELECT n_nationkey, NULL, n_name FROM nation")
def csv_append(s, d):
    a = table(s, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    return S.append_rows(a, table(s, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("kind")))


@query("campaign_grid", "SELECT r_name AS a, n_name AS b, k FROM region, nation, (VALUES (5), (10)) t(k)")
def campaign_grid(s, d):
    k = s.createDataFrame([(5,), (10,)], "k int")
    return C.grid([table(s, d, "region").select(F.col("r_name").alias("a")), table(s, d, "nation").select(F.col("n_name").alias("b")), k])


@query("iteration_tags", "SELECT p_partkey AS key, CASE WHEN p_partkey % 4 = 0 THEN -1 ELSE p_size END AS iteration, 'a' || CASE WHEN p_size % 2 = 0 THEN (p_size // 2)::VARCHAR ELSE replace((p_size / 2)::VARCHAR, '.', 'p') END AS tag, lpad(p_size::VARCHAR, 3, '0') AS code FROM part")
def iteration_tags(s, d):
    name = F.concat(F.lit("run_"), F.when(F.col("p_partkey") % 4 == 0, F.lit("x")).otherwise(F.concat(F.lit("i"), F.col("p_size"))), F.lit("_final.parquet"))
    p = table(s, d, "part")
    return p.select(F.col("p_partkey").alias("key"), C.iteration_of(name).alias("iteration"), C.alpha_tag(F.col("p_size") / 2).alias("tag"), C.percent_code(F.col("p_size") / 100).alias("code"))


@query("artifact_names", "SELECT p_partkey AS key, CASE p_partkey % 3 WHEN 0 THEN 'umap' WHEN 1 THEN 'path_frozen' ELSE 'unknown' END AS method, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 2 END AS dimension FROM part")
def artifact_names(s, d):
    kind = F.when(F.col("p_partkey") % 3 == 0, "umap").when(F.col("p_partkey") % 3 == 1, "path_frozen").otherwise("mystery")
    path = F.concat(F.lit("/results/"), kind, F.when(F.col("p_partkey") % 2 == 0, "_3d").otherwise("_flat"), F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".parquet"))
    return table(s, d, "part").select(F.col("p_partkey").alias("key"), S.method_of(path).alias("method"), S.dimension_of(path).cast("int").alias("dimension"))


@query("categorical_codes", "SELECT c_custkey AS id, c_mktsegment AS label, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INTEGER AS code FROM customer")
def categorical_codes(s, d):
    return C.categorical_codes(table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"))).select("id", "label", "code")


@query("rescaled_time", "SELECT s_suppkey AS id, round((s_acctbal - (SELECT min(s_acctbal) FROM supplier)) / (SELECT max(s_acctbal) - min(s_acctbal) FROM supplier), 6) AS t FROM supplier")
def rescaled_time(s, d):
    return C.finite_rescaled(table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), "s_acctbal"), "s_acctbal", "t").select("id", R("t").alias("t"))


@query("combined_time", "SELECT c_custkey AS id, round(CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN c_nationkey WHEN c_custkey % 3 = 0 THEN c_acctbal ELSE (c_acctbal + c_nationkey) / 2 END, 6) AS t FROM customer")
def combined_time(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 != 0, F.col("c_acctbal")).alias("a"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("b"))
    return C.combined_time(c, ["a", "b"], "t").select("id", R("t").alias("t"))


@query("relabelled", "SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'house' ELSE c_mktsegment END AS label FROM customer WHERE c_mktsegment <> 'MACHINERY'")
def relabelled(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"))
    return C.restricted(C.relabelled(c, {"BUILDING": "house"}), drop=["MACHINERY"])


@query("layout_stability", sql(PTS, body="SELECT max(c) <= 1.5 AND max(span) <= 1.5 AS stable FROM (SELECT max(abs(c)) AS c, max(c) - min(c) AS span FROM (SELECT unnest(x) AS c, unnest(range(64)) AS a FROM pts) GROUP BY a)"))
def layout_stability(s, d):
    return C.layout_is_stable(points(s, d).select("id", F.col("x").alias("y")), 1.5)


@query("adapt_dimension", sql(PTS, EMB, body="SELECT id, round(y0, 6) + 0.0 AS y0, round(y1, 6) + 0.0 AS y1, round(y2, 6) + 0.0 AS y2, 0.0::DOUBLE AS y3 FROM emb"))
def adapt_dimension(s, d):
    return I.adapt_dimension(embedding(s, d), 4).select("id", *[R(F.get("y", F.lit(i))).alias(f"y{i}") for i in range(4)])


@query("scaled_embedding", sql(PTS, EMB, KNN, "f AS (SELECT quantile_cont(dist / r, 0.5) AS f FROM (SELECT dist, sqrt((b.y0 - a.y0) * (b.y0 - a.y0) + (b.y1 - a.y1) * (b.y1 - a.y1) + (b.y2 - a.y2) * (b.y2 - a.y2)) AS r FROM knn JOIN emb a ON a.id = src JOIN emb b ON b.id = dst) WHERE r > 0)",
    body="SELECT id, round((y0 - avg(y0) OVER ()) * f, 6) + 0.0 AS y0, round((y1 - avg(y1) OVER ()) * f, 6) + 0.0 AS y1, round((y2 - avg(y2) OVER ()) * f, 6) + 0.0 AS y2 FROM emb, f"))
def scaled_embedding(s, d):
    got = I.scale_to_dissimilarities(embedding(s, d), direct_pairs(s, d).select("src", "dst", "d"))
    return got.select("id", *[R(F.get("y", F.lit(i))).alias(f"y{i}") for i in range(3)])


@query("rescaled_embedding", sql(PTS, EMB, "c AS (SELECT id, y0 - avg(y0) OVER () AS a, y1 - avg(y1) OVER () AS b FROM emb)", "r AS (SELECT x[4] AS p, x[5] AS q, avg(x[4]) OVER () AS mp, avg(x[5]) OVER () AS mq FROM pts)", "f AS (SELECT (SELECT sqrt(sum((p - mp) * (p - mp) + (q - mq) * (q - mq))) FROM r) / (SELECT sqrt(sum(a * a + b * b)) FROM c) AS f, (SELECT max(mp) FROM r) AS mp, (SELECT max(mq) FROM r) AS mq)",
    body="SELECT id, round(a * f + mp, 6) + 0.0 AS y0, round(b * f + mq, 6) + 0.0 AS y1 FROM c, f"))
def rescaled_embedding(s, d):
    reference = points(s, d).select("id", F.slice("x", 4, 2).alias("y"))
    got = I.rescale_to_reference(embedding(s, d).select("id", F.slice("y", 1, 2).alias("y")), reference)
    return got.select("id", *[R(F.get("y", F.lit(i))).alias(f"y{i}") for i in range(2)])


@query("rotated_down", sql(PTS, EMB, VEL, "w AS (SELECT avg(v0) AS a, avg(v1) AS b, sqrt(avg(v0) * avg(v0) + avg(v1) * avg(v1)) AS n FROM vel)",
    body="SELECT id, round((-b * y0 + a * y1) / n, 5) + 0.0 AS y0, round((-a * y0 - b * y1) / n, 5) + 0.0 AS y1 FROM emb, w"))
def rotated_down(s, d):
    flat, v = embedding(s, d).select("id", F.slice("y", 1, 2).alias("y")), velocity(s, d).select("id", F.slice("v", 1, 2).alias("v"))
    got, _ = I.rotate_velocity_down(flat, v)
    return got.select("id", *[R(F.get("y", F.lit(i)), 5).alias(f"y{i}") for i in range(2)])


@query("lifted_by_time", sql(PTS, "tm AS (SELECT id, CASE WHEN id % 17 <> 0 THEN (x[4] - min(x[4]) OVER ()) / (max(x[4]) OVER () - min(x[4]) OVER ()) END AS t FROM pts)", body="SELECT id, round(2 * coalesce(t, 0.5), 6) AS z FROM tm"))
def lifted_by_time(s, d):
    t = times(s, d).withColumn("fallback", F.lit(0.5))
    return I.lift_by_time(embedding(s, d), t, 2.0).select("id", R(F.element_at("y", -1)).alias("z"))


@query("aligned_embedding", sql(PTS, EMB, body="SELECT id, round(y0, 6) + 0.0 AS y0 FROM emb"))
def aligned_embedding(s, d):
    return S.align(points(s, d), embedding(s, d)).select("id", R(F.get("y", F.lit(0))).alias("y0"))


@query("saved_embedding", sql(PTS, EMB, body="SELECT id, round(y0, 6) + 0.0 AS y0, round(y1, 6) + 0.0 AS y1, round(y2, 6) + 0.0 AS y2 FROM emb"))
def saved_embedding(s, d):
    """Saved, found again by its shape among others, and loaded for the wanted ids."""
    at, y = scratch(s, "saved"), embedding(s, d)
    S.save_embedding(f"{at}/e_3d", y, 0.5, 0.25, {"seed": 42})
    S.save_embedding(f"{at}/e_1d", y.select("id", F.slice("y", 1, 1).alias("y")), 0.5)
    found = S.newest_compatible(s, f"{at}/e_*", y.count(), 3)
    got = S.load_embedding(s, found, points(s, d).select("id"))
    return got.select("id", *[R(F.get("y", F.lit(i))).alias(f"y{i}") for i in range(3)])


@query("sniffed_embedding", sql(PTS, body="SELECT id, len(x) AS n, round(x[64], 6) + 0.0 AS last FROM pts"))
def sniffed_embedding(s, d):
    return S.sniff_embedding(table(s, d, "embeddings")).select("id", F.size("y").cast("long").alias("n"), R(F.element_at("y", -1)).alias("last"))


@query("matrix_market", sql(PTS, KNN, body="SELECT src AS i, dst AS j, round(dist, 6) AS value FROM knn"))
def matrix_market(s, d):
    at, n = scratch(s, "matrix"), points(s, d).count()
    S.write_matrix_market(knn(s, d).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("dist").alias("value")), at, n, n)
    return S.read_matrix_market(s, at).select("i", "j", R("value").alias("value"))


@query("evaluation_context", sql(PTS, KNN, body="SELECT (SELECT count(*) FROM pts) AS n_points, count(*) AS n_pairs, round(sum(dist), 4) AS total FROM knn"))
def evaluation_context(s, d):
    """The tables that evaluations share, stored once and read back."""
    at = scratch(s, "context")
    S.save_tables(at, points=points(s, d), knn=knn(s, d))
    got = S.load_tables(s, at, "points", "knn")
    n = got["points"].agg(F.count("*").alias("n_points"))
    return got["knn"].agg(F.count("*").alias("n_pairs"), R(F.sum("dist"), 4).alias("total")).join(F.broadcast(n))


@query("projected_velocity", sql(PTS, EMB, VEL, body="SELECT id, round(0.6 * v0 + 0.8 * v1, 6) + 0.0 AS p0, round(v2, 6) + 0.0 AS p1 FROM vel"))
def projected_velocity(s, d):
    from anisomap.operators.evaluate import project_onto_components

    got = project_onto_components(velocity(s, d), [[0.6, 0.8, 0.0], [0.0, 0.0, 1.0]])
    return got.select("id", R(F.get("v", F.lit(0))).alias("p0"), R(F.get("v", F.lit(1))).alias("p1"))


@query("named_start", sql(PTS, EMB, body="SELECT id, round(y0, 6) + 0.0 AS y0, round(y1, 6) + 0.0 AS y1, round(y2, 6) + 0.0 AS y2, 0.0::DOUBLE AS y3 FROM emb"))
def named_start(s, d):
    at, y = scratch(s, "starts"), embedding(s, d)
    S.save_embedding(f"{at}/smacof", y, 0.5)
    got = I.named_init("Randers-SMACOF", points(s, d), 4, y, {"smacof": f"{at}/smacof"})
    return got.select("id", *[R(F.get("y", F.lit(i))).alias(f"y{i}") for i in range(4)])


@query("diagonal_start", sql(PTS, EMB, body="SELECT id, round((y0 - y1) - avg(y0 - y1) OVER (), 6) + 0.0 AS d0, round(y2 - avg(y2) OVER (), 6) + 0.0 AS d1 FROM emb"))
def diagonal_start(s, d):
    got = I.diagonal_view(embedding(s, d).withColumnRenamed("y", "x"))
    return got.select("id", *[R(F.get("y", F.lit(i))).alias(f"d{i}") for i in range(2)])


@query("contracted_start", sql(PTS, EMB, "r AS (SELECT *, sqrt(y0 * y0 + y1 * y1 + y2 * y2) AS r FROM emb)", "q AS (SELECT *, r / max(r) OVER () AS q FROM r)",
    "f AS (SELECT *, greatest(0.12, CASE WHEN label % 2 = 1 THEN 0.6 - 0.3 * q ELSE 0.9 - 0.2 * q END) AS f FROM q)", body="SELECT id, round(f * y0, 6) + 0.0 AS y0, round(f * y1, 6) + 0.0 AS y1, round(f * y2, 6) + 0.0 AS y2, 0.0::DOUBLE AS y3 FROM f"))
def contracted_start(s, d):
    p = points(s, d).select("id", "label", F.slice("x", 1, 3).alias("x"))
    flat = I.flattened(I.contracted(p, F.col("label") % 2 == 1, (0.9, 0.2), (0.6, 0.3)).withColumnRenamed("y", "x"))
    return flat.select("id", *[R(F.get("y", F.lit(i))).alias(f"y{i}") for i in range(4)])
