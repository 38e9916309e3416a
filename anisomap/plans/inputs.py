"""Inputs that the registered queries derive from the sample tables, and the same relations as DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anisomap.functions import vectors as V
from anisomap.operators import graph as G
from anisomap.session import ship
from anisomap.storage import written


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{d}/{name}.parquet")


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")


def embedding(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).select("id", F.slice("x", 1, 3).alias("y"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).select("id", "label")


def knn(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    """The neighbours as a table, so that a query that reads them in several places looks for them once."""
    return written(G.nearest_neighbors(points(spark, d), k), "knn")


def graph(spark: SparkSession, d: str) -> DataFrame:
    return G.symmetrize(G.knn_edges(knn(spark, d)))


def velocity(spark: SparkSession, d: str) -> DataFrame:
    """Centroid of the next label, minus the point, in the first three coordinates."""
    y = points(spark, d).select("id", "label", F.slice("x", 1, 3).alias("y"))
    centre = y.groupBy("label").agg(V.mean_vector("y", 3).alias("c"))
    return y.join(F.broadcast(centre.withColumnRenamed("label", "next")), F.pmod(F.col("label") + 1, F.lit(10)) == F.col("next")).select("id", V.sub("c", "y").alias("v"))


def times(spark: SparkSession, d: str) -> DataFrame:
    t = points(spark, d).select("id", F.get("x", F.lit(3)).alias("c"))
    box = t.agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    return t.join(F.broadcast(box)).select("id", F.when(F.col("id") % 17 != 0, (F.col("c") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("t"))


def border(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).where("id % 29 = 0").select("id")


def landmarks(spark: SparkSession, d: str, share: float = 0.05, seed: int = 7) -> DataFrame:
    """(id): the landmarks that a share of all points are, by the library's own choice."""
    from anisomap.operators.pairs import select_landmarks

    p = points(spark, d)
    return select_landmarks(p, math.ceil(share * p.count()), seed)


def cluster_edges(spark: SparkSession) -> DataFrame:
    return spark.range(10).select(F.col("id").cast("int").alias("src_label"), ((F.col("id") + 1) % 10).cast("int").alias("dst_label"))


def event_transitions(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, n, p, d) between consecutive events of a user."""
    from pyspark.sql import Window

    e = table(spark, d, "events")
    following = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    n = e.select(F.col("event_type").alias("src"), following.alias("dst")).where("dst is not null").groupBy("src", "dst").agg(F.count("*").alias("n"))
    total = n.groupBy("src").agg(F.sum("n").alias("all"))
    return n.join(total, "src").select("src", "dst", "n", (F.col("n") / F.col("all")).alias("p"), (-F.log(F.col("n") / F.col("all"))).alias("d"))


def trade(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, rev, d): revenue from supplier nations to customer nations, d = -ln(share of the source)."""
    t = lambda n: table(spark, d, n)
    lines = t("lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    lines = lines.join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src")), "l_suppkey")
    lines = lines.join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    lines = lines.join(t("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dst")), "o_custkey")
    rev = lines.groupBy("src", "dst").agg(F.sum("rev").alias("rev"))
    total = rev.groupBy("src").agg(F.sum("rev").alias("all"))
    return rev.join(total, "src").select("src", "dst", "rev", (-F.log(F.col("rev") / F.col("all"))).alias("d"))


def direct_pairs(spark: SparkSession, d: str, near: DataFrame | None = None) -> DataFrame:
    """Neighbour pairs (``near``, if they are there already) with the distance in all coordinates as target."""
    return G.knn_edges(knn(spark, d) if near is None else near).withColumn("w", F.lit(1.0))


# The same relations in DuckDB

PTS = "pts AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, label FROM embeddings)"
EMB = "emb AS (SELECT id, x[1] AS y0, x[2] AS y1, x[3] AS y2, label FROM pts)"
KNN = """knn AS (SELECT src, dst, dist, rank FROM (SELECT a.id AS src, b.id AS dst, list_distance(a.x, b.x) AS dist,
  row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS rank FROM pts a JOIN pts b ON a.id <> b.id) WHERE rank <= 10)"""
GSYM = "g AS (SELECT src, dst, max(d) AS d FROM (SELECT src, dst, dist AS d FROM knn UNION ALL SELECT dst, src, dist FROM knn) GROUP BY 1, 2)"
VEL = """cen AS (SELECT label, avg(y0) AS c0, avg(y1) AS c1, avg(y2) AS c2 FROM emb GROUP BY 1),
vel AS (SELECT id, c0 - y0 AS v0, c1 - y1 AS v1, c2 - y2 AS v2 FROM emb JOIN cen ON cen.label = (emb.label + 1) % 10)"""
TIME = "tm AS (SELECT id, CASE WHEN id % 17 <> 0 THEN (x[4] - min(x[4]) OVER ()) / (max(x[4]) OVER () - min(x[4]) OVER ()) END AS t FROM pts)"
#: Neighbour edges with the embedding's difference u, its length r and the cosine s with the last axis.
EDGE = """e0 AS (SELECT src, dst, rank, dist, b.y0 - a.y0 AS u0, b.y1 - a.y1 AS u1, b.y2 - a.y2 AS u2 FROM knn JOIN emb a ON a.id = src JOIN emb b ON b.id = dst),
e1 AS (SELECT *, sqrt(u0 * u0 + u1 * u1 + u2 * u2) AS r FROM e0), e AS (SELECT *, CASE WHEN r > 1e-12 THEN u2 / r ELSE 0 END AS s FROM e1)"""
EVENTS = """n AS (SELECT src, dst, count(*) AS n FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL GROUP BY 1, 2),
tr AS (SELECT src, dst, n, n / sum(n) OVER (PARTITION BY src) AS p, -ln(n / sum(n) OVER (PARTITION BY src)) AS d FROM n)"""
TRADE = """rv AS (SELECT s_nationkey AS src, c_nationkey AS dst, sum(l_extendedprice * (1 - l_discount)) AS rev FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
  JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
td AS (SELECT src, dst, rev, -ln(rev / sum(rev) OVER (PARTITION BY src)) AS d FROM rv)"""


def hashed(seed: int, *columns: str) -> str:
    """``hash_order`` of the pair operators."""
    h = f"{seed}::BIGINT"
    for c in columns:
        h = f"((({h}) * 31 + {c}) % 2147483648) * 2654435761 % 4294967296"
    return h


LANDMARKS = f"lk AS (SELECT id FROM pts ORDER BY {hashed(7, 'id')}, id LIMIT (SELECT ceil(0.05 * count(*))::BIGINT FROM embeddings))"
TARGETS = LANDMARKS.replace("lk AS", "tg AS").replace("7::BIGINT", "8::BIGINT")


def sql(*parts: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{', '.join(parts)} {body}"
