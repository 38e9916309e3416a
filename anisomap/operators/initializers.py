"""Starts for optimizers and linear maps of embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anisomap.functions import vectors as V
from anisomap.operators.graph import symmetric_knn_graph
from anisomap.operators.objectives import symmetric_squares
from anisomap.operators.paths import shortest_paths
from anisomap.operators.spectral import chunk_product, chunks, leading, upright
from anisomap.storage import drop, written


#: Points whose Gram matrix is collected; beyond, products with it are jobs.
LOCAL_POINTS = 2000
#: Vectors of a block, and numbers of the space that products span.
WIDTH, ROOM = 32, 1 << 22


def classical_mds(dissim: DataFrame, dimensions: int = 2) -> DataFrame:
    """(id, y): leading eigenvectors of the centred Gram matrix times the roots of their eigenvalues; signs so that the largest entry is positive.

    Squared dissimilarities are written once, packed as they come, and centred where they are read: for more than
    ``LOCAL_POINTS`` points the eigenvectors are found by products with blocks. Pairs that have the other direction's
    dissimilarity as ``back`` are not shuffled. No points have no rows.
    """
    ids, _, _, y = _scaling(dissim, dimensions)
    return dissim.sparkSession.createDataFrame(pd.DataFrame({"id": ids, "y": y.tolist()}), "id long, y array<double>")


def _scaling(dissim: DataFrame, dimensions: int) -> tuple[np.ndarray, ...]:
    """(ids, means of rows of squares, leading eigenvalues, places) of ``classical_mds``."""
    packed = written(chunks(symmetric_squares(dissim), "q"), "squares")
    rows = packed.groupBy("src").agg((F.sum("total") / (F.sum("n") + 1)).alias("m"), F.sum("own").alias("own")).toPandas().sort_values("src")
    ids, mean = rows["src"].to_numpy(np.int64), rows["m"].to_numpy(float)
    product = chunk_product(packed, ids, mean)
    # What the diagonal adds where no row has it.
    missing = np.where(rows["own"].to_numpy() == 0, (mean.mean() if len(ids) else 0.0) - 2 * mean, 0.0)
    gram = lambda block: -0.5 * (product(block) + missing[:, None] * block)
    if len(ids) <= LOCAL_POINTS:
        m = gram(np.eye(len(ids))) if len(ids) else np.zeros((0, 0))
        values, vectors = np.linalg.eigh((m + m.T) / 2)
        values, vectors = values[::-1][:dimensions], vectors[:, ::-1][:, :dimensions]
    else:
        values, vectors = leading(gram, len(ids), dimensions, width=WIDTH, room=int(np.clip(ROOM // len(ids), 4 * WIDTH, 12 * WIDTH)))
    drop(packed)
    return ids, mean, values, upright(vectors * np.sqrt(np.maximum(values, 0)))


def landmark_mds(dissim: DataFrame, dimensions: int = 2) -> DataFrame:
    """(id, y): classical scaling of landmarks, the sources of ``dissim(src, dst, d)``, and all targets laid out by them.

    Only distances from landmarks are read. The matrix of at most ``LOCAL_POINTS`` landmarks is solved on the driver, that of
    more as in ``classical_mds``; every target's place is a sum over its squared distances to landmarks, one aggregate. With all points as landmarks
    this is ``classical_mds``. Targets must have a distance from every landmark; others are left out.
    """
    spark = dissim.sparkSession
    marks = dissim.select(F.col("src").alias("id")).distinct()
    inner = dissim.join(F.broadcast(marks.withColumnRenamed("id", "dst")), "dst", "left_semi").where("src <> dst").select("src", "dst", "d")
    ids = np.sort(marks.toPandas()["id"].to_numpy(np.int64))
    if len(ids) <= LOCAL_POINTS:
        inner = inner.toPandas()
        q = np.zeros((len(ids),) * 2)
        q[np.searchsorted(ids, inner["src"]), np.searchsorted(ids, inner["dst"])] = inner["d"].to_numpy(float)
        q = ((q + q.T) / 2) ** 2
        mean = q.mean(1) if len(ids) else np.zeros(0)
        g = -0.5 * (q - mean[:, None] - mean[None] + (mean.mean() if len(ids) else 0))
        values, vectors = np.linalg.eigh((g + g.T) / 2)
        values, vectors = values[::-1][:dimensions], vectors[:, ::-1][:, :dimensions]
        top = upright(vectors * np.sqrt(np.maximum(values, 0)))
    else:
        ids, mean, values, top = _scaling(inner, dimensions)
    pull = -0.5 * np.divide(top, values, out=np.zeros_like(top), where=values > 1e-12 * max(values.max(initial=0), 1e-300))
    table = spark.createDataFrame(pd.DataFrame({"src": ids, "m": mean, "p": pull.tolist()}), "src long, m double, p array<double>")
    rows = dissim.where("src <> dst").select("src", "dst", F.pow("d", F.lit(2.0)).alias("q")).unionByName(marks.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("q")))
    moved = rows.join(F.broadcast(table), "src").select("dst", V.scaled("p", F.col("q") - F.col("m")).alias("y"))
    return moved.groupBy(F.col("dst").alias("id")).agg(V.sum_vector("y", max(1, top.shape[1])).alias("y"), F.count("*").alias("n")).where(F.col("n") == len(ids)).select("id", "y")


def isomap(points: DataFrame, k: int = 10, dimensions: int = 2, landmarks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(embedding, shortest paths with predecessors) of the connected undirected neighbour graph.

    With ``landmarks`` (id) only ways from them are sought, and other points are laid out by their distances to them.
    """
    sp = shortest_paths(symmetric_knn_graph(points, k, connected=True), landmarks, directed=False)
    if landmarks is not None:
        sp = written(sp, "paths")
        return landmark_mds(sp.select("src", "dst", F.col("dist").alias("d")), dimensions), sp
    # Ways are as long in both directions.
    return classical_mds(sp.select("src", "dst", F.col("dist").alias("d"), F.col("dist").alias("back")), dimensions), sp


def rotation_to_down(mean: np.ndarray) -> np.ndarray:
    """The rotation that turns a vector of 2 or 3 numbers to the negative last axis; identity for (nearly) zero."""
    d, size = len(mean), float(np.linalg.norm(mean))
    if d not in (2, 3):
        raise ValueError("2 or 3 dimensions")
    if size < V.EPS:
        return np.eye(d)
    a, b = np.asarray(mean, float) / size, -np.eye(d)[-1]
    if d == 2:
        angle = np.arctan2(b[1], b[0]) - np.arctan2(a[1], a[0])
        return np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
    axis, c = np.cross(a, b), float(a @ b)
    if np.linalg.norm(axis) < V.EPS:  # along the axis already, or against it: half a turn about the first axis
        return np.eye(3) if c > 0 else np.diag([1.0, -1.0, -1.0])
    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    return np.eye(3) + k + k @ k / (1 + c)


def linear_map(embedding: DataFrame, matrix: np.ndarray, name: str = "y") -> DataFrame:
    """Rows times a small matrix: y_new = matrix y."""
    rows = [F.array(*[F.lit(float(c)) for c in r]) for r in np.asarray(matrix)]
    return embedding.withColumn(name, F.array(*[V.dot(name, r) for r in rows]))


def rotate_velocity_down(embedding: DataFrame, velocity: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Embedding and velocities turned so that the mean velocity points down the last axis."""
    dimensions = V.width(velocity, "v")
    finite = velocity.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))
    mean = np.array(finite.agg(V.mean_vector("v", dimensions)).first()[0], float)
    if np.isnan(mean).any():  # no velocities
        return embedding, velocity
    r = rotation_to_down(mean)
    return linear_map(embedding, r), linear_map(velocity, r, "v")


#: Names of starts, and what they stand for.
INIT_KINDS = {
    "umap": "umap",
    "umap_2d": "umap",
    "umap2d": "umap",
    "smacof": "smacof",
    "randers_smacof": "smacof",
    "smacof_randers": "smacof",
    "path_frozen": "path_frozen",
    "frozen_paths": "path_frozen",
}


def init_kind(name: object) -> str:
    if not isinstance(name, str):
        raise TypeError("a start is named by text")
    key = name.lower().replace("-", "_")
    if key not in INIT_KINDS:
        raise ValueError(f"unknown start {name!r}; known are {', '.join(sorted(set(INIT_KINDS.values())))}")
    return INIT_KINDS[key]


def named_init(name: str, ids: DataFrame, dimensions: int, umap: DataFrame, sources: dict[str, str]) -> DataFrame:
    """(id, y): the start of a name, for the wanted ids and dimensions: a given UMAP embedding, or a saved one of its kind.

    Raises if there is no such embedding, or if it lacks a wanted id.
    """
    from anisomap.sources.store import align, load_embedding

    kind = init_kind(name)
    if kind != "umap" and kind not in sources:
        raise FileNotFoundError(f"no embedding of kind {kind!r} was saved")
    found = align(ids, umap) if kind == "umap" else load_embedding(ids.sparkSession, sources[kind], ids)
    return adapt_dimension(found.select("id", "y"), dimensions)


def diagonal_view(points: DataFrame, angle: float = 45.0, noise: float = 0.0, seed: int = 42) -> DataFrame:
    """(id, y): the plane of a turned first axis, at the diagonal's length, and the third axis; centred, with noise by the ids."""
    from anisomap.sources.synthetic import normal

    a = np.radians(angle)
    turned = (F.get("x", F.lit(0)) * float(np.cos(a)) - F.get("x", F.lit(1)) * float(np.sin(a))) * float(np.sqrt(2))
    y = points.select("id", F.array(turned, F.get("x", F.lit(2))).alias("y"))

    def centred(e: DataFrame) -> DataFrame:
        return e.join(F.broadcast(e.agg(V.mean_vector("y", 2).alias("m")))).select("id", V.sub("y", "m").alias("y"))

    y = centred(y)
    return centred(y.select("id", V.add("y", F.array(noise * normal(seed), noise * normal(seed + 2))).alias("y"))) if noise else y


def flattened(points: DataFrame) -> DataFrame:
    """(id, y): points with a further coordinate 0."""
    return points.select("id", F.concat("x", F.array(F.lit(0.0))).alias("y"))


#: Fixed values of the branching tree's start: factors of main and secondary branches, and how much they fall.
MAIN_FACTOR, SECOND_FACTOR = (0.82, 0.24), (0.46, 0.26)


def contracted(
    points: DataFrame, secondary: Column, main: tuple[float, float] = MAIN_FACTOR, second: tuple[float, float] = SECOND_FACTOR, noise: float = 0.0, least: float = 0.12, seed: int = 0
) -> DataFrame:
    """(id, y): points drawn to the origin: (factor, its fall from the origin to the farthest point) for main and secondary ones.

    Noise by the ids grows from 0.45 times ``noise`` at the origin to 1.35 times at the farthest point.
    """
    from anisomap.sources.synthetic import normal

    dimensions = V.width(points, "x")
    p = points.withColumn("_s", secondary).withColumn("_r", V.norm("x"))
    p = p.join(F.broadcast(p.agg(F.max("_r").alias("_most")))).withColumn("_q", F.when(F.col("_most") > 0, F.col("_r") / F.col("_most")).otherwise(F.col("_r")))
    factor = F.greatest(F.lit(least), F.when(F.col("_s"), second[0] - second[1] * F.col("_q")).otherwise(main[0] - main[1] * F.col("_q")))
    y = V.scaled("x", factor)
    if noise:
        size = noise * (0.45 + 0.9 * F.col("_q"))
        y = V.add(y, F.array(*[size * normal(seed + 2 * i) for i in range(dimensions)]))
    return p.select("id", y.alias("y"))


def adapt_dimension(embedding: DataFrame, dimensions: int) -> DataFrame:
    """Cut, or filled up with zeros."""
    return embedding.withColumn("y", F.slice(F.concat("y", F.array_repeat(F.lit(0.0), dimensions)), 1, dimensions))


def scale_to_dissimilarities(embedding: DataFrame, dissim: DataFrame, sample: float = 1.0, seed: int = 0) -> DataFrame:
    """Centred, and scaled by the median of d over the distance; ``sample``: share of pairs, by their hash. Scale 1 without any."""
    from anisomap.operators.graph import with_vectors
    from anisomap.operators.pairs import hash_order

    dimensions = V.width(embedding, "y")
    pairs = dissim.where("src <> dst and d > 0 and d < double('infinity')")
    if sample < 1:
        pairs = pairs.where(hash_order(seed, "src", "dst") < int(sample * (1 << 32)))
    ratio = with_vectors(pairs, embedding, "y").withColumn("r", V.distance("a", "b")).where("r > 0").agg(F.percentile(F.col("d") / F.col("r"), F.lit(0.5)).alias("scale"))
    mean = embedding.agg(V.mean_vector("y", dimensions).alias("m"))
    return embedding.join(F.broadcast(mean)).join(F.broadcast(ratio)).select("id", V.scaled(V.sub("y", "m"), F.coalesce("scale", F.lit(1.0))).alias("y"))


def rescale_to_reference(embedding: DataFrame, reference: DataFrame) -> DataFrame:
    """Centred and scaled to the reference's Frobenius norm, and moved to its mean."""
    dimensions = V.width(embedding, "y")

    def summary(e: DataFrame, name: str) -> DataFrame:
        squares = F.sum(V.dot("y", "y"))
        mean = V.mean_vector("y", dimensions)
        return e.agg(mean.alias(f"m_{name}"), squares.alias("_q"), F.count("*").alias("_n")).select(f"m_{name}", F.sqrt(F.col("_q") - F.col("_n") * V.dot(f"m_{name}", f"m_{name}")).alias(f"f_{name}"))

    both = embedding.join(F.broadcast(summary(embedding, "a"))).join(F.broadcast(summary(reference, "b")))
    factor = F.coalesce(F.try_divide(F.col("f_b"), F.col("f_a")), F.lit(1.0))
    return both.select("id", V.add(V.scaled(V.sub("y", "m_a"), factor), "m_b").alias("y"))


def lift_by_time(embedding: DataFrame, times: DataFrame, height: float = 1.0) -> DataFrame:
    """(id, y): a further coordinate, linear in the time clipped to [0, 1]; the first known of ``t``, ``fallback``, 0."""
    columns = [F.col(c) for c in ("t", "fallback") if c in times.columns]
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(*columns, F.lit(0.0))))
    return embedding.join(times, "id", "left").select("id", F.concat("y", F.array(height * t)).alias("y"))
