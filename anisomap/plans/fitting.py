"""Queries that fit embeddings. Coordinates depend on start and line search, so that they return histories and checks."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from anisomap.api import fit
from anisomap.functions.metrics import ConvexMatsumoto, Randers
from anisomap.operators import initializers as I
from anisomap.operators import paths as H
from anisomap.plans.inputs import event_transitions, graph, landmarks, points, trade
from anisomap.plans.pairing import all_pairs
from anisomap.session import ship
from anisomap.storage import written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _register(name, f):
    QUERIES[name] = f


def geodesics(s, d):
    """Shortest paths between all points, over the whole neighbour graph."""
    sp = H.shortest_paths(graph(s, d)).where("src <> dst").select("src", "dst", F.col("dist").alias("d"))
    return written(sp, "geodesics")  # fits read it again and again


def nations(s, d):
    """Directed distances between nations that trade both ways: little trade is far."""
    t = trade(s, d).where("src <> dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "d")
    back = t.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return t.join(back, ["src", "dst"], "left_semi")


_register("fit_smacof", lambda s, d: fit(nations(s, d), Randers(0.3), "smacof_randers", n_init=2, max_iter=100, solver="pinv").history_frame(s))
_register("fit_gd", lambda s, d: fit(nations(s, d), Randers(0.3), "gradient_descent", max_iter=80, seed=1).history_frame(s))
#: Landmarks and their targets, as shares of the points, and how many turns.
MARKS, GOALS = 0.1, 0.35


def _sampled(s, d) -> dict[str, int]:
    n = points(s, d).count()
    return {"n_landmark": math.ceil(MARKS * n), "targets_per_landmark": math.ceil(GOALS * n)}


_register("fit_path_frozen", lambda s, d: fit(geodesics(s, d), Randers(0.3), "path_frozen", outer_iter=4, graph_neighbors=8, seed=1, **_sampled(s, d)).history_frame(s))
_register("fit_soft_bf", lambda s, d: fit(geodesics(s, d), ConvexMatsumoto(0.3), "soft_bellman_ford", max_iter=4, graph_neighbors=6, n_relaxations="settled", on_unreachable="raise", seed=1, **_sampled(s, d)).history_frame(s))
_register("fit_soft_fw", lambda s, d: fit(nations(s, d), Randers(0.3), "datasp", max_iter=8, graph_neighbors=12, n_components=3, seed=1).history_frame(s))
_register("fit_umap", lambda s, d: fit(all_pairs(s, d), Randers(0.2), "finsler_umap", n_neighbors=10, max_iter=100).frame(s))
_register("isomap_init", lambda s, d: I.isomap(points(s, d).select("id", "x"), 10, 2)[0])
_register("landmark_isomap", lambda s, d: I.isomap(points(s, d).select("id", "x"), 10, 2, landmarks(s, d))[0])
_register("classical_mds", lambda s, d: I.classical_mds(all_pairs(s, d, both=True), 2))


def event_map(s, d):
    """A map of event types from their transitions: the whole way from a log to an embedding."""
    t = event_transitions(s, d)
    codes = t.select(F.col("src").alias("name")).union(t.select("dst")).distinct().orderBy("name").collect()
    number = F.create_map(*[F.lit(x) for i, r in enumerate(codes) for x in (r.name, i)])
    pairs = t.where("src <> dst").select(number[F.col("src")].cast("long").alias("src"), number[F.col("dst")].cast("long").alias("dst"), "d")
    return fit(pairs, Randers(0.3), "gradient_descent", max_iter=60, seed=0).frame(s)


_register("event_map", event_map)


def velocity_map(s, d):
    """From points and velocities to scores: directed distances, pair weights, a fit, and how well it keeps them."""
    from anisomap.functions import vectors as V
    from anisomap.operators import evaluate as E
    from anisomap.operators import graph as G
    from anisomap.operators import pairs as P
    from anisomap.plans.inputs import cluster_edges, embedding, knn, labels, velocity

    space, metric = embedding(s, d).withColumnRenamed("y", "x"), Randers(0.3)
    edges, used = G.velocity_directed_graph(space, velocity(s, d), k=10, alpha=0.5)
    dissim = written(H.shortest_paths(edges).where("src <> dst").select("src", "dst", F.col("dist").alias("d")), "dissim")
    plan = E.boundary_plan(labels(s, d), cluster_edges(s), knn(s, d))
    weights = P.pair_weight_pipeline(dissim.withColumn("w", F.lit(1.0)), labels(s, d), 0.5, 0.5, plan, 2.0)
    got = fit(dissim, metric, "path_frozen", weights=weights, outer_iter=3, graph_neighbors=8, seed=1, **_sampled(s, d))
    y = written(got.frame(s), "embedding")
    pairs = E.neighbor_pairs(G.neighbors_from_edges(dissim, 10))
    measured = E.embedding_distances(y, metric, G.with_vectors(pairs, y, "y").select("src", "dst"))
    back = E.embedding_distances(y, metric, pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = measured.join(back.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("e").alias("b")), ["src", "dst"])
    both = both.select("src", "dst", E.asymmetry_score(F.col("e"), F.col("b")).alias("a_embedding"))
    kept = E.asymmetry_preservation(E.both_ways(dissim, pairs, "a_data").join(both, ["src", "dst"])).select("n_pairs", "sign_accuracy", "spearman")
    scores = E.evaluate_distances(dissim.withColumn("w", F.lit(1.0)), y, metric).select("normalized", "median")
    return kept.join(scores).select("n_pairs", *[V.rounded(c).alias(c) for c in ("sign_accuracy", "spearman", "normalized", "median")])


def hole_map(s, d):
    """A Swiss roll with a hole: ways that cross the hole are left out of the fit."""
    from anisomap.operators import dissimilarity as D
    from anisomap.operators import evaluate as E
    from anisomap.operators import graph as G
    from anisomap.sources import synthetic as X

    roll = written(X.swiss_roll(ship(s), 400, alpha=0.5, hole=(0.1, 0.9, 0.4, 0.6)), "roll")
    p = roll.where("not in_hole").select("id", "x", "w")
    border = D.border_of_hole(G.nearest_neighbors(roll.select("id", "x"), 6), roll.where("in_hole").select("id"))
    graph_ = G.symmetric_knn_graph(p.select("id", "x"), 8, connected=True)
    dissim = written(X.current_distances(p, support=graph_).where("src <> dst"), "dissim")
    mask = D.wormhole_mask(dissim, border, p.select("id", "x"), 0.5, 3.0)
    metric = Randers(0.5)
    got = fit(dissim.join(mask.where("keep").select("src", "dst"), ["src", "dst"], "left_semi"), metric, "gradient_descent", max_iter=40, seed=3)
    row = E.evaluate_distances(dissim.withColumn("w", F.lit(1.0)), got.frame(s), metric)
    return row.select("n_pairs", "normalized", "median")


def time_map(s, d):
    """From a neighbour graph and times to an embedding: edges along time are shorter, lengths are scaled by density."""
    from anisomap.operators import dissimilarity as D
    from anisomap.operators import evaluate as E
    from anisomap.operators import graph as G
    from anisomap.plans.inputs import knn, times

    edges = D.temporally_asymmetric(G.symmetrize(G.knn_edges(knn(s, d))), times(s, d), 0.2).select("src", "dst", "d")
    scaled = D.density_scaled(edges, 0.5, "symmetric").select("src", "dst", "d")
    dissim = written(H.shortest_paths(scaled).where("src <> dst").select("src", "dst", F.col("dist").alias("d")), "dissim")
    metric = Randers(0.3)
    got = fit(dissim, metric, "gradient_descent", max_iter=30, seed=1)
    return E.evaluate_distances(dissim.withColumn("w", F.lit(1.0)), got.frame(s), metric).select("n_pairs", "normalized", "median")


def sea_map(s, d):
    """From an archipelago and its current to an embedding of the ways between its points."""
    from anisomap.operators import evaluate as E
    from anisomap.sources import synthetic as X

    p = X.archipelago(ship(s), 250)
    dissim = written(X.current_distances(p, support=X.archipelago_graph(p, 4)).where("src <> dst"), "dissim")
    got = fit(dissim, Randers(0.5), "smacof_randers", n_init=2, max_iter=60)
    return E.evaluate_distances(dissim.withColumn("w", F.lit(1.0)), got.frame(s), Randers(0.5)).select("n_pairs", "normalized", "median")


_register("velocity_map", velocity_map)
_register("time_map", time_map)
_register("sea_map", sea_map)
_register("hole_map", hole_map)
