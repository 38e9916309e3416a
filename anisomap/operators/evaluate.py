"""Scores of embeddings: stress, stretch, asymmetry preservation, velocity coherence, gaps. Undefined scores are NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anisomap.functions import vectors as V
from anisomap.functions.metrics import Metric
from anisomap.operators import graph as G
from anisomap.operators.objectives import stress, with_lengths
from anisomap.operators.paths import shortest_paths
from anisomap.operators.quantiles import large_quantiles
from anisomap.storage import written

QUANTILES = {"median": 0.5, "q05": 0.05, "q25": 0.25, "q75": 0.75, "q95": 0.95}

DISTANCE_MODES = {"direct": "direct", "euclidean": "direct", "geodesic": "geodesic", "graph": "geodesic"}


def embedding_distances(embedding: DataFrame, metric: Metric, pairs: DataFrame, mode: str = "direct", k: int = 10, most_hops: int | None = None) -> DataFrame:
    """Pairs with ``e``: direct lengths, or shortest paths (of at most ``most_hops`` edges) on the embedding's own graph (NULL where there is none)."""
    if mode not in DISTANCE_MODES:
        raise ValueError("mode is direct or geodesic")
    if DISTANCE_MODES[mode] == "direct":
        return with_lengths(pairs, embedding, metric)
    points = embedding.select("id", F.col("y").alias("x"))
    sp = shortest_paths(G.metric_graph(points, G.symmetric_knn_graph(points, k), metric), most_hops=most_hops, wanted=pairs)
    return pairs.join(sp.select("src", "dst", F.col("dist").alias("e")), ["src", "dst"], "left")


def full_geodesic_stress(dissim: DataFrame, embedding: DataFrame, metric: Metric, k: int = 10) -> DataFrame:
    """One row (n_pairs, n_unreachable, raw, normalized): stress of all pairs on the connected neighbour graph; infinite if one is unreachable."""
    points = embedding.select("id", F.col("y").alias("x"))
    return _path_stress(dissim, G.metric_graph(points, G.symmetric_knn_graph(points, k, connected=True), metric), True)


def support_stress(dissim: DataFrame, embedding: DataFrame, support: DataFrame | None = None, k: int = 10) -> DataFrame:
    """``full_geodesic_stress`` by straight lengths, both ways alike, over a given support or the embedding's own neighbours."""
    points = embedding.select("id", F.col("y").alias("x"))
    support = G.symmetric_knn_graph(points, k, connected=True) if support is None else support
    lengths = G.with_vectors(support.select("src", "dst"), points).select("src", "dst", V.distance("a", "b").alias("d"))
    return _path_stress(dissim, lengths, False)


def _path_stress(dissim: DataFrame, edges: DataFrame, directed: bool) -> DataFrame:
    pairs = dissim.where("src <> dst").select("src", "dst", "d")
    sp = shortest_paths(edges, directed=directed, wanted=pairs)
    measured = pairs.join(sp.select("src", "dst", F.col("dist").alias("e")), ["src", "dst"], "left")
    gap = F.col("e") - F.col("d")
    sums = measured.agg(F.count("*").alias("n_pairs"), F.count_if(F.col("e").isNull()).alias("n_unreachable"), F.sum(gap * gap).alias("raw"), F.sum(F.col("d") * F.col("d")).alias("denom"))
    lost = F.col("n_unreachable") > 0
    inf = F.lit(float("inf"))
    return sums.select("n_pairs", "n_unreachable", F.when(lost, inf).otherwise(F.col("raw")).alias("raw"), F.when(lost, inf).otherwise(F.sqrt(F.try_divide("raw", "denom"))).alias("normalized"))


def stretch_summary(measured: DataFrame, eps: float = 1e-12) -> DataFrame:
    """One row over e / d for d > eps: n, mean, population deviation, quantiles, extremes."""
    r = measured.where(F.col("e").isNotNull() & (F.col("d") > eps)).select((F.col("e") / F.col("d")).alias("r"))
    known = large_quantiles(r, "r", list(QUANTILES.values()))
    quantiles = [(F.percentile("r", F.lit(q)) if known is None else F.lit(known[i])).alias(name) for i, (name, q) in enumerate(QUANTILES.items())]
    return r.agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"), *quantiles, F.min("r").alias("min"), F.max("r").alias("max"))


def asymmetry_score(forward: Column, backward: Column, eps: float = 1e-12) -> Column:
    """(backward - forward) / (forward + backward): positive where forward is cheaper."""
    total = forward + backward
    return F.when(F.abs(total) > eps, (backward - forward) / F.when(F.abs(total) > eps, total))


def neighbor_pairs(knn: DataFrame, unique: bool = True) -> DataFrame:
    """(src, dst): neighbour pairs, each once with the smaller id first if ``unique``."""
    p = knn.where("src <> dst").select("src", "dst")
    return p.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct() if unique else p


def both_ways(dissim: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """Pairs with the asymmetry score of a table of directed values."""
    f = dissim.select("src", "dst", F.col("d").alias("f"))
    b = dissim.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("d").alias("b"))
    return pairs.join(f, ["src", "dst"]).join(b, ["src", "dst"]).withColumn(name, asymmetry_score(F.col("f"), F.col("b"))).drop("f", "b")


def with_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Average ranks. Values are dealt over tasks by ranges; sums of the ranges before are added to those within one."""
    values = df.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    # Written with the number of its range, which a second run of the shuffle might give differently.
    values = written(values.repartitionByRange("_v").withColumn("_range", F.spark_partition_id()), "values")
    earlier = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = values.groupBy("_range").agg(F.sum("_n").alias("_all"))  # a row a task
    ranges = ranges.select("_range", earlier(Window.orderBy("_range"), "_all").alias("_base"))
    within = values.join(F.broadcast(ranges), "_range").withColumn("_before", earlier(Window.partitionBy("_range").orderBy("_v"), "_n"))
    ranks = within.select("_v", (F.col("_base") + F.col("_before") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranks, F.col(column) == F.col("_v")).drop("_v")


def guarded_corr(x: str, y: str) -> Column:
    """Pearson correlation; NULL for fewer than two rows or a constant side."""
    ok = (F.count("*") >= 2) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(ok, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def asymmetry_preservation(pairs: DataFrame, threshold: float = 0.02) -> DataFrame:
    """One row from (a_data, a_embedding) where |a_data| > threshold."""
    x, y = F.col("a_data"), F.col("a_embedding")
    strong = pairs.where(x.isNotNull() & y.isNotNull() & (F.abs(x) > threshold))
    ranked = with_rank(with_rank(strong, "a_data", "rx"), "a_embedding", "ry")
    same = (F.signum(x) == F.signum(y)).cast("double")
    return ranked.agg(
        F.count("*").alias("n_pairs"), F.avg(same).alias("sign_accuracy"), F.try_divide(F.sum(F.abs(x) * same), F.sum(F.abs(x))).alias("weighted_sign_accuracy"),
        guarded_corr("rx", "ry").alias("spearman"), guarded_corr("a_data", "a_embedding").alias("pearson"), F.try_divide(F.sum(x * y), F.sum(x * x)).alias("gamma"),
        F.try_divide(F.sum((x - y) * (x - y)), F.sum(x * x)).alias("normalized_mse"), F.avg(F.abs(x)).alias("mean_abs_data"), F.avg(F.abs(y)).alias("mean_abs_embedding"),
    )


def evaluate_distances(pairs: DataFrame, embedding: DataFrame, metric: Metric, mode: str = "direct", k: int = 10, on_unreachable: str = "warn_skip", most_hops: int | None = None) -> DataFrame:
    """One row: stress, stretch and counts of pairs; unreachable ones are skipped, raise, or make the stress infinite."""
    if on_unreachable not in ("warn_skip", "raise", "inf"):
        raise ValueError("on_unreachable is warn_skip, raise or inf")
    measured = embedding_distances(embedding, metric, pairs, mode, k, most_hops)
    if DISTANCE_MODES[mode] == "geodesic":
        measured = written(measured, "measured")  # read three times
    missing = measured.agg(F.count_if(F.col("e").isNull()).alias("n_unreachable"))
    if on_unreachable == "raise" and missing.first()[0]:
        raise ValueError("some pairs are unreachable")
    row = stress(measured).join(missing).join(stretch_summary(measured).drop("n"))
    if on_unreachable == "inf":
        for c in ("raw", "normalized"):
            row = row.withColumn(c, F.when(F.col("n_unreachable") > 0, F.lit(float("inf"))).otherwise(F.col(c)))
    return row


def opposite_asymmetry(pairs: DataFrame) -> DataFrame:
    """One row of correlation, slope and RMSE between (D - D') / (D + D') of two tables, over pairs with both."""
    x, y = F.col("f_data"), F.col("f_embedding")
    return pairs.agg(guarded_corr("f_data", "f_embedding").alias("pearson"), F.try_divide(F.sum(x * y), F.sum(x * x)).alias("beta"), F.sqrt(F.avg((x - y) * (x - y))).alias("rmse"))


# velocity


def project_velocity_graph(embedding: DataFrame, transitions: DataFrame, positive_only: bool = True) -> DataFrame:
    """(id, v): sum over targets of (p / sum |p|) times the unit vector towards them; zero without targets."""
    dimensions = V.width(embedding, "y")
    t = transitions.where("p > 0") if positive_only else transitions.where("p <> 0")
    mass = t.groupBy("src").agg(F.sum(F.abs("p")).alias("mass"))
    u = V.sub("b", "a")
    steps = G.with_vectors(t, embedding, "y").join(mass, "src").withColumn("u", u).withColumn("r", V.norm("u"))
    parts = steps.where(F.col("r") > V.EPS).select("src", V.scaled("u", F.col("p") / F.col("mass") / F.col("r")).alias("v"))
    total = parts.groupBy("src").agg(V.sum_vector("v", dimensions).alias("v"))
    return embedding.select("id").join(total.withColumnRenamed("src", "id"), "id", "left").select("id", F.coalesce("v", F.array_repeat(F.lit(0.0), dimensions)).alias("v"))


def project_velocity_mean_corrected(embedding: DataFrame, transitions: DataFrame) -> DataFrame:
    """(id, v): sum of p times unit vectors, minus the mean p times their sum."""
    dimensions = V.width(embedding, "y")
    mean = transitions.groupBy("src").agg(F.avg("p").alias("mean"))
    steps = G.with_vectors(transitions, embedding, "y").join(mean, "src").withColumn("u", V.sub("b", "a")).withColumn("r", V.norm("u"))
    parts = steps.where(F.col("r") > V.EPS).select("src", V.scaled("u", (F.col("p") - F.col("mean")) / F.col("r")).alias("v"))
    total = parts.groupBy("src").agg(V.sum_vector("v", dimensions).alias("v"))
    return embedding.select("id").join(total.withColumnRenamed("src", "id"), "id", "left").select("id", F.coalesce("v", F.array_repeat(F.lit(0.0), dimensions)).alias("v"))


def boundary_plan(labels: DataFrame, cluster_edges: DataFrame, knn: DataFrame) -> DataFrame:
    """(src_label, dst_label, cell, nbr): neighbours across each wanted pair of clusters."""
    a = labels.select(F.col("id").alias("src"), F.col("label").alias("src_label"))
    b = labels.select(F.col("id").alias("dst"), F.col("label").alias("dst_label"))
    crossing = knn.select("src", "dst").where("src <> dst").join(a, "src").join(b, "dst")
    return crossing.join(F.broadcast(cluster_edges.distinct()), ["src_label", "dst_label"]).select("src_label", "dst_label", F.col("src").alias("cell"), F.col("dst").alias("nbr"))


def plan_hash(labels: DataFrame, cluster_edges: DataFrame, knn: DataFrame) -> DataFrame:
    """One row: an order-free digest of all that a plan is made from, to see whether a stored one still fits."""
    parts = [
        knn.select(F.lit("knn").alias("of"), F.xxhash64("src", "rank", "dst").alias("h")),
        labels.select(F.lit("label").alias("of"), F.xxhash64("id", F.col("label").cast("string")).alias("h")),
        cluster_edges.distinct().select(F.lit("edge").alias("of"), F.xxhash64(F.col("src_label").cast("string"), F.col("dst_label").cast("string")).alias("h")),
    ]
    rows = parts[0].union(parts[1]).union(parts[2])
    each = rows.groupBy("of").agg(F.concat_ws("|", "of", F.count("*"), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")).alias("text"))
    return each.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("text")), ";").cast("binary"), 256).alias("hash"))


def boundary_cells(plan: DataFrame, embedding: DataFrame, velocity: DataFrame) -> DataFrame:
    """(src_label, dst_label, cell, score): mean cosine between a cell's velocity and the ways to its boundary neighbours."""
    edges = G.with_vectors(plan.withColumnsRenamed({"cell": "src", "nbr": "dst"}), embedding, "y").join(velocity.select(F.col("id").alias("src"), "v"), "src")
    return edges.groupBy("src_label", "dst_label", F.col("src").alias("cell")).agg(F.avg(V.cosine("v", V.sub("b", "a"))).alias("score"))


def boundary_correctness(plan: DataFrame, embedding: DataFrame, velocity: DataFrame) -> DataFrame:
    """(src_label, dst_label, n_cells, score) of every transition, and a row with NULL labels over all cells."""
    cells = boundary_cells(plan, embedding, velocity)
    return cells.groupingSets([["src_label", "dst_label"], []], "src_label", "dst_label").agg(F.count("score").alias("n_cells"), F.avg("score").alias("score"))


def cluster_coherence(labels: DataFrame, knn: DataFrame, velocity: DataFrame) -> DataFrame:
    """(label, n_cells, score): mean cosine between velocities of neighbours in a cluster; a NULL label over all cells."""
    a = labels.select(F.col("id").alias("src"), "label")
    b = labels.select(F.col("id").alias("dst"), F.col("label").alias("other"))
    same = knn.where("src <> dst").select("src", "dst").join(a, "src").join(b, "dst").where("label = other")
    v = velocity.select(F.col("id").alias("src"), F.col("v").alias("va")), velocity.select(F.col("id").alias("dst"), F.col("v").alias("vb"))
    cells = same.join(v[0], "src").join(v[1], "dst").groupBy("label", "src").agg(F.avg(V.cosine("va", "vb")).alias("score"))
    return cells.groupingSets([["label"], []], "label").agg(F.count("score").alias("n_cells"), F.avg("score").alias("score"))


def global_coherence(velocity: DataFrame, eps: float = V.EPS) -> DataFrame:
    """One row: length of the mean unit velocity over those longer than eps; velocities with NaN take no part."""
    dimensions = V.width(velocity, "v")
    unit = velocity.withColumn("r", V.norm("v")).where(V.finite("r") & (F.col("r") > eps)).select(V.scaled("v", 1 / F.col("r")).alias("u"))
    return unit.agg(F.count("*").alias("n"), V.mean_vector("u", dimensions).alias("m")).select("n", F.when(F.col("n") > 0, V.norm("m")).alias("gvcoh"))


def velocity_alignment(pairs: DataFrame, points: DataFrame, velocity: DataFrame, embedding: DataFrame, projected: DataFrame, eps: float = 1e-12) -> DataFrame:
    """One row: rank correlation and sign agreement of cos(velocity, way) in data and in embedding space."""
    data = G.with_vectors(pairs, points).join(velocity.select(F.col("id").alias("src"), "v"), "src").select("src", "dst", V.cosine("v", V.sub("b", "a")).alias("c_data"))
    emb = G.with_vectors(pairs, embedding, "y").join(projected.select(F.col("id").alias("src"), "v"), "src").select("src", "dst", V.cosine("v", V.sub("b", "a")).alias("c_embedding"))
    both = data.join(emb, ["src", "dst"]).where("c_data is not null and c_embedding is not null")
    ranked = with_rank(with_rank(both, "c_data", "rx"), "c_embedding", "ry")
    x, y = F.col("c_data"), F.col("c_embedding")
    signed = (F.abs(x) > eps) & (F.abs(y) > eps)
    return ranked.agg(F.count("*").alias("n_pairs"), guarded_corr("rx", "ry").alias("spearman"), F.avg(F.when(signed, (F.signum(x) == F.signum(y)).cast("double"))).alias("sign_accuracy"))


# gaps


def gap_selection(labels: DataFrame, ordering: DataFrame, removed: list, before: list | None = None, after: list | None = None, n: int | None = None) -> DataFrame:
    """(id, grp): cells of removed labels, and those before and after, by label or as the n nearest in the ordering."""
    gone = labels.where(F.col("label").isin(removed)).select("id", F.lit("removed").alias("grp"))
    rest = labels.where(~F.col("label").isin(removed))
    if n is None:
        pick = lambda names, grp: rest.where(F.col("label").isin(names or [])).select("id", F.lit(grp).alias("grp"))
        return gone.unionByName(pick(before, "before")).unionByName(pick(after, "after"))
    span = gone.join(ordering, "id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    timed = rest.join(ordering, "id").where("t is not null").join(F.broadcast(span))
    early = timed.where("t < lo").orderBy(F.desc("t"), "id").limit(n).select("id", F.lit("before").alias("grp"))
    late = timed.where("t > hi").orderBy("t", "id").limit(n).select("id", F.lit("after").alias("grp"))
    return gone.unionByName(early).unionByName(late)


REPRESENTATIVES = ("medoid", "centroid", "median")


def gap_distance(embedding: DataFrame, groups: DataFrame, representative: str = "medoid", eps: float = V.EPS) -> DataFrame:
    """One row: distance between the representatives of the groups before and after, and its ratio to the largest distance in the whole embedding.

    The medoid needs all distances within a group; they are compared in blocks, of which only sums leave.
    """
    if representative not in REPRESENTATIVES:
        raise ValueError(f"representative is one of {', '.join(REPRESENTATIVES)}")
    dimensions = V.width(embedding, "y")
    cells = embedding.join(groups.where("grp in ('before', 'after')"), "id").select("id", "grp", "y")
    if representative == "medoid":
        sums = _distance_sums(cells)
        best = sums.groupBy("grp").agg(F.min(F.struct("total", "id")).alias("m")).select("grp", F.col("m.id").alias("id"))
        rep = cells.join(best, ["grp", "id"]).select("grp", "y")
    elif representative == "centroid":
        mean = cells.groupBy("grp").agg(V.mean_vector("y", dimensions).alias("c"))
        best = cells.join(mean, "grp").groupBy("grp").agg(F.min(F.struct(V.distance("y", "c").alias("r"), "id")).alias("m")).select("grp", F.col("m.id").alias("id"))
        rep = cells.join(best, ["grp", "id"]).select("grp", "y")
    else:
        rep = cells.groupBy("grp").agg(F.array(*[F.percentile(F.get("y", F.lit(i)), F.lit(0.5)) for i in range(dimensions)]).alias("y"))
    ends = rep.groupBy().agg(F.first(F.when(F.col("grp") == "before", F.col("y")), True).alias("a"), F.first(F.when(F.col("grp") == "after", F.col("y")), True).alias("b"))
    most = largest_distance(embedding)
    return ends.join(most).select(V.distance("a", "b").alias("gap_distance"), "max_distance", (V.distance("a", "b") / F.greatest("max_distance", F.lit(eps))).alias("normalized_gap"))


def _blocks(cells: DataFrame, work, schema: str) -> DataFrame:
    points = cells.select("id", F.concat(F.array((F.col("grp") == "after").cast("double")), F.col("y")).alias("x"))
    return G._in_blocks(points, work, G.BLOCK)


def _distance_sums(cells: DataFrame) -> DataFrame:
    """(grp, id, total): sums of distances to the cells of the same group."""
    import numpy as np

    def work(ids, x, others, y):
        total = [float(G._exact(row[1:], y[y[:, 0] == row[0], 1:]).sum()) for row in x]
        return ids, ids, np.array(total)

    sums = _blocks(cells, work, "").groupBy(F.col("src").alias("id")).agg(F.sum("dist").alias("total"))
    return cells.select("id", "grp").join(sums, "id")


def largest_distance(embedding: DataFrame) -> DataFrame:
    """One row: the largest distance between two points, exactly.

    The farthest point from the mean has some point at a distance m from it. Two points that are farther apart than m
    are both at least m - r from the mean, where r is the largest such distance: only these are compared, in blocks.
    """
    import numpy as np

    dimensions = V.width(embedding, "y")
    mean = embedding.agg(V.mean_vector("y", dimensions).alias("c"))
    out = embedding.select("id", "y").join(F.broadcast(mean)).select("id", "y", V.distance("y", "c").alias("r"))
    far = out.agg(F.max(F.struct("r", "id", "y")).alias("f")).select(F.col("f.y").alias("fy"), F.col("f.r").alias("fr"))
    known = embedding.join(F.broadcast(far)).agg(F.max(V.distance("y", "fy")).alias("m"), F.max("fr").alias("fr"))
    wide = out.join(F.broadcast(known)).where(F.col("r") >= (F.col("m") - F.col("fr")) * (1 - 1e-9)).select("id", F.col("y").alias("x"))

    def work(ids, x, others, y):
        most = max(float(G._exact(row, y).max()) for row in x)
        return ids[:1], others[:1], np.array([most])

    return G._in_blocks(wide, work, G.BLOCK).agg(F.max("dist").alias("max_distance"))


def velocity_scale(embedding: DataFrame, velocity: DataFrame, fraction: float = 0.05) -> DataFrame:
    """One row: factor that gives the median velocity a length of ``fraction`` of the embedding's largest span."""
    dimensions = V.width(embedding, "y")
    spans = [F.max(F.get("y", F.lit(i))) - F.min(F.get("y", F.lit(i))) for i in range(dimensions)]
    span = embedding.agg((F.greatest(*spans) if dimensions > 1 else spans[0]).alias("span"))
    median = velocity.select(V.norm("v").alias("r")).where("r > 0").agg(F.percentile("r", F.lit(0.5)).alias("median"))
    return span.join(median).select((fraction * F.col("span") / F.col("median")).alias("scale"))


def tempered_velocity(velocity: DataFrame, power: float) -> DataFrame:
    """(id, v): the same directions, norms to a power; zeros stay."""
    r = V.norm("v")
    return velocity.select("id", F.when(r > V.EPS, V.scaled("v", F.pow(r, F.lit(power)) / r)).otherwise(F.col("v")).alias("v"))


def corner_pair(points: DataFrame) -> DataFrame:
    """(first, last): the points nearest to the lower left and upper right corner of the scaled plane."""
    x0, x1 = F.get("x", F.lit(0)), F.get("x", F.lit(1))
    box = points.agg(F.min(x0).alias("a0"), F.max(x0).alias("b0"), F.min(x1).alias("a1"), F.max(x1).alias("b1"))
    unit = lambda x, a, b: F.coalesce(F.try_divide(x - F.col(a), F.col(b) - F.col(a)), F.lit(0.0))
    s = points.join(F.broadcast(box)).select("id", (unit(x0, "a0", "b0") + unit(x1, "a1", "b1")).alias("s"))
    return s.agg(F.min(F.struct("s", "id")).alias("lo"), F.max(F.struct("s", -F.col("id"))).alias("hi")).select(F.col("lo.id").alias("first"), (-F.col("hi")["col2"]).alias("last"))


def project_onto_components(velocity: DataFrame, components: list[list[float]]) -> DataFrame:
    """(id, v): product of vectors (NULL components count as 0) with a few principal axes."""
    clean = F.transform("v", lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)))
    rows = velocity.select("id", clean.alias("v"))
    axes = [F.array(*[F.lit(float(c)) for c in axis]) for axis in components]
    return rows.select("id", F.array(*[V.dot("v", a) for a in axes]).alias("v"))


def evaluation_row(name: str, pairs: DataFrame, points: DataFrame, velocity: DataFrame, embedding: DataFrame, transitions: DataFrame, labels: DataFrame, cluster_edges: DataFrame, knn: DataFrame) -> DataFrame:
    """One row of velocity scores of an embedding: cbdir, icvcoh, gvcoh, spearman_cos, sign_correctness."""
    projected = project_velocity_mean_corrected(embedding, transitions)
    cb = boundary_correctness(boundary_plan(labels, cluster_edges, knn), embedding, projected).where("src_label is null and dst_label is null").select(F.col("score").alias("cbdir"))
    ic = cluster_coherence(labels, knn, projected).where("label is null").select(F.col("score").alias("icvcoh"))
    gv = global_coherence(projected).select("gvcoh")
    al = velocity_alignment(pairs, points, velocity, embedding, projected).select(F.col("spearman").alias("spearman_cos"), F.col("sign_accuracy").alias("sign_correctness"))
    return cb.join(ic).join(gv).join(al).select(F.lit(name).alias("name"), "cbdir", "icvcoh", "gvcoh", "spearman_cos", "sign_correctness")
