"""Synthetic point sets, fields and segments. Random numbers come from integer hashes of row ids, so that they repeat,
in other engines too. A field ``w`` is one of Randers metrics: a way u takes |u| + w.u, and currents run against it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from anisomap.functions import vectors as V

#: Multipliers of the hash, and the bits that are mixed in after each.
MIX = ((1103515245, 15), (1597334677, 13), (1812433253, 16))

# Fixed values of the archipelago: ellipses, the base current, and bumps (x, y, spread of x, spread of y, height).
ISLANDS = [
    {"cx": 4.25, "cy": 3.0, "rx": 0.72, "ry": 2.35, "angle_deg": 4.0},
    {"cx": 6.9, "cy": 1.45, "rx": 0.88, "ry": 0.42, "angle_deg": -18.0},
    {"cx": 7.8, "cy": 4.55, "rx": 0.94, "ry": 0.46, "angle_deg": 22.0},
    {"cx": 9.45, "cy": 3.05, "rx": 0.58, "ry": 0.86, "angle_deg": -10.0},
]
BASE_CURRENT = (1.0, -0.08)
LATERAL_BUMPS = [(5.5, 4.7, 1.8, 0.9, -0.32), (8.6, 1.25, 1.7, 0.75, 0.26)]
SPEED_BUMPS = [(5.55, 3.0, 0.8, 1.2, -0.26), (8.6, 3.25, 0.75, 1.05, -0.22), (10.8, 1.2, 1.0, 0.8, 0.10)]


def uniform(seed: int, c: Column | str = "id") -> Column:
    """A number in [0, 1) from a row's id: three steps of multiplying and mixing, modulo 2^31."""
    size = F.lit(1 << 31)
    h = F.pmod((F.col(c) if isinstance(c, str) else c) + F.lit(seed % (1 << 31) * 7919).cast("long"), size)
    for factor, bits in MIX:
        h = F.pmod(h * F.lit(factor).cast("long") + 12345, size)
        h = h.bitwiseXOR(F.shiftright(h, bits))
    return h / F.lit(float(1 << 31))


def normal(seed: int, c: Column | str = "id") -> Column:
    return F.sqrt(-2 * F.log(1 - uniform(seed, c))) * F.cos(2 * math.pi * uniform(seed + 1, c))


def vortical_sea(spark: SparkSession, n: int = 2000, side: float = 10.0, frequency: float = 2.0, alpha: float = 0.8, seed: int = 0) -> DataFrame:
    """(id, x, w): points in a square and the field (sin fx + cos fy, cos fx - sin fy), scaled to a length of alpha at most."""
    p = spark.range(n).select("id", (side * uniform(seed)).alias("a"), (side * uniform(seed + 7)).alias("b"))
    u, v = F.sin(frequency * F.col("a")) + F.cos(frequency * F.col("b")), F.cos(frequency * F.col("a")) - F.sin(frequency * F.col("b"))
    p = p.select("id", F.array("a", "b").alias("x"), u.alias("u"), v.alias("v"))
    most = p.agg(F.max(F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))).alias("most"))
    return p.join(F.broadcast(most)).select("id", "x", F.array(F.col("u") / F.col("most") * alpha, F.col("v") / F.col("most") * alpha).alias("w"))


def river(spark: SparkSession, n: int = 200, length: float = 10.0, width: float = 1.0, alpha: float = 0.2, seed: int = 0) -> DataFrame:
    """(id, x, w): the field runs along the river, alpha where it is strongest and 0 at the banks."""
    p = spark.range(n).select("id", (length * uniform(seed)).alias("a"), (width * uniform(seed + 3)).alias("b"))
    p = p.withColumn("u", 1 - F.abs(2 * F.col("b") / width - 1))
    most = p.agg(F.max("u").alias("most"))
    return p.join(F.broadcast(most)).select("id", F.array("a", "b").alias("x"), F.array(alpha * F.col("u") / F.col("most"), F.lit(0.0)).alias("w"))


def bumps(x: Column, y: Column, heights: list[tuple[float, float, float, float, float]]) -> Column:
    """Sum of Gaussian bumps."""
    out = F.lit(0.0)
    for cx, cy, sx, sy, height in heights:
        dx, dy = (x - cx) / sx, (y - cy) / sy
        out = out + height * F.exp(-0.5 * (dx * dx + dy * dy))
    return out


def archipelago_current(points: DataFrame, obstacles: list[dict[str, float]]) -> DataFrame:
    """(id, x, current): the base current bent by waves and bumps, turned along the nearest island, at a speed by place.

    The speed rises with x from the points' least to their largest, and lies between 0.38 and 0.98.
    """
    from anisomap.operators.graph import nearest_obstacle_geometry

    size = math.hypot(*BASE_CURRENT)
    bx, by = (F.lit(c / size) for c in BASE_CURRENT)
    x, y = F.get("x", F.lit(0)), F.get("x", F.lit(1))
    east = bx + 0.10 * F.sin(0.8 * y - 0.25 * x)
    north = by + 0.18 * F.sin(0.65 * x + 1.15 * y) + 0.12 * F.sin(1.4 * y) + bumps(x, y, LATERAL_BUMPS)
    near = nearest_obstacle_geometry(x, y, obstacles) if obstacles else F.lit(None).cast("struct<distance:double,nx:double,ny:double>")
    p = points.select("id", "x", east.alias("e"), north.alias("n"), near.alias("o"))
    nx, ny = F.col("o.nx"), F.col("o.ny")
    # How much an island counts: 1 at its shore, little from its size on.
    weight, across = F.exp(-F.pow(F.col("o.distance") / 0.7, F.lit(2.0))), F.col("e") * nx + F.col("n") * ny
    side = F.when(-ny * bx + nx * by < 0, -1.0).otherwise(1.0)
    turned = lambda f, normal, tangent, base: f - weight * across * normal + 0.16 * weight * side * tangent + 0.1 * (1 - weight) * base
    p = p.withColumn("te", F.coalesce(turned(F.col("e"), nx, -ny, bx), "e")).withColumn("tn", F.coalesce(turned(F.col("n"), ny, nx, by), "n"))
    p = p.withColumn("r", F.sqrt(F.col("te") * F.col("te") + F.col("tn") * F.col("tn")))
    ends = p.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    along = F.when(F.col("hi") - F.col("lo") > V.EPS, (x - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    speed = F.greatest(F.lit(0.38), F.least(F.lit(0.98), 0.78 + 0.12 * along + bumps(x, y, SPEED_BUMPS)))
    unit = lambda f, base: speed * F.when(F.col("r") > V.EPS, F.col(f) / F.col("r")).otherwise(base)
    return p.join(F.broadcast(ends)).select("id", "x", F.array(unit("te", bx), unit("tn", by)).alias("current"))


def water_points(spark: SparkSession, n: int, width: float, height: float, obstacles: list[dict[str, float]], seed: int = 0) -> DataFrame:
    """(id, x): n points of a box outside the ellipses, one in each cell of a grid at most; cells are chosen by a hash."""
    from anisomap.operators.graph import inside_any_obstacle

    cells = math.ceil(2.0 * n)
    while True:
        columns = math.ceil(math.sqrt(cells * width / height))
        rows = math.ceil(cells / columns)
        a = (F.col("id") % columns + uniform(seed)) * (width / columns)
        b = (F.floor(F.col("id") / columns) + uniform(seed + 5)) * (height / rows)
        p = spark.range(columns * rows).select("id", F.array(a, b).alias("x"), uniform(seed + 9).alias("h"))
        if obstacles:
            p = p.where(~inside_any_obstacle(F.get("x", F.lit(0)), F.get("x", F.lit(1)), obstacles))
        if not n or p.count() >= n:
            return p.orderBy("h", "id").limit(n).select("id", "x")
        cells *= 2


def archipelago(spark: SparkSession, n: int = 2000, width: float = 12.0, height: float = 6.0, obstacles: list[dict[str, float]] | None = None, alpha: float = 0.8, seed: int = 0) -> DataFrame:
    """(id, x, w): points of a box outside the ellipses (by default ``ISLANDS``) and the field against their current, times alpha."""
    obstacles = ISLANDS if obstacles is None else obstacles
    p = archipelago_current(water_points(spark, n, width, height, obstacles, seed), obstacles)
    return p.select("id", "x", V.scaled("current", F.lit(-float(alpha))).alias("w"))


def archipelago_graph(points: DataFrame, k: int = 10, obstacles: list[dict[str, float]] | None = None) -> DataFrame:
    """The support of the archipelago's ways: edges that pass all islands, linked where these part them."""
    from anisomap.operators.graph import obstacle_graph

    return obstacle_graph(points.select("id", "x"), ISLANDS if obstacles is None else obstacles, k)


def swiss_roll(spark: SparkSession, n: int = 1000, alpha: float = 0.35, hole: tuple[float, float, float, float] | None = None, seed: int = 0) -> DataFrame:
    """(id, x, w, in_hole): (t cos t, y, t sin t) with the unit tangent times alpha; the hole is a box of (u, v) in [0, 1]."""
    u, v = uniform(seed), uniform(seed + 11)
    t = 1.5 * math.pi * (1 + 2 * u)
    tx, tz = F.cos(t) - t * F.sin(t), F.sin(t) + t * F.cos(t)
    size = F.sqrt(tx * tx + tz * tz)
    inside = F.lit(False) if hole is None else u.between(hole[0], hole[1]) & v.between(hole[2], hole[3])
    return spark.range(n).select("id", F.array(t * F.cos(t), 21 * v, t * F.sin(t)).alias("x"), F.array(alpha * tx / size, F.lit(0.0), alpha * tz / size).alias("w"), inside.alias("in_hole"))


def spiral(spark: SparkSession, n: int = 1000, noise: float = 0.015, seed: int = 0) -> DataFrame:
    """(id, t, x): a rising spiral with noise in the plane."""
    t = 1.1 * F.col("id") / max(1, n - 1)
    angle = 2 * math.pi * 2 * t
    return spark.range(n).select("id", t.alias("t"), F.array((0.2 + t) * F.cos(angle) + noise * normal(seed), (0.2 + t) * F.sin(angle) + noise * normal(seed + 2), 0.3 * t).alias("x"))


def mountains(spark: SparkSession, columns: int = 60, rows: int = 40, height: float = 4.0) -> DataFrame:
    """(id, x): a grid under the sum of three bumps."""
    a, b = (F.col("id") % columns) / (columns - 1.0) * 12, F.floor(F.col("id") / columns) / (rows - 1.0) * 8
    bump = lambda cx, cy: height * F.exp(-((a - cx) * (a - cx) + (b - cy) * (b - cy)) / 2)
    return spark.range(columns * rows).select("id", F.array(a, b, bump(3, 2) + bump(9, 2.5) + bump(6, 6)).alias("x"))


def nested_rectangles(spark: SparkSession, per_unit: int = 7, levels: int = 3) -> DataFrame:
    """(id, x, grp): outlines of rectangles within each other, each higher than the one around it."""
    rows = []
    for g in range(levels):
        w, h = 2.0 * (levels - g), 1.0 * (levels - g)
        corners = [(-w, -h), (w, -h), (w, h), (-w, h)]
        for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1], strict=True):
            n = max(1, round(per_unit * math.dist((x0, y0), (x1, y1))))
            rows += [(x0 + (x1 - x0) * i / n, y0 + (y1 - y0) * i / n, float(g), g) for i in range(n)]
    return spark.createDataFrame([(i, list(r[:3]), r[3]) for i, r in enumerate(rows)], "id long, x array<double>, grp int")


def parallel_bridges(spark: SparkSession, rail: int = 61, bridge: int = 8, bridges: int = 3) -> DataFrame:
    """(id, x, w): two rails with opposite currents, joined by bridges without one."""
    rows = [(6.0 * i / (rail - 1), y, c) for y, c in ((0.0, 1.0), (2.0, -1.0)) for i in range(rail)]
    rows += [(6.0 * b / (bridges - 1), 2.0 * (i + 1) / (bridge + 1), 0.0) for b in range(bridges) for i in range(bridge)]
    return spark.createDataFrame([(i, [x, y], [c, 0.0]) for i, (x, y, c) in enumerate(rows)], "id long, x array<double>, w array<double>")


def branching_segments(branches: int = 8, twigs: int = 4, length: float = 3.0) -> list[tuple[float, float, float, float, int]]:
    """(x0, y0, x1, y1, branch): branches from the origin, each with twigs to alternating sides."""
    out = []
    for b in range(branches):
        angle = 2 * math.pi * b / branches
        ex, ey = length * math.cos(angle), length * math.sin(angle)
        out.append((0.0, 0.0, ex, ey, b))
        for k in range(twigs):
            share, side = (k + 1) / (twigs + 1), 1 if k % 2 else -1
            sx, sy, a = ex * share, ey * share, angle + side * math.pi / 5
            out.append((sx, sy, sx + 0.3 * length * math.cos(a), sy + 0.3 * length * math.sin(a), b))
    return out


def branching_tree(spark: SparkSession, n: int = 1000, corridor: float = 0.11, seed: int = 42) -> DataFrame:
    """(id, x, branch): points along segments by their lengths, within a corridor."""
    segments = branching_segments()
    total = [0.0]
    for s in segments:
        total.append(total[-1] + math.dist(s[:2], s[2:4]))
    table = spark.createDataFrame([(*s[:4], s[4], total[i] / total[-1], total[i + 1] / total[-1]) for i, s in enumerate(segments)], "x0 double, y0 double, x1 double, y1 double, branch int, lo double, hi double")
    p = spark.range(n).select("id", uniform(seed).alias("u"), uniform(seed + 1).alias("t"), (corridor * (2 * uniform(seed + 2) - 1)).alias("off"))
    p = p.join(F.broadcast(table), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    size = F.sqrt(dx * dx + dy * dy)
    return p.select("id", F.array(F.col("x0") + F.col("t") * dx - F.col("off") * dy / size, F.col("y0") + F.col("t") * dy + F.col("off") * dx / size).alias("x"), "branch")


def current_distances(points: DataFrame, k: int = 10, support: DataFrame | None = None) -> DataFrame:
    """(src, dst, d): all shortest paths where an edge u takes |u| + w.u, on the neighbour graph or a given support."""
    from anisomap.operators.graph import field_edges, knn_edges, nearest_neighbors
    from anisomap.operators.paths import shortest_paths

    support = knn_edges(nearest_neighbors(points.select("id", "x"), k)) if support is None else support
    return shortest_paths(field_edges(points.select("id", "x"), points.select("id", "w"), support)).select("src", "dst", F.col("dist").alias("d"))
