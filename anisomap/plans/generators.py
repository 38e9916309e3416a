"""Queries of synthetic data sets and ways on them, and what they are in SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from anisomap.functions import vectors as V
from anisomap.operators import graph as G
from anisomap.plans.inputs import sql
from anisomap.session import ship
from anisomap.sources import synthetic as X

R = V.rounded
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = lambda s, d: f(ship(s))
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


def _coordinates(df, n: int, *more: str):
    return df.select("id", *[R(F.get("x", F.lit(i))).alias(f"x{i}") for i in range(n)], *more)


def _field(df):
    return _coordinates(df, 2, *[R(F.get("w", F.lit(i))).alias(f"w{i}") for i in range(2)])


def _uniform(name: str, seed: int) -> str:
    """Columns that end with ``name``: the hash of ``id`` step by step."""
    out, last = [f"(id + {seed * 7919}) % 2147483648 AS {name}_0"], f"{name}_0"
    for i, (factor, bits) in enumerate(X.MIX, 1):
        out.append(f"({last} * {factor} + 12345) % 2147483648 AS {name}_{i}m")
        out.append(f"xor({name}_{i}m, {name}_{i}m >> {bits}) AS {name}_{i}")
        last = f"{name}_{i}"
    return ", ".join([*out, f"{last} / 2147483648.0::DOUBLE AS {name}"])


def _rows(n: int, **seeds: int) -> str:
    """``r``: ids below n with a uniform number for each seed."""
    return f"r AS (SELECT id, {', '.join(_uniform(k, v) for k, v in seeds.items())} FROM (SELECT unnest(range({n}))::BIGINT AS id))"


_OUT = "round({0}, 6) + 0.0 AS {1}"


def _select(**columns: str) -> str:
    return ", ".join(_OUT.format(v, k) for k, v in columns.items())


@query("sea_points", sql(_rows(2000, a=0, b=7), "p AS (SELECT id, 10 * a AS x, 10 * b AS y FROM r)", "f AS (SELECT *, sin(2 * x) + cos(2 * y) AS u, cos(2 * x) - sin(2 * y) AS v FROM p)",
    body=f"SELECT id, {_select(x0='x', x1='y', w0='0.8 * u / max(sqrt(u * u + v * v)) OVER ()', w1='0.8 * v / max(sqrt(u * u + v * v)) OVER ()')} FROM f"))
def sea_points(s):
    return _field(X.vortical_sea(s))


@query("river_points", sql(_rows(200, a=0, b=3), "f AS (SELECT *, 1 - abs(2 * b - 1) AS u FROM r)", body=f"SELECT id, {_select(x0='10 * a', x1='b', w0='0.2 * u / max(u) OVER ()', w1='0.0')} FROM f"))
def river_points(s):
    return _field(X.river(s))


@query("swiss_roll_points", sql(_rows(1000, a=0, b=11), "f AS (SELECT id, a, b, 1.5 * pi() * (1 + 2 * a) AS t FROM r)", "g AS (SELECT *, cos(t) - t * sin(t) AS tx, sin(t) + t * cos(t) AS tz FROM f)",
    body=f"SELECT id, {_select(x0='t * cos(t)', x1='21 * b', x2='t * sin(t)', w0='0.35 * tx / sqrt(tx * tx + tz * tz)', w1='0.0', w2='0.35 * tz / sqrt(tx * tx + tz * tz)')}, a BETWEEN 0.1 AND 0.9 AND b BETWEEN 0.4 AND 0.6 AS in_hole FROM g"))
def swiss_roll_points(s):
    got = X.swiss_roll(s, hole=(0.1, 0.9, 0.4, 0.6))
    return _coordinates(got, 3, *[R(F.get("w", F.lit(i))).alias(f"w{i}") for i in range(3)], "in_hole")


_NORMAL = "sqrt(-2 * ln(1 - {0})) * cos(2 * pi() * {1})"


@query("spiral_points", sql(_rows(1000, a=0, b=1, c=2, e=3), "f AS (SELECT *, 1.1 * id / 999 AS t FROM r)",
    body=f"SELECT id, {_select(t='t', x0='(0.2 + t) * cos(4 * pi() * t) + 0.015 * ' + _NORMAL.format('a', 'b'), x1='(0.2 + t) * sin(4 * pi() * t) + 0.015 * ' + _NORMAL.format('c', 'e'), x2='0.3 * t')} FROM f"))
def spiral_points(s):
    return _coordinates(X.spiral(s), 3, R("t").alias("t"))


_BUMP = "4 * exp(-((a - {0}) * (a - {0}) + (b - {1}) * (b - {1})) / 2)"


@query("mountain_points", sql("f AS (SELECT id, (id % 60) / 59.0::DOUBLE * 12 AS a, (id // 60) / 39.0::DOUBLE * 8 AS b FROM (SELECT unnest(range(2400))::BIGINT AS id))",
    body=f"SELECT id, {_select(x0='a', x1='b', x2=' + '.join(_BUMP.format(*c) for c in ((3, 2), (9, 2.5), (6, 6))))} FROM f"))
def mountain_points(s):
    return _coordinates(X.mountains(s), 3)


@query("rectangle_points", sql("g AS (SELECT unnest(range(3))::INTEGER AS grp)", "c AS (SELECT grp, unnest([0, 1, 2, 3]) AS side, 2.0::DOUBLE * (3 - grp) AS w, 1.0::DOUBLE * (3 - grp) AS h FROM g)",
    "n AS (SELECT *, round(7 * CASE WHEN side % 2 = 0 THEN 2 * w ELSE 2 * h END)::BIGINT AS n FROM c)", "p AS (SELECT *, unnest(range(n)) AS i FROM n)",
    "q AS (SELECT grp, side, i, CASE side WHEN 0 THEN -w + 2 * w * i / n WHEN 1 THEN w WHEN 2 THEN w - 2 * w * i / n ELSE -w END AS x, CASE side WHEN 0 THEN -h WHEN 1 THEN -h + 2 * h * i / n WHEN 2 THEN h ELSE h - 2 * h * i / n END AS y FROM p)",
    body=f"SELECT row_number() OVER (ORDER BY grp, side, i) - 1 AS id, {_select(x0='x', x1='y', x2='grp::DOUBLE')}, grp FROM q"))
def rectangle_points(s):
    return _coordinates(X.nested_rectangles(s), 3, "grp")


@query("bridge_points", sql("a AS (SELECT rail, i, rail * 61 + i AS id FROM (SELECT unnest([0, 1]) AS rail), (SELECT unnest(range(61)) AS i))", "b AS (SELECT br, i, 122 + br * 8 + i AS id FROM (SELECT unnest([0, 1, 2]) AS br), (SELECT unnest(range(8)) AS i))",
    body=f"SELECT id::BIGINT AS id, {_select(x0='6.0::DOUBLE * i / 60', x1='2.0::DOUBLE * rail', w0='1.0::DOUBLE - 2 * rail', w1='0.0')} FROM a UNION ALL SELECT id, {_select(x0='3.0::DOUBLE * br', x1='2.0::DOUBLE * (i + 1) / 9', w0='0.0', w1='0.0')} FROM b"))
def bridge_points(s):
    return _field(X.parallel_bridges(s))


def _tree_sql() -> str:
    segments = X.branching_segments()
    total = [0.0]
    for g in segments:
        total.append(total[-1] + math.dist(g[:2], g[2:4]))
    rows = ", ".join(f"({g[0]!r}, {g[1]!r}, {g[2]!r}, {g[3]!r}, {g[4]}, {total[i] / total[-1]!r}, {total[i + 1] / total[-1]!r})" for i, g in enumerate(segments))
    return sql(_rows(1000, u=42, t=43, o=44), f"sg AS (SELECT x0::DOUBLE AS x0, y0::DOUBLE AS y0, x1::DOUBLE AS x1, y1::DOUBLE AS y1, branch, lo::DOUBLE AS lo, hi::DOUBLE AS hi FROM (VALUES {rows}) v(x0, y0, x1, y1, branch, lo, hi))",
        "p AS (SELECT id, branch, x0, y0, x1 - x0 AS dx, y1 - y0 AS dy, t, 0.11 * (2 * o - 1) AS off FROM r JOIN sg ON u >= lo AND u < hi)", "q AS (SELECT *, sqrt(dx * dx + dy * dy) AS n FROM p)",
        body=f"SELECT id, {_select(x0='x0 + t * dx - off * dy / n', x1='y0 + t * dy + off * dx / n')}, branch::INTEGER AS branch FROM q")


@query("branching_points", _tree_sql())
def branching_points(s):
    return _coordinates(X.branching_tree(s), 2, "branch")


def _bumps(rows, x: str = "x", y: str = "y") -> str:
    return " + ".join(f"({h}) * exp(-0.5 * (pow(({x} - {cx}) / {sx}, 2) + pow(({y} - {cy}) / {sy}, 2)))" for cx, cy, sx, sy, h in rows)


def _islands_sql() -> str:
    n, width, height = 400, 12.0, 6.0
    columns = math.ceil(math.sqrt(2.0 * n * width / height))
    rows = math.ceil(math.ceil(2.0 * n) / columns)
    size = math.hypot(*X.BASE_CURRENT)
    bx, by = (c / size for c in X.BASE_CURRENT)
    island = ", ".join(f"({i}, {o['cx']}, {o['cy']}, {o['rx']}, {o['ry']}, radians({o['angle_deg']}))" for i, o in enumerate(X.ISLANDS))
    return sql(
        _rows(columns * rows, a=0, b=5, h=9), f"ob AS (SELECT * FROM (VALUES {island}) v(k, cx, cy, rx, ry, g))",
        f"c AS (SELECT id, h, (id % {columns} + a) * {width / columns!r} AS x, (id // {columns} + b) * {height / rows!r} AS y FROM r)",
        "l AS (SELECT id, h, x, y, k, rx, ry, g, (x - cx) * cos(g) + (y - cy) * sin(g) AS p, (y - cy) * cos(g) - (x - cx) * sin(g) AS q FROM c, ob)", "m AS (SELECT *, pow(p / rx, 2) + pow(q / ry, 2) AS lev, 2 * p / (rx * rx) AS gp, 2 * q / (ry * ry) AS gq FROM l)",
        f"w AS (SELECT id, any_value(x) AS x, any_value(y) AS y, min(lev) AS lev FROM m GROUP BY id HAVING min(lev) > 1 ORDER BY any_value(h), id LIMIT {n})",
        "o AS (SELECT id, arg_min(greatest(sqrt(lev) - 1, 0), (greatest(sqrt(lev) - 1, 0), k)) AS far, arg_min((gp * cos(g) - gq * sin(g)) / sqrt(gp * gp + gq * gq), (greatest(sqrt(lev) - 1, 0), k)) AS nx, arg_min((gp * sin(g) + gq * cos(g)) / sqrt(gp * gp + gq * gq), (greatest(sqrt(lev) - 1, 0), k)) AS ny FROM m GROUP BY id)",
        f"f AS (SELECT w.id, x, y, nx, ny, exp(-pow(far / 0.7, 2)) AS wt, {bx!r} + 0.10 * sin(0.8 * y - 0.25 * x) AS e, {by!r} + 0.18 * sin(0.65 * x + 1.15 * y) + 0.12 * sin(1.4 * y) + {_bumps(X.LATERAL_BUMPS)} AS n FROM w JOIN o USING (id))",
        f"g AS (SELECT *, e * nx + n * ny AS ac, CASE WHEN -ny * {bx!r} + nx * {by!r} < 0 THEN -1 ELSE 1 END AS sd FROM f)",
        f"t AS (SELECT *, e - wt * ac * nx + 0.16 * wt * sd * -ny + 0.1 * (1 - wt) * {bx!r} AS te, n - wt * ac * ny + 0.16 * wt * sd * nx + 0.1 * (1 - wt) * {by!r} AS tn FROM g)",
        f"u AS (SELECT *, sqrt(te * te + tn * tn) AS r, greatest(0.38, least(0.98, 0.78 + 0.12 * (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) + {_bumps(X.SPEED_BUMPS)})) AS sp FROM t)",
        body=f"SELECT id, {_select(x0='x', x1='y', w0='-0.8 * sp * te / r', w1='-0.8 * sp * tn / r')} FROM u",
    )


@query("archipelago_points", _islands_sql())
def archipelago_points(s):
    return _field(X.archipelago(s, 400))


#: The river's neighbours, edges and shortest ways between all points.
_RIVER = f"""f AS (SELECT id, 10 * a AS x, b AS y, 1 - abs(2 * b - 1) AS u FROM r), p AS (SELECT id, x, y, 0.2 * u / max(u) OVER () AS w FROM f),
k AS (SELECT src, dst, d FROM (SELECT a.id AS src, b.id AS dst, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS d, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)), b.id) AS q FROM p a JOIN p b ON a.id <> b.id) WHERE q <= 10),
y AS (SELECT src, dst, max(d) AS d FROM (SELECT * FROM k UNION ALL SELECT dst, src, d FROM k) GROUP BY 1, 2), g AS MATERIALIZED (SELECT y.src, y.dst, y.d + a.w * (b.x - a.x) AS d FROM y JOIN p a ON a.id = y.src JOIN p b ON b.id = y.dst),
bf(h, src, v, dist) AS (SELECT 0, id, id, 0.0::DOUBLE FROM p UNION ALL SELECT h + 1, src, v, min(dist) FROM (SELECT h, src, v, dist FROM bf UNION ALL SELECT bf.h, bf.src, g.dst, bf.dist + g.d FROM bf JOIN g ON bf.v = g.src) WHERE h < 60 GROUP BY h, src, v)"""


@query("river_distances", sql(_rows(200, a=0, b=3), _RIVER, body="SELECT src, v AS dst, round(dist, 6) + 0.0 AS d FROM bf WHERE h = 60", recursive=True))
def river_distances(s):
    return X.current_distances(X.river(s)).select("src", "dst", R("d").alias("d"))


@query("archipelago_distances")
def archipelago_distances(s):
    """Ways between all points of the archipelago that pass its islands."""
    p = X.archipelago(s, 200)
    return X.current_distances(p, support=X.archipelago_graph(p, 4)).select("src", "dst", R("d").alias("d"))


@query("corridor_distances")
def corridor_distances(s):
    """Ways between all points of the branching tree that stay in its corridors."""
    from anisomap.operators.paths import shortest_paths

    p = X.branching_tree(s, 400).select("id", "x")
    g = G.corridor_graph(p, [c[:4] for c in X.branching_segments()], 0.16, k=8)
    return shortest_paths(g).select("src", "dst", R("dist").alias("d"))
