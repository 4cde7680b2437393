"""Queries on paths, grids, points, polygons, meshes and element sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import stats as A
from ..operators import grid, kernels, lattice, mesh, path, sets, spatial
from . import views as V
from .wells import BUNDLE_SQL, rounded

QUERIES: dict = {}
ORACLES: dict = {}
CELL = 625.0
GEOMETRY = {"xori": 1000.0, "yori": 2000.0, "xinc": 25.0, "yinc": 25.0, "ncol": 50, "nrow": 25, "rotation_deg": 30.0, "yflip": False}
#: Geometry that covers the scattered points.
WIDE = {"xori": -100.0, "yori": -100.0, "xinc": 20.0, "yinc": 20.0, "ncol": 12, "nrow": 10, "rotation_deg": 0.0, "yflip": False}
#: An L-shape and a square, in point units.
RINGS = {1: [(0, 0), (150, 0), (150, 60), (60, 60), (60, 150), (0, 150)], 2: [(-150, -150), (-20, -150), (-20, -20), (-150, -20)]}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rings(spark):
    rows = [(p, k, float(x), float(y)) for p, ring in RINGS.items() for k, (x, y) in enumerate(ring)]
    return spark.createDataFrame(rows, "poly_id int, vseq int, x double, y double")


RINGS_SQL = "ring(poly_id, vseq, x, y) AS (VALUES " + ", ".join(f"({p}, {k}, {x}::DOUBLE, {y}::DOUBLE)" for p, ring in RINGS.items() for k, (x, y) in enumerate(ring)) + """),
 edge AS (SELECT poly_id, x AS x1, y AS y1, coalesce(lead(x) OVER w, first(x) OVER w0) AS x2, coalesce(lead(y) OVER w, first(y) OVER w0) AS y2 FROM ring WINDOW w AS (PARTITION BY poly_id ORDER BY vseq), w0 AS (PARTITION BY poly_id ORDER BY vseq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""

def drawn(spark, d):
    """Rings through the scattered points, 40 of them, in order of their ids."""
    return V.point(spark, d).select((F.col("point_id") % 40).cast("int").alias("poly_id"), F.col("point_id").alias("vseq"), "x", "y")


DRAWN_SQL = V.with_("point", """ring AS (SELECT (point_id % 40)::INT AS poly_id, point_id AS vseq, x, y FROM point),
 edge AS (SELECT poly_id, x AS x1, y AS y1, coalesce(lead(x) OVER w, first(x) OVER w0) AS x2, coalesce(lead(y) OVER w, first(y) OVER w0) AS y2 FROM ring WINDOW w AS (PARTITION BY poly_id ORDER BY vseq), w0 AS (PARTITION BY poly_id ORDER BY vseq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))""")

_PATH_SQL = f"""{V.with_('survey')}, t AS (SELECT *, sin(radians(inc)) * cos(radians(azi)) AS tn, sin(radians(inc)) * sin(radians(azi)) AS te, cos(radians(inc)) AS td FROM survey),
 l AS (SELECT *, lag(md) OVER w AS pmd, lag(tn) OVER w AS pn, lag(te) OVER w AS pe, lag(td) OVER w AS pd FROM t WINDOW w AS (PARTITION BY bore_id ORDER BY md)),
 b AS (SELECT *, acos(least(greatest(tn * pn + te * pe + td * pd, -1.0), 1.0)) AS beta FROM l),
 h AS (SELECT *, (md - pmd) / 2 * CASE WHEN beta < 1e-4 THEN 1 + beta * beta / 12 ELSE 2 / beta * tan(beta / 2) END AS half FROM b),
 path AS (SELECT bore_id, md, 1000 + coalesce(sum(half * (pe + te)) OVER w, 0) AS x, 2000 + coalesce(sum(half * (pn + tn)) OVER w, 0) AS y, -(0 - 27.3) - coalesce(sum(half * (pd + td)) OVER w, 0) AS z, tn, te, td FROM h WINDOW w AS (PARTITION BY bore_id ORDER BY md ROWS UNBOUNDED PRECEDING))"""


def well_path(spark, d):
    return path.positions(V.survey(spark, d), 1000.0, 2000.0, 27.3)


@register("min_curvature", f"{_PATH_SQL} SELECT bore_id, round(md, 6) AS md, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z, round(tn, 6) AS tn, round(te, 6) AS te, round(td, 6) AS td FROM path")
def _(spark, d):
    return rounded(well_path(spark, d), x=5, y=5, z=5).select("bore_id", "md", "x", "y", "z", *((F.col(c) + 0.0).alias(c) for c in ("tn", "te", "td")))


_AT_SQL = f"""{_PATH_SQL}, seg AS (SELECT bore_id, md AS m0, x AS x0, y AS y0, z AS z0, tn AS n0, te AS e0, td AS d0, lead(md) OVER w AS m1, lead(tn) OVER w AS n1, lead(te) OVER w AS e1, lead(td) OVER w AS d1 FROM path WINDOW w AS (PARTITION BY bore_id ORDER BY md)),
 tg AS (SELECT DISTINCT bore_id, unnest([33.0, 150.0, 275.5])::DOUBLE AS md FROM survey),
 k AS (SELECT tg.bore_id, tg.md, seg.*, (tg.md - m0) / (m1 - m0) AS f, acos(least(greatest(n0 * n1 + e0 * e1 + d0 * d1, -1.0), 1.0)) AS beta FROM tg JOIN seg ON tg.bore_id = seg.bore_id AND tg.md >= m0 AND tg.md < m1),
 g AS (SELECT *, sin((1 - f) * beta) / sin(beta) AS wa, sin(f * beta) / sin(beta) AS wb, (md - m0) / 2 * CASE WHEN f * beta < 1e-4 THEN 1 + (f * beta) ** 2 / 12 ELSE 2 / (f * beta) * tan(f * beta / 2) END AS hf FROM k)"""


@register("position_at", f"{_AT_SQL} SELECT bore_id, round(md, 6) AS md, round(x0 + hf * (e0 + wa * e0 + wb * e1), 5) AS x, round(y0 + hf * (n0 + wa * n0 + wb * n1), 5) AS y, round(z0 - hf * (d0 + wa * d0 + wb * d1), 5) AS z FROM g")
def _(spark, d):
    to = V.survey(spark, d).select("bore_id").distinct().select("bore_id", F.explode(F.array(*(F.lit(x) for x in (33.0, 150.0, 275.5)))).alias("md"))
    return rounded(path.position_at(well_path(spark, d), to), x=5, y=5, z=5)


@register(
    "md_at_tvd",
    f"""{_PATH_SQL}, seg AS (SELECT bore_id, md AS m0, -z AS t0, lead(md) OVER w AS m1, -lead(z) OVER w AS t1 FROM path WINDOW w AS (PARTITION BY bore_id ORDER BY md)), tg AS (SELECT DISTINCT bore_id, unnest([50.0, 200.0, 330.0])::DOUBLE AS tvd FROM survey)
 SELECT bore_id, tvd, round(min(CASE WHEN t1 = t0 THEN m0 ELSE m0 + (m1 - m0) * (tvd - t0) / (t1 - t0) END), 5) AS md FROM tg JOIN seg USING (bore_id) WHERE m1 IS NOT NULL AND tvd BETWEEN least(t0, t1) AND greatest(t0, t1) GROUP BY 1, 2""",
)
def _(spark, d):
    to = V.survey(spark, d).select("bore_id").distinct().select("bore_id", F.explode(F.array(*(F.lit(x) for x in (50.0, 200.0, 330.0)))).alias("tvd"))
    return rounded(path.md_at_tvd(well_path(spark, d), to), md=5)


@register("chord_md", f"""{V.with_('point')}, s AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2), 0) AS step FROM point WINDOW w AS (PARTITION BY point_id % 7 ORDER BY point_id)) SELECT point_id, round(sum(step) OVER (PARTITION BY point_id % 7 ORDER BY point_id ROWS UNBOUNDED PRECEDING), 4) AS md FROM s""")
def _(spark, d):
    nodes = V.point(spark, d).withColumn("bore_id", F.col("point_id") % 7)
    return rounded(path.chord_md(nodes, order="point_id").select("point_id", "md"), md=4)


def _other(spark, d):
    return V.node(spark, d).select("i", "j", F.when((F.col("i") + F.col("j")) % 4 != 0, F.col("z") * 0.9 + F.col("i")).alias("z"))


_OTHER = "o AS (SELECT i, j, CASE WHEN (i + j) % 4 <> 0 THEN z * 0.9 + i END AS z FROM node)"
for _op, _expr in (("plus", "a.z + o.z"), ("minus", "a.z - o.z"), ("times", "a.z * o.z"), ("divided_by", "a.z / nullif(o.z, 0)")):

    def _make(op):
        return lambda spark, d: rounded(grid.combine(V.node(spark, d), _other(spark, d), op), z=7)

    register(f"surface_{_op}", f"{V.with_('node', _OTHER)} SELECT a.i, a.j, round({_expr}, 7) AS z FROM node a JOIN o ON a.i = o.i AND a.j = o.j")(_make(_op))


@register("surface_thickness", f"{V.with_('node', _OTHER)} SELECT a.i, a.j, CASE WHEN o.z IS NOT NULL THEN round(greatest(o.z - a.z, 0), 6) END AS z FROM node a JOIN o ON a.i = o.i AND a.j = o.j")
def _(spark, d):
    return rounded(grid.thickness(V.node(spark, d), _other(spark, d)))


@register("surface_stats", f"{V.with_('node')} SELECT {BUNDLE_SQL.replace('(v', '(z')} FROM node")
def _(spark, d):
    return rounded(A.spread(V.node(spark, d), [], "z"), sum=4)


@register("surface_area", f"{V.with_('node')} SELECT count(CASE WHEN z <= 950 THEN 1 END) * 625.0::DOUBLE AS below, count(CASE WHEN z >= 950 THEN 1 END) * 625.0::DOUBLE AS above FROM node")
def _(spark, d):
    return grid.areas(V.node(spark, d), 950.0, CELL)


@register("surface_volume", f"{V.with_('node', _OTHER)} SELECT round(sum(abs(a.z - o.z)) * 625.0, 0) AS volume FROM node a JOIN o ON a.i = o.i AND a.j = o.j")
def _(spark, d):
    return rounded(grid.volume_between(V.node(spark, d), _other(spark, d), CELL), volume=0)


@register("hypsometry", f"{V.with_('node')} SELECT i, j, round(z, 6) AS z, row_number() OVER (ORDER BY z, i, j) * 625.0::DOUBLE AS area FROM node")
def _(spark, d):
    return rounded(grid.hypsometry(V.node(spark, d), CELL))


@register("surface_smooth", f"{V.with_('node')} SELECT a.i, a.j, round(avg(b.z), 8) AS z FROM node a JOIN node b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY 1, 2")
def _(spark, d):
    return rounded(grid.smooth(V.node(spark, d), 1), z=8)


@register("node_xy", f"{V.with_('node')} SELECT i, j, round(1000 + i * 25.0 * cos(radians(30.0)) - j * 25.0 * sin(radians(30.0)), 5) AS x, round(2000 + i * 25.0 * sin(radians(30.0)) + j * 25.0 * cos(radians(30.0)), 5) AS y FROM node")
def _(spark, d):
    x, y = S.node_xy(F.col("i"), F.col("j"), GEOMETRY)
    return rounded(V.node(spark, d).select("i", "j", x.alias("x"), y.alias("y")), x=5, y=5)


@register("xy_to_ij", f"{V.with_('point')} SELECT point_id, round(((x - 1000) * cos(radians(30.0)) + (y - 2000) * sin(radians(30.0))) / 25, 5) AS i, round(((y - 2000) * cos(radians(30.0)) - (x - 1000) * sin(radians(30.0))) / 25, 5) AS j FROM point")
def _(spark, d):
    i, j = S.xy_to_ij(F.col("x"), F.col("y"), GEOMETRY)
    return rounded(V.point(spark, d).select("point_id", i.alias("i"), j.alias("j")), i=5, j=5)


_FLAT = GEOMETRY | {"xori": -600.0, "yori": -300.0, "rotation_deg": 0.0}


@register(
    "surface_sample",
    f"""{V.with_('node', 'point')}, f AS (SELECT point_id, (x + 600) / 25 AS fi, (y + 300) / 25 AS fj FROM point), p AS (SELECT *, least(floor(fi), 48)::INT AS i0, least(floor(fj), 23)::INT AS j0 FROM f WHERE fi BETWEEN 0 AND 49 AND fj BETWEEN 0 AND 24),
 c AS (SELECT p.point_id, n.z, CASE WHEN a = 1 THEN fi - i0 ELSE 1 - (fi - i0) END * CASE WHEN b = 1 THEN fj - j0 ELSE 1 - (fj - j0) END AS w, ((fi - i0 >= 0.5)::INT = a AND (fj - j0 >= 0.5)::INT = b) AS near
   FROM p, (VALUES (0,0),(0,1),(1,0),(1,1)) q(a, b) LEFT JOIN node n ON n.i = i0 + a AND n.j = j0 + b),
 s AS (SELECT point_id, CASE WHEN max(CASE WHEN near THEN z END) IS NOT NULL THEN sum(w * z) / nullif(sum(CASE WHEN z IS NOT NULL THEN w END), 0) END AS z FROM c GROUP BY 1) SELECT point.point_id, round(s.z, 5) AS z FROM point LEFT JOIN s USING (point_id)""",
)
def _(spark, d):
    return rounded(grid.sample(V.node(spark, d), V.point(spark, d), _FLAT), z=5)


@register(
    "nearest_point",
    f"""{V.with_('point')}, q AS (SELECT point_id AS query_id, x + 7 AS qx, y - 3 AS qy FROM point WHERE point_id % 100 = 0), p AS (SELECT * FROM point),
 r AS (SELECT query_id, point_id, sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy)) AS d FROM q, p) SELECT query_id, arg_min(point_id, d) AS point_id, round(min(d), 6) AS distance FROM r GROUP BY 1""",
)
def _(spark, d):
    p = V.point(spark, d)
    q = p.where("point_id % 100 = 0").select(F.col("point_id").alias("query_id"), (F.col("x") + 7).alias("x"), (F.col("y") - 3).alias("y"))
    return rounded(spatial.nearest(p, q, 40.0))


@register("idw_grid", f"""{V.with_('point')}, t AS (SELECT k % 12 AS i, k // 12 AS j, -100.0 + (k % 12) * 20.0 AS x, -100.0 + (k // 12) * 20.0 AS y FROM (SELECT unnest(range(0, 120)) AS k))
 SELECT i::INT AS i, j::INT AS j, round(sum(point.z / ((t.x - point.x) ** 2 + (t.y - point.y) ** 2)) / sum(1 / ((t.x - point.x) ** 2 + (t.y - point.y) ** 2)), 4) AS z FROM t, point GROUP BY 1, 2""")
def _(spark, d):
    return rounded(spatial.idw(V.point(spark, d), grid.nodes(WIDE, spark), ["i", "j"]), z=4)


@register(
    "points_in_polygons",
    f"""{V.with_('point', RINGS_SQL)} SELECT DISTINCT point_id FROM (SELECT point_id, poly_id, sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1 THEN 1 ELSE 0 END) AS n FROM point, edge GROUP BY 1, 2) WHERE n % 2 = 1""",
)
def _(spark, d):
    return spatial.inside(V.point(spark, d), rings(spark))


@register("polygon_area", f"{DRAWN_SQL} SELECT poly_id, round(abs(sum(x1 * y2 - x2 * y1)) / 2, 6) AS area FROM edge GROUP BY 1")
def _(spark, d):
    return rounded(spatial.polygon_area(drawn(spark, d)))


@register("points_bbox", f"{V.with_('point')} SELECT round(min(x), 6) AS xmin, round(min(y), 6) AS ymin, round(max(x), 6) AS xmax, round(max(y), 6) AS ymax FROM point")
def _(spark, d):
    return rounded(spatial.bbox(V.point(spark, d)))


@register(
    "convex_hull",
    f"""{V.with_('point')}, e AS (SELECT a.x, a.y FROM point a JOIN point b ON a.point_id <> b.point_id WHERE NOT EXISTS (SELECT 1 FROM point c WHERE (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0)),
 r AS (SELECT x, y, row_number() OVER (ORDER BY atan2(y - (SELECT avg(y) FROM e), x - (SELECT avg(x) FROM e))) - 1 AS k, count(*) OVER () AS n FROM e)
 SELECT ((k - (SELECT arg_min(k, x) FROM r) + n) % n)::INT AS vseq, round(x, 6) AS x, round(y, 6) AS y FROM r""",
)
def _(spark, d):
    return rounded(spatial.hull(V.point(spark, d)))


_QUAD = """q AS (SELECT a.i AS ci, a.j AS cj, a.z AS z00, b.z AS z10, c.z AS z11, e.z AS z01 FROM node a JOIN node b ON b.i = a.i + 1 AND b.j = a.j JOIN node c ON c.i = a.i + 1 AND c.j = a.j + 1 JOIN node e ON e.i = a.i AND e.j = a.j + 1),
 tri AS (SELECT ci, cj, 0 AS half, ci AS ai, cj AS aj, z00 AS az, ci + 1 AS bi, cj AS bj, z10 AS bz, ci + 1 AS ki, cj + 1 AS kj, z11 AS kz FROM q UNION ALL SELECT ci, cj, 1, ci, cj, z00, ci + 1, cj + 1, z11, ci, cj + 1, z01 FROM q),
 edges AS (SELECT least(u, v) AS u, greatest(u, v) AS v, count(*) AS n FROM (SELECT unnest([[ai * 1000 + aj, bi * 1000 + bj], [bi * 1000 + bj, ki * 1000 + kj], [ki * 1000 + kj, ai * 1000 + aj]]) AS p FROM tri), LATERAL (SELECT p[1] AS u, p[2] AS v) GROUP BY 1, 2)"""


def _edge(df):
    key = lambda c: (F.col(f"{c}.i") * 1000 + F.col(f"{c}.j")).cast("long").alias(c)
    return df.select(key("u"), key("v"), "n")


@register("mesh_triangles", f"{V.with_('node', _QUAD)} SELECT ci, cj, half, ai, bj, kj FROM tri")
def _(spark, d):
    return mesh.quad_split(V.node(spark, d)).select("ci", "cj", "half", F.col("a.i").alias("ai"), F.col("b.j").alias("bj"), F.col("c.j").alias("kj"))


@register("mesh_edges", f"{V.with_('node', _QUAD)} SELECT u::BIGINT AS u, v::BIGINT AS v, n FROM edges")
def _(spark, d):
    return _edge(mesh.edges(mesh.quad_split(V.node(spark, d))))


@register("mesh_wireframe", f"{V.with_('node', _QUAD)} SELECT u::BIGINT AS u, v::BIGINT AS v, n FROM edges WHERE NOT (n = 2 AND u // 1000 <> v // 1000 AND u % 1000 <> v % 1000)")
def _(spark, d):
    return _edge(mesh.wireframe(mesh.quad_split(V.node(spark, d))))


@register("mesh_boundary", f"{V.with_('node', _QUAD)} SELECT u::BIGINT AS u, v::BIGINT AS v, n FROM edges WHERE n = 1")
def _(spark, d):
    return _edge(mesh.boundary(mesh.quad_split(V.node(spark, d))))


@register("mesh_decimated", f"""{V.with_('node')}, n2 AS (SELECT * FROM node WHERE i % 2 = 0 AND j % 2 = 0) SELECT a.i AS ci, a.j AS cj, unnest([0, 1]) AS half FROM n2 a JOIN n2 b ON b.i = a.i + 2 AND b.j = a.j JOIN n2 c ON c.i = a.i + 2 AND c.j = a.j + 2 JOIN n2 e ON e.i = a.i AND e.j = a.j + 2""")
def _(spark, d):
    return mesh.quad_split(V.node(spark, d), 2).select("ci", "cj", "half")


@register(
    "contour_segments",
    f"""{V.with_('node', _QUAD)}, lv(level) AS (VALUES (910.5::DOUBLE), (945.5), (955.5)), x AS (SELECT level, ci, cj, half, [az >= level, bz >= level, kz >= level] AS up, ai, aj, az, bi, bj, bz, ki, kj, kz FROM tri, lv)
 SELECT level, count(*) AS n, round(sum(CASE WHEN up[1] <> up[2] THEN ai + (bi - ai) * (level - az) / (bz - az) ELSE 0 END + CASE WHEN up[2] <> up[3] THEN bi + (ki - bi) * (level - bz) / (kz - bz) ELSE 0 END + CASE WHEN up[3] <> up[1] THEN ki + (ai - ki) * (level - kz) / (az - kz) ELSE 0 END), 4) AS sx
 FROM x WHERE NOT (up[1] = up[2] AND up[2] = up[3]) GROUP BY 1""",
)
def _(spark, d):
    s = mesh.contour_segments(mesh.quad_split(V.node(spark, d)), [910.5, 945.5, 955.5])
    return rounded(s.groupBy("level").agg(F.count("*").alias("n"), F.sum(F.col("x1") + F.col("x2")).alias("sx")), sx=4)


@register("strat_precedence", f"{V.with_('picks')} SELECT a.name AS above, b.name AS below, count(*) AS wells FROM picks a JOIN picks b ON a.well = b.well AND a.md < b.md GROUP BY 1, 2")
def _(spark, d):
    return sets.precedence(V.picks(spark, d))


@register("strat_order")
def _(spark, d):
    names = sets.strat_order(V.picks(spark, d).withColumn("seq", F.col("well")))
    return spark.createDataFrame(list(enumerate(names)), "rank int, name string")


@register("project_merge", "WITH a AS (SELECT c_custkey AS k, 'a' AS side FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT c_custkey AS k, 'b' AS side FROM customer WHERE c_custkey % 3 = 0) SELECT k, coalesce(b.side, a.side) AS side FROM a FULL JOIN b USING (k)")
def _(spark, d):
    c = V.table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return sets.merge(c.where("k % 2 = 0").withColumn("side", F.lit("a")), c.where("k % 3 = 0").withColumn("side", F.lit("b")), ["k"])


@register("distinct_nodes", "SELECT x, y, count(*) AS n, count(DISTINCT z) AS zs FROM (SELECT s_nationkey AS x, s_suppkey % 5 AS y, s_suppkey % 3 AS z FROM supplier) GROUP BY 1, 2")
def _(spark, d):
    s = V.table(spark, d, "supplier").select(F.col("s_nationkey").alias("x"), (F.col("s_suppkey") % 5).alias("y"), (F.col("s_suppkey") % 3).alias("z"))
    return s.groupBy("x", "y").agg(F.count("*").alias("n"), F.countDistinct("z").alias("zs"))


def _indexed(spark, d):
    x, y = S.node_xy(F.col("i"), F.col("j"), GEOMETRY)
    return V.node(spark, d).select((F.col("i") + 1).alias("column"), (F.col("j") + 1).alias("row"), x.alias("x"), y.alias("y"), "z")


@register("infer_geometry", f"{V.with_('node')} SELECT 1000.0::DOUBLE + 25.0 * (min(i) * cos(radians(30.0)) - min(j) * sin(radians(30.0))) AS xori, 2000.0::DOUBLE + 25.0 * (min(i) * sin(radians(30.0)) + min(j) * cos(radians(30.0))) AS yori, 25.0::DOUBLE AS xinc, 25.0::DOUBLE AS yinc, (max(i) - min(i) + 1)::BIGINT AS ncol, (max(j) - min(j) + 1)::BIGINT AS nrow, 30.0::DOUBLE AS rotation_deg, false AS yflip, true AS fits FROM node")
def _(spark, d):
    return rounded(lattice.infer_geometry(_indexed(spark, d)).drop("residual"), xori=4, yori=4, xinc=4, yinc=4, rotation_deg=4)


@register(
    "occupied_edges",
    f"""{V.with_('node', _QUAD)}, s AS (SELECT ci AS i1, cj AS j1, ci + 1 AS i2, cj AS j2 FROM q UNION ALL SELECT ci + 1, cj, ci + 1, cj + 1 FROM q UNION ALL SELECT ci + 1, cj + 1, ci, cj + 1 FROM q UNION ALL SELECT ci, cj + 1, ci, cj FROM q)
 SELECT * FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.i1 = a.i2 AND b.j1 = a.j2 AND b.i2 = a.i1 AND b.j2 = a.j1)""",
)
def _(spark, d):
    return lattice.occupied_edges(V.node(spark, d))


@register("structured_points", f"{V.with_('node')} SELECT i + 1 AS \"column\", j + 1 AS \"row\", round(z, 6) AS z FROM node")
def _(spark, d):
    return rounded(lattice.structured_points(V.node(spark, d)))


@register("duplicate_slots", "SELECT a AS \"column\", b AS \"row\", count(*) AS n FROM (SELECT s_nationkey AS a, s_suppkey % 2 AS b FROM supplier) GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return lattice.duplicate_slots(V.table(spark, d, "supplier").select(F.col("s_nationkey").alias("column"), (F.col("s_suppkey") % 2).alias("row")))


@register("copy_topology", f"{V.with_('node')} SELECT i * 100 + j AS seq, CASE WHEN i % 3 <> 0 THEN i + 1 END AS \"column\", CASE WHEN i % 3 <> 0 THEN j + 1 END AS \"row\" FROM node")
def _(spark, d):
    p = _indexed(spark, d)
    points = p.select(((F.col("column") - 1) * 100 + F.col("row") - 1).alias("seq"), (F.col("x") + 0.0004).alias("x"), "y", "z")
    return lattice.copy_topology(points, p.where("(column - 1) % 3 <> 0")).select("seq", "column", "row")


@register("modal_step", "WITH s AS (SELECT p_retailprice::DOUBLE AS d FROM part), b AS (SELECT floor(d / (1.4 * 1200.0 / 240)) AS b, count(*) AS n, avg(d) AS m FROM s WHERE d > 0 AND d < 1.4 * 1200 GROUP BY 1) SELECT round(m, 6) AS step FROM b ORDER BY n DESC, b DESC LIMIT 1")
def _(spark, d):
    return rounded(lattice.modal_step(V.table(spark, d, "part").select(F.col("p_retailprice").cast("double").alias("d")), 1200.0))


@register("step_azimuth", f"{V.with_('point')} SELECT round(degrees(atan2(sum(sin(4 * atan2(y, x))), sum(cos(4 * atan2(y, x))))) / 4, 5) AS azimuth FROM point")
def _(spark, d):
    return rounded(lattice.azimuth(V.point(spark, d).select(F.col("x").alias("dx"), F.col("y").alias("dy"))), azimuth=5)


@register("ring_area", f"{DRAWN_SQL} SELECT poly_id AS ring, round(sum(x1 * y2 - x2 * y1) / 2, 6) AS area FROM edge GROUP BY 1")
def _(spark, d):
    return rounded(lattice.ring_area(drawn(spark, d).withColumnsRenamed({"poly_id": "ring", "vseq": "seq"})))


@register("contour_lines")
def _(spark, d):
    return kernels.contour_lines(mesh.contour_segments(mesh.quad_split(V.node(spark, d)), [910.5, 955.5]), 0.05)


@register("min_curvature_grid")
def _(spark, d):
    return kernels.min_curvature_grid(V.point(spark, d).withColumn("surface_id", F.col("point_id") % 4), WIDE)


@register(
    "surface_clip",
    f"""{V.with_('node', RINGS_SQL)}, n AS (SELECT i, j, -150.0 + i * 8.0 AS x, -150.0 + j * 13.0 AS y, z FROM node),
 h AS (SELECT DISTINCT i, j FROM (SELECT i, j, poly_id, sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1 THEN 1 ELSE 0 END) AS k,
   max(CASE WHEN (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) = 0 AND x BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2) THEN 1 ELSE 0 END) AS b FROM n, edge GROUP BY 1, 2, 3) WHERE k % 2 = 1 AND b = 0)
 SELECT n.i, n.j, CASE WHEN h.i IS NOT NULL THEN round(z, 6) END AS z FROM n LEFT JOIN h USING (i, j)""",
)
def _(spark, d):
    n = V.node(spark, d).select("i", "j", (F.col("i") * 8.0 - 150.0).alias("x"), (F.col("j") * 13.0 - 150.0).alias("y"), "z")
    return rounded(spatial.clip(n, rings(spark)).select("i", "j", "z"))


@register("mesh_wireframe_stride", f"{V.with_('node', _QUAD)} SELECT u::BIGINT AS u, v::BIGINT AS v, n FROM edges WHERE NOT (n = 2 AND u // 1000 <> v // 1000 AND u % 1000 <> v % 1000) AND (n = 1 OR (u % 1000 = v % 1000 AND (u % 1000) % 3 = 0) OR (u // 1000 = v // 1000 AND (u // 1000) % 3 = 0))")
def _(spark, d):
    return _edge(mesh.wireframe_stride(mesh.quad_split(V.node(spark, d)), 3))


@register(
    "mesh_components",
    f"""{V.with_('node', _QUAD).replace('WITH ', 'WITH RECURSIVE ', 1)}, t AS (SELECT (ci * 1000 + cj) * 2 + half AS tid, ai * 1000 + aj AS a, bi * 1000 + bj AS b, ki * 1000 + kj AS c FROM tri),
 e AS (SELECT a AS u, b AS v FROM t UNION SELECT b, c FROM t UNION SELECT c, a FROM t), s AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
 r(v, root) AS (SELECT u, u FROM s UNION SELECT s.v, r.root FROM r JOIN s ON s.u = r.v WHERE r.root < s.v), m AS (SELECT v, min(root) AS root FROM r GROUP BY v)
 SELECT 0 AS mesh_id, tid::BIGINT AS tid, m.root::BIGINT AS component FROM t JOIN m ON m.v = t.a""",
)
def _(spark, d):
    t = mesh.quad_split(V.node(spark, d))
    vid = lambda c: (F.col(f"{c}.i") * 1000 + F.col(f"{c}.j")).cast("long").alias(c)
    flat = t.select(F.lit(0).alias("mesh_id"), ((F.col("ci") * 1000 + F.col("cj")) * 2 + F.col("half")).cast("long").alias("tid"), vid("a"), vid("b"), vid("c"))
    return mesh.components(flat)


@register("mesh_faults", f"""{V.with_('node', _QUAD)}, t AS (SELECT ai % 3 AS mesh, ai * 1000 + aj AS a, CASE WHEN ai % 7 = 0 THEN ai * 1000 + aj ELSE bi * 1000 + bj END AS b, ki * 1000 + kj AS c FROM tri UNION ALL SELECT ai % 3, ai * 1000 + aj, bi * 1000 + bj, ki * 1000 + kj FROM tri WHERE aj % 5 = 0),
 k AS (SELECT DISTINCT m AS mesh, i * 1000 + j AS v FROM node, (VALUES (0), (1), (2)) q(m) WHERE i % 11 <> 0), x AS (SELECT mesh, unnest([a, b, c]) AS v FROM t), s AS (SELECT mesh, unnest([[a, b], [b, c], [c, a]]) AS p FROM t),
 d AS (SELECT mesh, least(p[1], p[2]) AS u, greatest(p[1], p[2]) AS v, count(*) AS n FROM s WHERE p[1] <> p[2] GROUP BY 1, 2, 3)
 SELECT mesh AS mesh_id, 'unknown vertex' AS kind, count(*) AS n FROM x ANTI JOIN k USING (mesh, v) GROUP BY 1 UNION ALL SELECT mesh, 'repeated vertex', count(*) FROM t WHERE a = b OR b = c OR c = a GROUP BY 1 UNION ALL SELECT mesh, 'edge of more than two', count(*) FROM d WHERE n > 2 GROUP BY 1""")
def _(spark, d):
    n = V.node(spark, d)
    vid = lambda c: F.col(f"{c}.i") * 1000 + F.col(f"{c}.j")
    t = mesh.quad_split(n)
    own = t.select((F.col("a.i") % 3).alias("mesh_id"), vid("a").alias("a"), F.when(F.col("a.i") % 7 == 0, vid("a")).otherwise(vid("b")).alias("b"), vid("c").alias("c"))
    again = t.where("a.j % 5 = 0").select((F.col("a.i") % 3).alias("mesh_id"), vid("a").alias("a"), vid("b").alias("b"), vid("c").alias("c"))
    known = n.where("i % 11 <> 0").select(F.explode(F.array(*(F.lit(m) for m in range(3)))).alias("mesh_id"), (F.col("i") * 1000 + F.col("j")).alias("vid"))
    return mesh.faults(own.union(again), known)


#: A finer geometry over part of the grid.
_FINE = {"xori": 1000.0, "yori": 2010.0, "xinc": 11.0, "yinc": 13.0, "ncol": 60, "nrow": 40, "rotation_deg": 0.0, "yflip": False}


@register(
    "surface_resample",
    f"""{V.with_('node')}, p AS (SELECT k % 60 AS ti, k // 60 AS tj, 1000.0 + (k % 60) * 11.0 - 1000 AS dx, 2010.0 + (k // 60) * 13.0 - 2000 AS dy FROM (SELECT unnest(range(0, 2400)) AS k)),
 f AS (SELECT ti, tj, (dx * cos(radians(30.0)) + dy * sin(radians(30.0))) / 25 AS fi, (dy * cos(radians(30.0)) - dx * sin(radians(30.0))) / 25 AS fj FROM p), q AS (SELECT *, least(floor(fi), 48)::INT AS i0, least(floor(fj), 23)::INT AS j0 FROM f WHERE fi BETWEEN 0 AND 49 AND fj BETWEEN 0 AND 24),
 c AS (SELECT ti, tj, n.z, CASE WHEN a = 1 THEN fi - i0 ELSE 1 - (fi - i0) END * CASE WHEN b = 1 THEN fj - j0 ELSE 1 - (fj - j0) END AS w, ((fi - i0 >= 0.5)::INT = a AND (fj - j0 >= 0.5)::INT = b) AS near FROM q, (VALUES (0,0),(0,1),(1,0),(1,1)) k(a, b) LEFT JOIN node n ON n.i = i0 + a AND n.j = j0 + b),
 s AS (SELECT ti, tj, CASE WHEN max(CASE WHEN near THEN z END) IS NOT NULL THEN sum(w * z) / nullif(sum(CASE WHEN z IS NOT NULL THEN w END), 0) END AS z FROM c GROUP BY 1, 2) SELECT p.ti::INT AS i, p.tj::INT AS j, round(s.z, 5) AS z FROM p LEFT JOIN s USING (ti, tj)""",
)
def _(spark, d):
    return rounded(grid.resample(V.node(spark, d), GEOMETRY, _FINE), z=5)


@register(
    "surface_from_nearest",
    f"""{V.with_('point')}, t AS (SELECT k % 12 AS i, k // 12 AS j, -100.0 + (k % 12) * 20.0 AS x, -100.0 + (k // 12) * 20.0 AS y FROM (SELECT unnest(range(0, 120)) AS k))
 SELECT i::INT AS i, j::INT AS j, round(arg_min(point.z, (t.x - point.x) ** 2 + (t.y - point.y) ** 2), 6) AS z FROM t, point GROUP BY 1, 2""",
)
def _(spark, d):
    return rounded(grid.from_points(V.point(spark, d), WIDE, "nearest"))


@register("polygon_total_area", f"{DRAWN_SQL} SELECT round(sum(a), 6) AS area FROM (SELECT abs(sum(x1 * y2 - x2 * y1)) / 2 AS a FROM edge GROUP BY poly_id)")
def _(spark, d):
    return rounded(spatial.total_area(drawn(spark, d)))


@register("wells_without_top", "WITH u AS (SELECT DISTINCT user_id AS bore_id FROM events) SELECT bore_id FROM u WHERE bore_id % 3 <> 2")
def _(spark, d):
    tops = V.tops(spark, d)
    return sets.anti(tops.select("bore_id").distinct(), tops.where("name = 'C' AND md = 420"), ["bore_id"])
