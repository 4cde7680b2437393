"""Queries on neighbours of points, lattices known by place alone, and meshes in blocks."""

from __future__ import annotations

from math import cos, radians, sin

from pyspark.sql import functions as F

from ..operators import lattice, mesh, spatial
from . import views as V
from .wells import rounded

QUERIES: dict = {}
ORACLES: dict = {}
#: A lattice of 20 by 30 turned by 30 degrees.
COS, SIN, XINC, YINC = cos(radians(30)), sin(radians(30)), 20.0, 30.0


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _turned(spark, d):
    """The nodes of the grid as plain points; places have six decimals."""
    x, y = F.col("i") * XINC * COS - F.col("j") * YINC * SIN, F.col("i") * XINC * SIN + F.col("j") * YINC * COS
    return V.node(spark, d).select((F.col("i") * 1000 + F.col("j")).cast("long").alias("point_id"), F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


_TURNED = f"turned AS (SELECT i * 1000 + j AS point_id, round(i * {XINC}::DOUBLE * {COS!r}::DOUBLE - j * {YINC}::DOUBLE * {SIN!r}::DOUBLE, 6) AS x, round(i * {XINC}::DOUBLE * {SIN!r}::DOUBLE + j * {YINC}::DOUBLE * {COS!r}::DOUBLE, 6) AS y FROM node)"


@register(
    "nearest_points",
    f"""{V.with_('point')}, q AS (SELECT point_id AS query_id, x + 7 AS qx, y - 3 AS qy FROM point WHERE point_id % 100 = 0),
 r AS (SELECT query_id, point_id, sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy)) AS distance FROM q, point), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, point_id) AS rank FROM r)
 SELECT query_id, point_id, rank, round(distance, 6) AS distance FROM k WHERE rank <= 5""",
)
def _(spark, d):
    p = V.point(spark, d)
    q = p.where("point_id % 100 = 0").select(F.col("point_id").alias("query_id"), (F.col("x") + 7).alias("x"), (F.col("y") - 3).alias("y"))
    return rounded(spatial.knn(p, q, 5, 40.0).select("query_id", "point_id", F.col("rank").cast("long").alias("rank"), "distance"))


@register(
    "infer_geometry_xy",
    f"{V.with_('node')} SELECT round(min(i) * {XINC * COS!r}::DOUBLE - min(j) * {YINC * SIN!r}::DOUBLE, 3) AS xori, round(min(i) * {XINC * SIN!r}::DOUBLE + min(j) * {YINC * COS!r}::DOUBLE, 3) AS yori, {XINC}::DOUBLE AS xinc, {YINC}::DOUBLE AS yinc, (max(i) - min(i) + 1)::BIGINT AS ncol, (max(j) - min(j) + 1)::BIGINT AS nrow, 30.0::DOUBLE AS rotation_deg, false AS yflip, true AS fits FROM node",
)
def _(spark, d):
    return rounded(lattice.infer_geometry_xy(_turned(spark, d), 60.0).drop("residual"), xori=3, yori=3, xinc=4, yinc=4, rotation_deg=4)


@register(
    "axis_steps",
    f"""{V.with_('node', _TURNED)}, r AS (SELECT a.point_id AS q, b.point_id AS p, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS d, (b.x - a.x) * {COS!r}::DOUBLE + (b.y - a.y) * {SIN!r}::DOUBLE AS u, (b.y - a.y) * {COS!r}::DOUBLE - (b.x - a.x) * {SIN!r}::DOUBLE AS v FROM turned a, turned b),
 k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, p) AS rank FROM r), n AS (SELECT * FROM k WHERE rank <= 64 AND d > 0 AND d <= 400),
 w AS (SELECT q, rank, axis, g, m FROM (SELECT q, rank, unnest([0, 1]) AS axis, unnest([u < 0, v < 0]) AS g, unnest([abs(u), abs(v)]) AS m, unnest([abs(v), abs(u)]) AS t FROM n) WHERE m > 0 AND t <= 0.3 * m),
 f AS (SELECT q, axis, g, min(rank) AS first FROM w GROUP BY 1, 2, 3), e AS (SELECT q, CASE WHEN count(*) = 4 THEN max(first) ELSE 64 END AS last FROM f GROUP BY 1),
 s AS (SELECT q, axis, g, min(m) AS m FROM w JOIN e USING (q) WHERE rank <= last GROUP BY 1, 2, 3), b AS (SELECT axis, least(floor(m / 400 * 512), 511) AS b, count(*) AS n, avg(m) AS step FROM s GROUP BY 1, 2)
 SELECT axis, round(arg_max(step, n * 1000 + b), 4) AS step FROM b GROUP BY 1""",
)
def _(spark, d):
    return rounded(lattice.axis_steps(_turned(spark, d), 30.0, XINC, 80.0), step=4)


@register(
    "mesh_blocks_decimated",
    f"{V.with_('node')}, n2 AS (SELECT *, i >= 25 AS block FROM node WHERE i % 2 = 0 AND j % 2 = 0) SELECT a.block, a.i AS ci, a.j AS cj, unnest([0, 1]) AS half FROM n2 a JOIN n2 b ON b.block = a.block AND b.i = a.i + 2 AND b.j = a.j JOIN n2 c ON c.block = a.block AND c.i = a.i + 2 AND c.j = a.j + 2 JOIN n2 e ON e.block = a.block AND e.i = a.i AND e.j = a.j + 2",
)
def _(spark, d):
    return mesh.quad_split(V.node(spark, d).withColumn("block", F.col("i") >= 25), 2, "block").select("block", "ci", "cj", "half")


@register("value_layer", f"{V.with_('node')} SELECT i, j, round(z, 6) AS z, round((SELECT min(z) FROM node), 6) AS low, round((SELECT max(z) FROM node), 6) AS high FROM node WHERE i % 2 = 0 AND j % 2 = 0")
def _(spark, d):
    return rounded(mesh.value_layer(V.node(spark, d), 2)[0])
