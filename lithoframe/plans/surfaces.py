"""Queries on triangulated surfaces, lattice topology, corner tables and percentiles of any fraction."""

from __future__ import annotations

from math import cos, radians, sin

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import attributes, delaunay, kernels, lattice, logs, mesh, petro, topology, zones
from . import functions
from . import views as V
from .geometry import _QUAD, DRAWN_SQL, drawn
from .wells import rounded, zones_of

QUERIES: dict = {}
ORACLES: dict = {}
#: The longest side of a triangle in point units, and a turned lattice whose right part (from column 16) is thrown by half a cell.
REACH, COS, SIN, STEP, FAULT = 60.0, cos(radians(20)), sin(radians(20)), 25.0, 16


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@register(
    "percentiles_any",
    f"{V.with_('curve')} SELECT mnemonic, round(quantile_cont(value, 0.025), 6) AS p025, round(quantile_cont(value, 0.333), 6) AS p333, round(quantile_cont(value, 0.999), 6) AS p999 FROM curve WHERE value IS NOT NULL GROUP BY mnemonic",
)
def _(spark, d):
    return rounded(stats.percentiles(V.curve(spark, d), ["mnemonic"], "value", {"p025": 0.025, "p333": 0.333, "p999": 0.999}))


_SIDES = f"""p AS (SELECT min(point_id) AS id, x, y FROM point GROUP BY x, y), e AS (SELECT a.id AS a, b.id AS b, a.x AS a_x, a.y AS a_y, b.x AS b_x, b.y AS b_y FROM p a JOIN p b ON a.id < b.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= {REACH**2}),
 t AS (SELECT e.*, f.b AS c, f.b_x AS c_x, f.b_y AS c_y, 2 * ((e.b_x - e.a_x) * (f.b_y - e.a_y) - (e.b_y - e.a_y) * (f.b_x - e.a_x)) AS d FROM e JOIN e f ON f.a = e.a AND f.b > e.b JOIN e g ON g.a = e.b AND g.b = f.b),
 o AS (SELECT *, ((c_y - a_y) * ((b_x - a_x) ** 2 + (b_y - a_y) ** 2) - (b_y - a_y) * ((c_x - a_x) ** 2 + (c_y - a_y) ** 2)) / d AS ux, ((b_x - a_x) * ((c_x - a_x) ** 2 + (c_y - a_y) ** 2) - (c_x - a_x) * ((b_x - a_x) ** 2 + (b_y - a_y) ** 2)) / d AS uy FROM t WHERE d <> 0),
 tri AS (SELECT a, CASE WHEN d > 0 THEN b ELSE c END AS b, CASE WHEN d > 0 THEN c ELSE b END AS c FROM o WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.id NOT IN (o.a, o.b, o.c) AND sqrt((p.x - a_x - ux) ** 2 + (p.y - a_y - uy) ** 2) < sqrt(ux * ux + uy * uy) * (1 - 1e-9)))"""


@register("delaunay_triangles", f"{V.with_('point', _SIDES)} SELECT a, b, c FROM tri")
def _(spark, d):
    return delaunay.triangles(V.point(spark, d), REACH)


_THROWN = f"""cells AS (SELECT DISTINCT l_partkey % 32 AS i, (l_orderkey * 7 + l_linenumber) % 23 AS j FROM lineitem)"""


def _lattice(spark, d):
    """A node a cell that line items fall in, turned, its right part thrown by half a step."""
    cells = V.table(spark, d, "lineitem").select((F.col("l_partkey") % 32).cast("long").alias("i"), ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 23).cast("long").alias("j")).distinct()
    u, v = F.col("i") * STEP, F.col("j") * STEP + F.when(F.col("i") >= FAULT, STEP / 2).otherwise(0.0)
    return cells.select((F.col("i") * 1000 + F.col("j")).alias("point_id"), (u * COS - v * SIN).alias("x"), (u * SIN + v * COS).alias("y"), (F.col("i") + F.col("j")).cast("double").alias("z"))


_BLOCKS = f"""link AS (SELECT a.i * 1000 + a.j AS u, b.i * 1000 + b.j AS v FROM cells a JOIN cells b ON abs(a.i - b.i) + abs(a.j - b.j) = 1 AND (a.i >= {FAULT}) = (b.i >= {FAULT})),
 r(v, root) AS (SELECT i * 1000 + j, i * 1000 + j FROM cells UNION SELECT link.v, r.root FROM r JOIN link ON link.u = r.v WHERE r.root < link.v),
 own AS (SELECT v AS point_id, v // 1000 AS i, v % 1000 AS j, min(root) AS block FROM r GROUP BY v)"""


@register(
    "lattice_topology",
    f"{V.with_(_THROWN, _BLOCKS).replace('WITH ', 'WITH RECURSIVE ', 1)} SELECT point_id::BIGINT AS point_id, block::BIGINT AS block, (i - min(i) OVER w)::BIGINT AS i, (j - min(j) OVER w)::BIGINT AS j FROM own WINDOW w AS (PARTITION BY block)",
)
def _(spark, d):
    return topology.detect(_lattice(spark, d)).nodes.select("point_id", "block", "i", "j")


@register(
    "tri_surface",
    f"""{V.with_(_THROWN, _BLOCKS).replace('WITH ', 'WITH RECURSIVE ', 1)},
 spot AS (SELECT DISTINCT i - di AS i, j - dj AS j, block FROM own, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) o(di, dj)),
 cell AS (SELECT a.point_id AS p00, b.point_id AS p10, c.point_id AS p11, e.point_id AS p01 FROM spot LEFT JOIN own a ON a.i = spot.i AND a.j = spot.j AND a.block = spot.block
  LEFT JOIN own b ON b.i = spot.i + 1 AND b.j = spot.j AND b.block = spot.block LEFT JOIN own c ON c.i = spot.i + 1 AND c.j = spot.j + 1 AND c.block = spot.block LEFT JOIN own e ON e.i = spot.i AND e.j = spot.j + 1 AND e.block = spot.block),
 three AS (SELECT p00 AS a, p10 AS b, p11 AS c FROM cell WHERE p10 IS NOT NULL UNION ALL SELECT p00, p11, p01 FROM cell WHERE p01 IS NOT NULL UNION ALL SELECT p00, p10, p01 FROM cell WHERE p11 IS NULL UNION ALL SELECT p01, p10, p11 FROM cell WHERE p00 IS NULL)
 SELECT a::BIGINT AS a, b::BIGINT AS b, c::BIGINT AS c FROM three WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL""",
)
def _(spark, d):
    points = _lattice(spark, d)
    found = topology.detect(points)
    r = found.report.head()
    made = delaunay.tri_surface(points, r["azimuth_deg"], r["cell_i"], r["cell_j"], found.nodes.select("point_id", "block", "i", "j"), found.refused)
    return made.triangles.select("a", "b", "c")


def _flat(spark, d):
    vid = lambda c: (F.col(f"{c}.i") * 1000 + F.col(f"{c}.j")).cast("long").alias(c)
    tid = ((F.col("ci") * 1000 + F.col("cj")) * 2 + F.col("half")).cast("long")
    return mesh.quad_split(V.node(spark, d)).select(F.lit(0).alias("mesh_id"), tid.alias("tid"), vid("a"), vid("b"), vid("c"))


_CORNERS = """f AS (SELECT (ci * 1000 + cj) * 2 + half AS tid, [ai * 1000 + aj, bi * 1000 + bj, ki * 1000 + kj] AS v FROM tri),
 c AS (SELECT tid, k, v[k + 1] AS vertex, v[(k + 1) % 3 + 1] AS nx, v[(k + 2) % 3 + 1] AS pv FROM f, range(3) r(k))"""


@register(
    "mesh_opposites",
    f"{V.with_('node', _QUAD, _CORNERS)} SELECT c.tid::BIGINT AS tid, c.k::INT AS k, c.vertex::BIGINT AS vertex, o.tid::BIGINT AS other_tid, o.k::INT AS other_k FROM c LEFT JOIN c o ON o.tid <> c.tid AND ((o.nx = c.pv AND o.pv = c.nx) OR (o.nx = c.nx AND o.pv = c.pv))",
)
def _(spark, d):
    return mesh.corners(_flat(spark, d)).select("tid", "k", "vertex", F.col("opposite.tid").alias("other_tid"), F.col("opposite.k").alias("other_k"))


@register(
    "mesh_fans",
    f"""{V.with_('node', _QUAD, _CORNERS).replace('WITH ', 'WITH RECURSIVE ', 1)}, s AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.vertex = c.vertex AND x.pv = c.nx)),
 open AS (SELECT vertex, tid, pv, 0 AS seq, nx AS head FROM s UNION ALL SELECT c.vertex, c.tid, c.pv, open.seq + 1, open.head FROM open JOIN c ON c.vertex = open.vertex AND c.nx = open.pv),
 shut AS (SELECT vertex, min(nx) AS head FROM c WHERE NOT EXISTS (SELECT 1 FROM open WHERE open.vertex = c.vertex AND open.tid = c.tid) GROUP BY vertex),
 ring AS (SELECT c.vertex, c.tid, c.pv, 0 AS seq, head FROM shut JOIN c ON c.vertex = shut.vertex AND c.nx = shut.head UNION ALL SELECT c.vertex, c.tid, c.pv, ring.seq + 1, ring.head FROM ring JOIN c ON c.vertex = ring.vertex AND c.nx = ring.pv WHERE c.nx <> ring.head)
 SELECT vertex::BIGINT AS vertex, dense_rank() OVER (PARTITION BY vertex ORDER BY head) - 1 AS piece, seq::BIGINT AS seq, tid::BIGINT AS tid FROM (SELECT vertex, tid, seq, head FROM open UNION ALL SELECT vertex, tid, seq, head FROM ring)""",
)
def _(spark, d):
    long = lambda c: F.col(c).cast("long").alias(c)
    return mesh.fans(mesh.corners(_flat(spark, d))).select("vertex", long("piece"), long("seq"), "tid")


@register("points_where", f"{V.with_('point')} SELECT point_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM point WHERE x * x + y * y < 6400 AND z > 0")
def _(spark, d):
    near = attributes.where(V.point(spark, d), lambda x, y: x * x + y * y < 6400)
    return rounded(attributes.where(near, F.col("z") > 0))


@register(
    "points_columns",
    f"{V.with_('point')} SELECT point_id, round(z / nullif(x, 0), 6) AS slope, round(CASE WHEN x >= 0 THEN sqrt(x) END, 6) AS root, round(z * 2 - y, 6) AS mixed, 7.5::DOUBLE AS level, CASE WHEN point_id % 3 = 0 THEN round(x, 6) END AS some FROM point",
)
def _(spark, d):
    p = V.point(spark, d)
    some = p.where("point_id % 3 = 0").select("point_id", F.col("x").alias("value"))
    out = attributes.assign(attributes.assign(p, "Level", 7.5), "some", some)
    out = attributes.assign(out, "slope", attributes.combined(F.col("z"), "/", F.col("x")))
    out = attributes.assign(out, "root", attributes.combined(F.col("x"), "**", 0.5))
    out = attributes.assign(out, "mixed", attributes.combined(attributes.combined(F.col("z"), "*", 2), "-", F.col("y")))
    return rounded(out.select("point_id", "slope", "root", "mixed", "level", "some"))


@register("surface_promote", f"{V.with_('node')} SELECT i, j, round(z, 6) AS primary, round(i * 1.5 + j, 6) AS z FROM node")
def _(spark, d):
    lanes = attributes.assign(V.node(spark, d), "My Lane", F.col("i") * 1.5 + F.col("j"))
    return rounded(attributes.promote(lanes, "my-lane"))


@register(
    "ordered_topology",
    f"{V.with_('node')}, e AS (SELECT *, row_number() OVER (ORDER BY j, i) AS seq FROM node) SELECT seq, (i + 1)::INT AS column, (j + 1)::INT AS row FROM e WHERE (i * 7 + j) % 3 <> 0",
)
def _(spark, d):
    from ..operators import ranks

    n = ranks.numbered(V.node(spark, d), ["j", "i"])
    e = n.select((F.col("position") + 1).alias("seq"), (F.col("i") * 25.0).alias("x"), (F.col("j") * 25.0).alias("y"), "z", (F.col("i") + 1).alias("column"), (F.col("j") + 1).alias("row"), "i", "j")
    return lattice.ordered_topology(e.where("(i * 7 + j) % 3 <> 0").select("seq", "x", "y", "z"), e.drop("i", "j")).select("seq", "column", "row")


@register("contour_lines_sql")
def _(spark, d):
    functions.register(spark)
    pieces = kernels._pieces(mesh.contour_segments(mesh.quad_split(V.node(spark, d)), [910.5, 955.5]), "level")
    pieces.createOrReplaceTempView("contour_pieces")
    return spark.sql("SELECT * FROM chain_lines(TABLE(contour_pieces) PARTITION BY (level, piece_x, piece_y), 0.05)")


@register("top_interval", f"{V.with_('curve', 'tops', 'zones')} SELECT bore_id, round(top_md, 6) AS top_md, round(base_md, 6) AS base_md, round(base_md - top_md, 6) AS thickness_md FROM zones WHERE zone = 'B'")
def _(spark, d):
    return rounded(zones.top(zones_of(spark, d), "b").select("bore_id", "top_md", "base_md", "thickness_md"))


@register("interval_log", f"{V.with_('curve', 'tops', 'zones')} SELECT bore_id, mnemonic, md, round(value, 6) AS value, seq FROM curve JOIN zones USING (bore_id) WHERE zone = 'B' AND md >= top_md AND md < base_md")
def _(spark, d):
    return rounded(zones.interval_log(V.curve(spark, d), zones_of(spark, d), "B").select("bore_id", "mnemonic", "md", "value", "seq"))


@register("log_names", f"{V.with_('curve')} SELECT (row_number() OVER (ORDER BY lower(name), name) - 1)::INT AS seq, name FROM (SELECT DISTINCT mnemonic AS name FROM curve)")
def _(spark, d):
    return logs.names(V.curve(spark, d))


@register("reservoir_area", f"{DRAWN_SQL} SELECT 'area' AS input, round(sum(a) * 0.3048 * 0.3048, 4) AS area FROM (SELECT abs(sum(x1 * y2 - x2 * y1)) / 2 AS a FROM edge WHERE poly_id = 7 GROUP BY poly_id)")
def _(spark, d):
    return rounded(petro.reservoir_area(drawn(spark, d).where("poly_id = 7"), "ft"), area=4)
