"""Lattice topology of bare points: which column and row each has, by fault blocks, without moving a point.

Every point predicts its four neighbours by the steps of the whole set, and where links along an axis are known by the
step measured there, so that links follow a lattice that bends or swells. A prediction meets the nearest point within a
part of the shorter step; of several that want the same neighbour the nearest gets it. Rounds end when no link is new.
Links then say the step from one point to the next, and connected pieces (fault blocks) are placed by contraction, in
rounds that grow with the logarithm of the number of points instead of one round a ring of cells.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from math import cos, radians, sin

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from . import delaunay, graph, lattice, spatial

#: How near a prediction a point must be (in shorter steps), what part of the whole set's step a measured one
#: may be, how far (in longer steps) and how straight on (as a cosine) a point counts as beyond a fault, and how near.
NEAR, LEAST_STEP, MOST_STEP, BEYOND, STRAIGHT, APART = 0.42, 0.6, 1.6, 2.2, 0.951, 0.5
#: Neighbours for the modal step, for directions, and the steps (in modal ones) that have a direction.
STEPS_OF, TURNS_OF, LEAST_TURN, MOST_TURN = 5, 4, 0.7, 1.3
_WAYS = ((0, 1), (0, -1), (1, 1), (1, -1))


@dataclass
class Topology:
    """``nodes`` (key, x, y, z, block, i, j), ``refused`` pairs (p, q) across faults, ``conflicts`` (block, i, j, n) and a ``report`` of one row."""

    nodes: DataFrame
    refused: DataFrame
    conflicts: DataFrame
    report: DataFrame
    key: str

    def labelled(self) -> DataFrame | None:
        """The points with ``column`` and ``row`` from 1, in order of rows and columns; None unless the report is verified."""
        if not self.report.head()["verified"]:
            return None
        return self.nodes.select(self.key, "x", "y", "z", (F.col("i") + 1).alias("column"), (F.col("j") + 1).alias("row")).orderBy("row", "column")


def distinct_nodes(points: DataFrame, key: str = "point_id") -> DataFrame:
    """One row a place: key and z of the smallest key there, how many repeat its z (``dropped``) and how many do not (``ambiguous``).

    Points without a place are left out.
    """
    placed = points.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('Infinity')" for c in "xy"))
    same = placed.groupBy("x", "y", "z").agg(F.min(key).alias(key), F.count("*").alias("n"))
    first = F.min(F.struct(key, "z", "n"))
    own = same.groupBy("x", "y").agg(first.alias("f"), F.sum("n").alias("n"))
    return own.select(F.col(f"f.{key}").alias(key), "x", "y", F.col("f.z").alias("z"), (F.col("f.n") - 1).alias("dropped"), (F.col("n") - F.col("f.n")).alias("ambiguous"))


def _within(queries: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Points (id, x, y) within ``radius`` of queries (qx, qy, and more), with their ``distance``; cells of twice the radius, four a query."""
    cell = lambda c: F.floor(c / (2 * radius)).cast("long")
    low = [cell(F.col(c) - radius) for c in ("qx", "qy")]
    around = F.explode(F.array(*(F.struct((low[0] + a).alias("cx"), (low[1] + b).alias("cy")) for a in (0, 1) for b in (0, 1)))).alias("c")
    d = F.sqrt((F.col("x") - F.col("qx")) ** 2 + (F.col("y") - F.col("qy")) ** 2)
    cells = points.select("id", "x", "y", cell(F.col("x")).alias("cx"), cell(F.col("y")).alias("cy"))
    return queries.select("*", around).select(*queries.columns, "c.cx", "c.cy").join(cells, ["cx", "cy"]).withColumn("distance", d).where(F.col("distance") <= radius).drop("cx", "cy")


def _links(p: DataFrame, steps: list[tuple[float, float]]) -> DataFrame:
    """``u, v, axis``: v is the next point after u along an axis."""
    length = [(x * x + y * y) ** 0.5 for x, y in steps]
    radius = NEAR * min(length)
    found, vector = None, None
    while True:
        way = lambda a, s: F.struct(F.lit(a).alias("axis"), F.lit(s).alias("sign"))
        each = p.select("id", "x", "y", F.explode(F.array(*(way(a, s) for a, s in _WAYS))).alias("w")).select("id", "x", "y", "w.axis", "w.sign")
        sx, sy = (F.when(F.col("axis") == 0, steps[0][k]).otherwise(steps[1][k]) for k in (0, 1))
        if found is not None:
            taken = found.select(F.col("u").alias("id"), "axis", F.lit(1).alias("sign")).unionByName(found.select(F.col("v").alias("id"), "axis", F.lit(-1).alias("sign")))
            # only ways whose measured step is new can find more than before
            each = each.join(taken, ["id", "axis", "sign"], "left_anti").join(vector, ["id", "axis"])
            sx, sy = F.col("mx"), F.col("my")
        asked = each.select("id", "axis", "sign", (F.col("x") + F.col("sign") * sx).alias("qx"), (F.col("y") + F.col("sign") * sy).alias("qy")).withColumnRenamed("id", "q")
        met = _within(asked, p, radius).where("q <> id")
        forth = F.when(F.col("sign") > 0, F.col("q")).otherwise(F.col("id"))
        pair = met.select(forth.alias("u"), F.when(F.col("sign") > 0, F.col("id")).otherwise(F.col("q")).alias("v"), "axis", "distance").groupBy("u", "v", "axis").agg(F.min("distance").alias("distance"))
        if found is not None:
            pair = pair.join(found.select("u", "axis"), ["u", "axis"], "left_anti").join(found.select("v", "axis"), ["v", "axis"], "left_anti")
        rank = lambda end, other: F.row_number().over(Window.partitionBy(end, "axis").orderBy("distance", other))
        best = pair.withColumns({"_u": rank("u", "v"), "_v": rank("v", "u")}).where("_u = 1 AND _v = 1").select("u", "v", "axis")
        best = graph.cut(best)
        if best.isEmpty():
            return found if found is not None else best
        found = best if found is None else graph.cut(found.unionByName(best))
        vector = graph.cut(_measured(p, found, length))


def _measured(p: DataFrame, links: DataFrame, length: list[float]) -> DataFrame:
    """``id, axis, mx, my``: the mean step along an axis at each point that has a link there, if it is like the whole set's."""
    at = lambda end: p.select(F.col("id").alias(end), F.col("x").alias(f"x{end}"), F.col("y").alias(f"y{end}"))
    step = links.join(at("u"), "u").join(at("v"), "v").select("u", "v", "axis", (F.col("xv") - F.col("xu")).alias("dx"), (F.col("yv") - F.col("yu")).alias("dy"))
    ends = step.select(F.explode(F.array("u", "v")).alias("id"), "axis", "dx", "dy").groupBy("id", "axis").agg(F.avg("dx").alias("mx"), F.avg("dy").alias("my"))
    size = F.sqrt(F.col("mx") ** 2 + F.col("my") ** 2) / F.when(F.col("axis") == 0, length[0]).otherwise(length[1])
    return ends.where((size > LEAST_STEP) & (size < MOST_STEP))


def detect(points: DataFrame, nominal: float | None = None, key: str = "point_id") -> Topology:
    """The topology of points (``key, x, y, z``).

    ``nominal`` is where the search for the modal step begins, else the median distance of nearest neighbours. Fewer than
    four places, or no steps along two axes, raise. Blocks are named by their smallest key and placed from 0 along both
    axes; a place that several points have is a conflict, and so is a link that contradicts its block's places.
    """
    if nominal is not None and not 0 < nominal < float("inf"):
        raise ValueError("the nominal cell must be positive")
    once = graph.cut(distinct_nodes(points, key))
    n, dropped, ambiguous, x0, x1, y0, y1 = once.agg(F.count("*"), F.sum("dropped"), F.sum("ambiguous"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).head()
    if n < 4:
        raise ValueError("topology needs four distinct points")
    p = once.select(F.col(key).alias("id"), "x", "y")
    start = max(((x1 - x0) * (y1 - y0) / n) ** 0.5, (x1 - x0) / n, (y1 - y0) / n)
    near = graph.cut(spatial.knn(p, p.withColumnRenamed("id", "query_id"), STEPS_OF + 1, 1.5 * start, "id").where("query_id <> id AND distance > 0"))
    if nominal is None:
        first = near.groupBy("query_id").agg(F.min("distance").alias("d"))
        nominal = stats.percentiles(first, [], "d", {"m": 0.5}).head()["m"]
    seed = lattice.modal_step(near.where(F.col("rank") <= STEPS_OF + 1).select(F.col("distance").alias("d")), nominal).head()["step"]
    if not seed:
        raise ValueError("no steps between neighbours")
    turning = near.where((F.col("rank") <= TURNS_OF + 1) & F.col("distance").between(LEAST_TURN * seed, MOST_TURN * seed))
    azimuth = lattice.azimuth(turning).head()["azimuth"]
    if azimuth is None:
        raise ValueError("no steps give a direction")
    incs = {r["axis"]: r["step"] for r in lattice.axis_steps(p, azimuth, seed, 1.5 * start, "id").collect()}  # two rows
    if len(incs) < 2:
        raise ValueError("no steps along both axes")
    c, s = cos(radians(azimuth)), sin(radians(azimuth))
    steps = [(c * incs[0], s * incs[0]), (-s * incs[1], c * incs[1])]
    links = _links(p, steps)
    along = lambda a: F.when(F.col("axis") == a, 1).otherwise(0).cast("long")
    moved = graph.cut(links.select("u", "v", along(0).alias("di"), along(1).alias("dj")))
    places = graph.placed(moved, ["di", "dj"])
    own = p.join(places, F.col("id") == F.col("node"), "left").select("id", "x", "y", F.coalesce("component", "id").alias("block"), F.coalesce("di", F.lit(0)).alias("i"), F.coalesce("dj", F.lit(0)).alias("j"))
    low = own.groupBy("block").agg(F.min("i").alias("_i"), F.min("j").alias("_j"))
    own = graph.cut(own.join(low, "block").select("id", "x", "y", "block", (F.col("i") - F.col("_i")).alias("i"), (F.col("j") - F.col("_j")).alias("j")))
    end = lambda k: own.select(F.col("id").alias(k), F.struct("block", "i", "j").alias(f"_{k}"))
    wrong = moved.join(end("u"), "u").join(end("v"), "v").where("_v.i - _u.i <> di OR _v.j - _u.j <> dj").select("_u.block", "_u.i", "_u.j")
    several = own.groupBy("block", "i", "j").agg(F.count("*").alias("n")).where("n > 1")
    conflicts = graph.cut(several.unionByName(wrong.groupBy("block", "i", "j").agg((F.count("*") + 1).alias("n"))).groupBy("block", "i", "j").agg(F.max("n").alias("n")))
    refused = graph.cut(_refused(own, moved, steps))
    size = own.groupBy("block").agg(F.count("*").alias("n"))
    report = size.agg(F.count("*").alias("blocks"), F.max("n").alias("largest_block"), F.sum("n").alias("distinct_nodes")).withColumns({
        "assigned": F.col("distinct_nodes"), "conflicts": F.lit(conflicts.agg(F.sum(F.col("n") - 1)).head()[0] or 0).cast("long"), "stalled_frontier": F.lit(refused.count()).cast("long"),
        "coincident_dropped": F.lit(dropped), "coincident_ambiguous": F.lit(ambiguous), "cell_i": F.lit(incs[0]), "cell_j": F.lit(incs[1]), "azimuth_deg": F.lit(azimuth),
    }).withColumn("verified", F.expr("blocks = 1 AND conflicts = 0 AND coincident_ambiguous = 0"))
    nodes = own.withColumnRenamed("id", key).join(once.select(key, "z"), key).select(key, "x", "y", "z", "block", "i", "j")
    return Topology(nodes, refused, conflicts, report, key)


def _refused(own: DataFrame, links: DataFrame, steps: list[tuple[float, float]]) -> DataFrame:
    """``p, q``: where p has no next point along an axis, the nearest point of another block that lies straight on."""
    axis = F.when(F.col("di") == 1, 0).otherwise(1)
    taken = links.select(F.col("u").alias("q"), axis.alias("axis"), F.lit(1).alias("sign")).unionByName(links.select(F.col("v").alias("q"), axis.alias("axis"), F.lit(-1).alias("sign")))
    length = [(x * x + y * y) ** 0.5 for x, y in steps]
    open_ = own.select(F.col("id").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("block").alias("qb"), F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.lit(s).alias("sign")) for a, s in _WAYS))).alias("w"))
    open_ = open_.select("q", "qx", "qy", "qb", "w.axis", "w.sign").join(taken, ["q", "axis", "sign"], "left_anti")
    pick = lambda values: F.when(F.col("axis") == 0, values[0]).otherwise(values[1])
    met = _within(open_, own, BEYOND * max(length)).where((F.col("distance") >= APART * pick(length)) & (F.col("distance") > 0))
    unit: list[Column] = [pick([st[k] / ln for st, ln in zip(steps, length, strict=True)]) * F.col("sign") for k in (0, 1)]
    ahead = ((F.col("x") - F.col("qx")) * unit[0] + (F.col("y") - F.col("qy")) * unit[1]) / F.col("distance")
    other = met.where(ahead > STRAIGHT).join(own.select("id", F.col("block").alias("ib")), "id").where("ib <> qb")
    return other.groupBy("q", "axis", "sign").agg(F.min(F.struct("distance", "id")).alias("b")).select(F.col("q").alias("p"), F.col("b.id").alias("q")).distinct()


def geometry_or_surface(points: DataFrame, cell: float, tolerance: float = 1e-3, max_bridge: float | None = None, fallback: str = "tri", key: str = "point_id"):
    """``("grid_geometry", one row)`` of points that lie on a regular lattice, else ``("tri_surface", surface)`` with a warning.

    With ``fallback="error"`` points without a regular lattice raise. The triangulation takes axes, steps, blocks and
    refused pairs from :func:`detect`.
    """
    if fallback not in ("tri", "error"):
        raise ValueError(f"unknown fallback: {fallback}")
    try:
        fitted = graph.cut(lattice.infer_geometry_xy(points, cell, tolerance, key))
        why = None if fitted.head()["fits"] else "no regular lattice fits these points"
    except ValueError as e:
        fitted, why = None, str(e)
    if why is None:
        return "grid_geometry", fitted
    if fallback == "error":
        raise ValueError(f"{why}; give a geometry or triangulate the points")
    found = detect(points, key=key)
    r = found.report.head()
    made = delaunay.tri_surface(points, r["azimuth_deg"], r["cell_i"], r["cell_j"], found.nodes.select(key, "block", "i", "j"), found.refused, max_bridge=max_bridge, key=key)
    warnings.warn(f"{why}: triangulated instead", stacklevel=2)
    return "tri_surface", made
