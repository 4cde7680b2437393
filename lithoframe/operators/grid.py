"""Grids as node tables (i, j, z): arithmetic, areas, volumes, smoothing, sampling, gridding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import divided, node_xy, xy_to_ij
from . import ranks


def same_geometry(a: dict, b: dict, tolerance: float = 1e-9) -> None:
    """Refuses two geometries that differ."""
    for k in sorted(a.keys() | b.keys()):
        x, y = a.get(k), b.get(k)
        close = x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) <= tolerance * max(abs(x), abs(y), 1.0)
        if not close:
            raise ValueError(f"geometry mismatch: {k} is {x} and {y}")


def combine(a: DataFrame, b: DataFrame, op: str, geometry: tuple[dict, dict] | None = None, sparse: bool = False) -> DataFrame:
    """Node-wise ``plus``, ``minus``, ``times`` or ``divided_by`` of two grids of one geometry; undefined propagates.

    Geometries that differ are refused, if given, and so is a node that only one grid has. With ``sparse`` grids, which
    leave undefined nodes out, such a node is undefined.
    """
    if geometry is not None:
        same_geometry(*geometry)
    x, y = F.col("a.z"), F.col("b.z")
    z = {"plus": x + y, "minus": x - y, "times": x * y, "divided_by": divided(x, y)}[op]
    if sparse:
        return a.alias("a").join(b.alias("b"), ["i", "j"]).select("i", "j", z.alias("z"))
    met = a.withColumn("_in", F.lit(True)).alias("a").join(b.withColumn("_in", F.lit(True)).alias("b"), ["i", "j"], "full")
    missing = F.col("a._in").isNull() | F.col("b._in").isNull()
    return met.select("i", "j", F.when(missing, F.raise_error(F.lit("geometry mismatch: a node is in one grid only")).cast("double")).otherwise(z).alias("z"))


def thickness(top: DataFrame, base: DataFrame, clamp: bool = True, geometry: tuple[dict, dict] | None = None, sparse: bool = False) -> DataFrame:
    """Base less top at each node, 0 where they cross (unless not ``clamp``); grids as in :func:`combine`."""
    d = combine(base, top, "minus", geometry, sparse)
    return d.withColumn("z", F.when(F.col("z").isNotNull(), F.greatest("z", F.lit(0.0)))) if clamp else d


def area_below(grid: DataFrame, depth: float, cell: float) -> DataFrame:
    return grid.agg((F.count(F.when(F.col("z") <= depth, 1)) * cell).alias("area"))


def area_above(grid: DataFrame, depth: float, cell: float) -> DataFrame:
    return grid.agg((F.count(F.when(F.col("z") >= depth, 1)) * cell).alias("area"))


def areas(grid: DataFrame, depth: float, cell: float) -> DataFrame:
    """``below`` and ``above`` of one depth in one pass."""
    return grid.agg((F.count(F.when(F.col("z") <= depth, 1)) * cell).alias("below"), (F.count(F.when(F.col("z") >= depth, 1)) * cell).alias("above"))


def volume_between(a: DataFrame, b: DataFrame, cell: float, geometry: tuple[dict, dict] | None = None) -> DataFrame:
    """Unsigned volume over nodes that both define, however the grids leave the others out."""
    return combine(a, b, "minus", geometry, sparse=True).agg((F.coalesce(F.sum(F.abs("z")), F.lit(0.0)) * cell).alias("volume"))


def hypsometry(grid: DataFrame, cell: float) -> DataFrame:
    """A row per defined node: value and area of all nodes up to it, ties in order of i and j.

    Nodes are ranked by ranges of (z, i, j), as many as their number needs, so no task sorts the whole grid, even where
    one value is common.
    """
    found = ranks.numbered(grid.where("z IS NOT NULL").select("i", "j", "z"), ["z", "i", "j"])
    return found.select("i", "j", "z", ((F.col("position") + 1) * cell).alias("area"))


def smooth(grid: DataFrame, radius: int) -> DataFrame:
    """Mean of the defined nodes within the square of ``radius``; the mask stays. Rows are summed, then columns."""
    if radius == 0:
        return grid.select("i", "j", "z")
    # sums along i also for positions that only neighbours define, as the sums along j need them
    reach = F.explode(F.sequence(F.lit(-radius), F.lit(radius)))
    slots = grid.where("z IS NOT NULL").select("i", "j", F.col("z").alias("_s"), F.lit(1).alias("_c"), reach.alias("_o"))
    part = slots.groupBy((F.col("i") + F.col("_o")).alias("i"), "j").agg(F.sum("_s").alias("_s"), F.sum("_c").alias("_c"))
    near = Window.partitionBy("i").orderBy("j").rangeBetween(-radius, radius)
    part = part.withColumns({"_s": F.sum("_s").over(near), "_c": F.sum("_c").over(near)})
    return grid.where("z IS NOT NULL").select("i", "j").join(part, ["i", "j"]).select("i", "j", (F.col("_s") / F.col("_c")).alias("z"))


def sample(grid: DataFrame, points: DataFrame, g: dict, key: str = "point_id") -> DataFrame:
    """Bilinear value at ``points``; undefined outside or where the nearest corner is, else over the defined corners."""
    fi, fj = xy_to_ij(F.col("x"), F.col("y"), g)
    p = points.select(key, fi.alias("fi"), fj.alias("fj"))
    p = p.where((F.col("fi") >= 0) & (F.col("fi") <= g["ncol"] - 1) & (F.col("fj") >= 0) & (F.col("fj") <= g["nrow"] - 1))
    i0, j0 = F.least(F.floor("fi"), F.lit(g["ncol"] - 2)).cast("int"), F.least(F.floor("fj"), F.lit(g["nrow"] - 2)).cast("int")
    p = p.withColumns({"i0": i0, "j0": j0}).withColumns({"u": F.col("fi") - F.col("i0"), "v": F.col("fj") - F.col("j0")})
    corners = F.array(*(
        F.struct((F.col("i0") + a).alias("i"), (F.col("j0") + b).alias("j"), ((F.col("u") if a else 1 - F.col("u")) * (F.col("v") if b else 1 - F.col("v"))).alias("w"),
                 ((F.col("u") >= 0.5).cast("int") == a).alias("nu"), ((F.col("v") >= 0.5).cast("int") == b).alias("nv"))
        for a in (0, 1) for b in (0, 1)))
    c = p.select(key, F.inline(corners)).join(grid, ["i", "j"], "left")
    near = F.max(F.when(F.col("nu") & F.col("nv"), F.col("z")))
    ok = F.col("z").isNotNull()
    total = F.sum(F.when(ok, F.col("w")))
    z = F.when(near.isNotNull(), F.try_divide(F.sum(F.when(ok, F.col("w") * F.col("z"))), total))
    return points.select(key).join(c.groupBy(key).agg(z.alias("z")), key, "left")


def nodes(g: dict, spark) -> DataFrame:
    """Every node of a geometry with its map position."""
    n = spark.range(g["ncol"] * g["nrow"])
    i, j = (F.col("id") % g["ncol"]).cast("int"), F.floor(F.col("id") / g["ncol"]).cast("int")
    n = n.select(i.alias("i"), j.alias("j"))
    x, y = node_xy(F.col("i"), F.col("j"), g)
    return n.select("i", "j", x.alias("x"), y.alias("y"))


def constant(g: dict, spark, value: float) -> DataFrame:
    return nodes(g, spark).withColumn("z", F.lit(float(value)))


def resample(grid: DataFrame, g: dict, target: dict) -> DataFrame:
    """The grid on another geometry: bilinear at each of its nodes, undefined outside."""
    points = nodes(target, grid.sparkSession).withColumn("_node", F.struct("i", "j"))
    return sample(grid, points, g, "_node").select("_node.i", "_node.j", "z")


def default_geometry(points: DataFrame, cell: float, tolerance: float = 1e-3, key: str = "point_id") -> dict:
    """The regular lattice that points lie on; points without one raise, as no other geometry is theirs."""
    from . import lattice

    r = lattice.infer_geometry_xy(points, cell, tolerance, key).head().asDict()
    if not r["fits"]:
        raise ValueError("no regular lattice fits these points: give a geometry or triangulate them")
    return {k: r[k] for k in ("xori", "yori", "xinc", "yinc", "ncol", "nrow", "rotation_deg", "yflip")}


def from_points(points: DataFrame, g: dict | None, method: str = "nearest", power: float = 2.0, start: DataFrame | None = None) -> DataFrame:
    """``i, j, z`` of scattered points on a geometry by ``nearest``, ``idw`` or ``min_curvature``; no points leave it undefined.

    Without a geometry it is that of the points (:func:`default_geometry`). Least curvature is one task up to a tile's number of nodes, and goes by tiles beyond it or from a surface ``start``
    (``i, j, z``), which may be known from the same points before some of them moved.
    """
    from . import kernels, spatial, tiles

    if g is None:
        extent = points.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.count("*")).head()
        g = default_geometry(points, 2 * max((extent[0] * extent[1] / max(extent[2], 1)) ** 0.5, 1e-9))
    spark, known = points.sparkSession, points.where("z IS NOT NULL")
    to = nodes(g, spark)
    if method == "idw":
        return to.select("i", "j").join(spatial.idw(known, to, ["i", "j"], power), ["i", "j"], "left")
    if method == "min_curvature" and (start is not None or g["ncol"] * g["nrow"] > tiles.SIDE**2):
        return to.select("i", "j").join(tiles.min_curvature(known, g, start)[0], ["i", "j"], "left")
    if method == "min_curvature":
        got = kernels.min_curvature_grid(known.withColumn("surface_id", F.lit(0)), g).select("i", "j", "z")
        return to.select("i", "j").join(got, ["i", "j"], "left")
    if method != "nearest":
        raise ValueError(f"unknown method: {method}")
    cell = 2 * max(g["xinc"], g["yinc"])
    queries = to.select((F.col("j") * g["ncol"] + F.col("i")).cast("long").alias("query_id"), "x", "y")
    near = spatial.nearest(known, queries, cell).join(known.select("point_id", "z"), "point_id", "left")
    return near.select((F.col("query_id") % g["ncol"]).cast("int").alias("i"), F.floor(F.col("query_id") / g["ncol"]).cast("int").alias("j"), "z")


def lift(grid: DataFrame, g: dict) -> DataFrame:
    """Nodes of a grid with their map position and a label (``block`` 0, i, j); values and all other lanes as they are."""
    x, y = node_xy(F.col("i"), F.col("j"), g)
    return grid.withColumns({"block": F.lit(0), "x": x, "y": y})


def resample_lanes(nodes: DataFrame, g: dict, lanes: list[str], method: str = "nearest", power: float = 2.0) -> DataFrame:
    """``i, j`` and a column for each lane of scattered nodes (``point_id, x, y`` and the lanes), gridded one by one.

    Undefined and infinite values of a lane take no part in it.
    """
    out = None
    for lane in lanes:
        known = nodes.where(F.col(lane).isNotNull() & ~F.isnan(lane) & (F.abs(lane) < float("inf")))
        one = from_points(known.select("point_id", "x", "y", F.col(lane).cast("double").alias("z")), g, method, power).withColumnRenamed("z", lane)
        out = one if out is None else out.join(one, ["i", "j"])
    if out is None:
        raise ValueError("no lane to grid")
    return out
