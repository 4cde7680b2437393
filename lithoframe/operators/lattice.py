"""Lattices behind point sets: geometry from indices, occupied outline, topology from an indexed export, step statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.scalars import node_xy
from . import graph, ranks, spatial

#: Neighbours that are looked at for axes and for steps along them, how far steps are sought (in short
#: steps), how far from its axis a neighbour may lie, and the classes of steps.
AXIS_NEIGHBOURS, STEP_NEIGHBOURS, STEP_REACH, AXIAL_TAN, STEP_BINS = 12, 64, 20.0, 0.30, 512
#: Points whose neighbours give the axes of a lattice, about; every point is checked against the result.
AXIS_POINTS = 2000


def _medians(df: DataFrame, *columns: str) -> DataFrame:
    """One row with the median of each column; of large tables by narrowing down, so that no state holds all values."""
    if df.limit(stats.MOST_ROWS + 1).count() <= stats.MOST_ROWS:
        return df.agg(*(F.percentile(c, 0.5).alias(c) for c in columns))
    out = None
    for c in columns:
        one = stats.percentiles(df, [], c, {c: 0.5})
        out = one if out is None else out.join(one)  # one row each
    return out


def infer_geometry(points: DataFrame, tolerance: float = 1e-3, column: str = "column", row: str = "row") -> DataFrame:
    """One row with the regular geometry that indexed points lie on; ``fits`` is whether the median residual is within tolerance.

    Steps between neighbours give the two axes as medians, what is left of each point gives the origin.
    """
    p = points.select(F.col(column).cast("long").alias("c"), F.col(row).cast("long").alias("r"), "x", "y")
    right = p.select((F.col("c") - 1).alias("c"), "r", F.col("x").alias("x2"), F.col("y").alias("y2"))
    up = p.select("c", (F.col("r") - 1).alias("r"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    step = lambda to, a: p.join(to, ["c", "r"]).select((F.col("x2") - F.col("x")).alias(f"{a}x"), (F.col("y2") - F.col("y")).alias(f"{a}y"))
    u, v = _medians(step(right, "u"), "ux", "uy"), _medians(step(up, "v"), "vx", "vy")
    size = p.agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("r").alias("r0"), F.max("r").alias("r1"))
    one = F.broadcast(u.join(v).join(size))  # one row each
    left = p.join(one).withColumns({
        "ox": F.col("x") - (F.col("c") - F.col("c0")) * F.col("ux") - (F.col("r") - F.col("r0")) * F.col("vx"),
        "oy": F.col("y") - (F.col("c") - F.col("c0")) * F.col("uy") - (F.col("r") - F.col("r0")) * F.col("vy"),
    })
    origin = _medians(left, "ox", "oy").withColumnsRenamed({"ox": "xori", "oy": "yori"})
    off = left.join(F.broadcast(origin))
    residual = _medians(off.select(F.sqrt((F.col("ox") - F.col("xori")) ** 2 + (F.col("oy") - F.col("yori")) ** 2).alias("residual")), "residual")
    return one.join(origin).join(residual).select(
        "xori", "yori", F.sqrt(F.col("ux") ** 2 + F.col("uy") ** 2).alias("xinc"), F.sqrt(F.col("vx") ** 2 + F.col("vy") ** 2).alias("yinc"),
        (F.col("c1") - F.col("c0") + 1).alias("ncol"), (F.col("r1") - F.col("r0") + 1).alias("nrow"), F.degrees(F.atan2("uy", "ux")).alias("rotation_deg"),
        (F.col("ux") * F.col("vy") - F.col("uy") * F.col("vx") < 0).alias("yflip"), "residual", (F.col("residual") <= tolerance).alias("fits"),
    )


def infer_geometry_xy(points: DataFrame, cell: float, tolerance: float = 1e-3, key: str = "point_id") -> DataFrame:
    """One row with the regular geometry of points known by place alone; ``fits`` if all are within tolerance, on nodes of their own.

    The shortest step between neighbours is one axis (of equal ones the one nearest to east), its normal the other;
    steps along each within one and a half of the shortest give its spacing, as their median. Neighbours are those of about ``AXIS_POINTS`` points by hash
    (a bounded sample), of which only two numbers an axis come to the driver; ``cell`` is where their search starts.
    """
    if not tolerance > 0:
        raise ValueError("tolerance must be positive")
    p = points.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").select(key, "x", "y")
    n = p.count()
    if n < 4:
        raise ValueError("a lattice needs four points with a position")
    some = p.where(F.pmod(F.xxhash64(key), F.lit(max(n // AXIS_POINTS, 1))) == 0).withColumnRenamed(key, "query_id")
    near = spatial.knn(p, some, AXIS_NEIGHBOURS + 1, cell, key).where(f"query_id <> {key} AND distance > {tolerance!r}")
    east = F.col("dx") < 0
    east = east | (F.col("dx") == 0) & (F.col("dy") < 0)
    steps = near.select(F.when(east, -F.col("dx")).otherwise(F.col("dx")).alias("dx"), F.when(east, -F.col("dy")).otherwise(F.col("dy")).alias("dy"), "distance")
    short = steps.agg(F.min(F.struct(F.round("distance", 9).alias("d"), F.abs(F.atan2("dy", "dx")).alias("a"), "dx", "dy")).alias("s")).head()["s"]
    if short is None:
        raise ValueError("no two points lie apart")
    length = (short["dx"] ** 2 + short["dy"] ** 2) ** 0.5
    ux, uy = short["dx"] / length, short["dy"] / length
    along, across = F.abs(F.col("dx") * ux + F.col("dy") * uy), F.abs(F.col("dy") * ux - F.col("dx") * uy)
    axes = steps.select(F.inline(F.array(F.struct(F.lit(0).alias("axis"), along.alias("s"), across.alias("t")), F.struct(F.lit(1).alias("axis"), across.alias("s"), along.alias("t")))))
    axes = axes.where(f"s > {tolerance!r} AND t <= {tolerance!r}").withColumn("least", F.min("s").over(Window.partitionBy("axis")))
    found = {r["axis"]: r["step"] for r in axes.where(F.col("s") <= 1.5 * F.col("least") + tolerance).groupBy("axis").agg(F.median("s").alias("step")).collect()}
    if len(found) < 2:
        raise ValueError("points do not step along two axes")
    uv = p.select((F.col("x") * ux + F.col("y") * uy).alias("u"), (F.col("y") * ux - F.col("x") * uy).alias("v"))
    u0, v0 = uv.agg(F.min("u"), F.min("v")).head()
    i, j = F.round((F.col("u") - u0) / found[0]), F.round((F.col("v") - v0) / found[1])
    off = F.sqrt((F.col("u") - u0 - i * found[0]) ** 2 + (F.col("v") - v0 - j * found[1]) ** 2)
    nodes = uv.select(i.cast("long").alias("i"), j.cast("long").alias("j"), off.alias("off")).groupBy("i", "j").agg(F.max("off").alias("off"), F.count("*").alias("n"))
    out = nodes.agg(F.max("i").alias("i1"), F.max("j").alias("j1"), F.max("off").alias("residual"), F.max("n").alias("n"))
    fits = (F.col("residual") <= tolerance) & (F.col("n") == 1) & (F.col("i1") >= 1) & (F.col("j1") >= 1)
    return out.select(
        F.lit(u0 * ux - v0 * uy).alias("xori"), F.lit(u0 * uy + v0 * ux).alias("yori"), F.lit(found[0]).alias("xinc"), F.lit(found[1]).alias("yinc"),
        (F.col("i1") + 1).alias("ncol"), (F.col("j1") + 1).alias("nrow"), F.degrees(F.atan2(F.lit(uy), F.lit(ux))).alias("rotation_deg"), F.lit(False).alias("yflip"), "residual", fits.alias("fits"),
    )


def axis_steps(points: DataFrame, azimuth_deg: float, seed: float, cell: float, key: str = "point_id") -> DataFrame:
    """``axis, step``: the modal step along an axis (0, at ``azimuth_deg`` from east) and its normal (1), of all points.

    Of each point the nearest neighbour towards either side of each axis counts, in classes up to ``STEP_REACH`` seeds;
    the step is the mean of the fullest class, ties to the higher. Neighbours beyond the one that settles the last of
    the four directions are not looked at.
    """
    from math import cos, radians, sin

    c, s, reach = cos(radians(azimuth_deg)), sin(radians(azimuth_deg)), STEP_REACH * seed
    near = spatial.knn(points, points.withColumnRenamed(key, "query_id"), STEP_NEIGHBOURS, cell, key).where((F.col("distance") > 0) & (F.col("distance") <= reach))
    along = (F.col("dx") * c + F.col("dy") * s, F.col("dy") * c - F.col("dx") * s)
    axial = lambda a: (F.abs(along[a]) > 0) & (F.abs(along[1 - a]) <= AXIAL_TAN * F.abs(along[a]))
    ways = [(a, sign, axial(a) & ((along[a] < 0) if sign else (along[a] >= 0))) for a in (0, 1) for sign in (0, 1)]
    own = Window.partitionBy("query_id")
    near = near.withColumns({f"_r{a}{g}": F.min(F.when(hit, F.col("rank"))).over(own) for a, g, hit in ways})
    every = " AND ".join(f"_r{a}{g} IS NOT NULL" for a, g, _ in ways)
    near = near.where(~F.expr(every) | (F.col("rank") <= F.greatest(*(f"_r{a}{g}" for a, g, _ in ways))))
    least = near.groupBy("query_id").agg(*(F.min(F.when(hit, F.abs(along[a]))).alias(f"m{a}{g}") for a, g, hit in ways))
    each = least.select(F.inline(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(f"m{a}{g}").alias("d")) for a, g, _ in ways)))).where("d IS NOT NULL")
    bins = each.groupBy("axis", F.least(F.floor(F.col("d") / reach * STEP_BINS), F.lit(STEP_BINS - 1)).alias("b")).agg(F.count("*").alias("n"), F.avg("d").alias("mean"))
    return bins.groupBy("axis").agg(F.max_by("mean", F.struct("n", "b")).alias("step"))


def occupied_edges(nodes: DataFrame) -> DataFrame:
    """Directed outline ``(i1, j1, i2, j2)`` of the cells whose four nodes are present, counter-clockwise."""
    n = nodes.where("z IS NOT NULL").select("i", "j")
    cells = n.select(F.explode(F.array(*(F.struct((F.col("i") - a).alias("i"), (F.col("j") - b).alias("j")) for a in (0, 1) for b in (0, 1)))).alias("c"))
    cells = cells.groupBy("c.i", "c.j").agg(F.count("*").alias("n")).where("n = 4").select("i", "j")
    corner = [(0, 0), (1, 0), (1, 1), (0, 1)]
    sides = F.array(*(
        F.struct((F.col("i") + a[0]).alias("i1"), (F.col("j") + a[1]).alias("j1"), (F.col("i") + b[0]).alias("i2"), (F.col("j") + b[1]).alias("j2"))
        for a, b in zip(corner, corner[1:] + corner[:1], strict=True)))
    e = cells.select(F.inline(sides))
    back = e.select(F.col("i2").alias("i1"), F.col("j2").alias("j1"), F.col("i1").alias("i2"), F.col("j1").alias("j2"))
    return e.join(back, ["i1", "j1", "i2", "j2"], "left_anti")


def full_edge(g: dict, spark: SparkSession) -> DataFrame:
    """``ring, seq, x, y``: the corner nodes of a geometry, from its origin along the first axis."""
    i, j = g["ncol"] - 1, g["nrow"] - 1
    corners = spark.createDataFrame([(0, k, *c) for k, c in enumerate(((0, 0), (i, 0), (i, j), (0, j)))], "ring int, seq int, i int, j int")
    x, y = node_xy(F.col("i"), F.col("j"), g)
    return corners.select("ring", "seq", x.alias("x"), y.alias("y"))


def perimeter(nodes: DataFrame, ncol: int, nrow: int) -> DataFrame:
    """``seq, i, j, x, y``: the outermost nodes of a structured surface that have a place, once around from node (0, 0)."""
    if min(ncol, nrow) < 2:
        raise ValueError("a perimeter needs two nodes along both axes")
    i, j = F.col("i").cast("long"), F.col("j").cast("long")
    # places along the low row, the high column, the high row backwards and the low column backwards
    seq = F.when(j == 0, i).when(i == ncol - 1, ncol - 1 + j).when(j == nrow - 1, 2 * (ncol - 1) + nrow - 1 - i).when(i == 0, 2 * (ncol - 1) + 2 * (nrow - 1) - j)
    inside = (i >= 0) & (i < ncol) & (j >= 0) & (j < nrow)
    placed = nodes.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    return placed.where(inside).withColumn("seq", seq).where("seq IS NOT NULL").select("seq", "i", "j", "x", "y")


def edge(nodes: DataFrame, g: dict, kind: str = "occupied") -> DataFrame:
    """The edge of a grid as rings: ``occupied`` (traced around cells with four nodes), ``hull`` of defined nodes, or ``full``.

    Rings of an occupied edge are numbered within each connected piece (``piece_x, piece_y``).
    """
    from . import kernels

    if kind == "full":
        return full_edge(g, nodes.sparkSession)
    at = lambda k: node_xy(F.col(f"i{k}"), F.col(f"j{k}"), g)
    if kind == "hull":
        x, y = node_xy(F.col("i"), F.col("j"), g)
        return spatial.hull(nodes.where("z IS NOT NULL").select(x.alias("x"), y.alias("y")))
    if kind != "occupied":
        raise ValueError(f"unknown edge: {kind}")
    sides = occupied_edges(nodes).select(F.lit(0).alias("mesh_id"), *(c.alias(f"{n}{k}") for k in (1, 2) for n, c in zip("xy", at(k), strict=True)))
    return kernels.boundary_rings(sides).drop("mesh_id")


def infer_grid(nodes: DataFrame, cell: float, tolerance: float = 1e-3, key: str = "vid") -> DataFrame:
    """The geometry of mesh nodes (``vid, block, i, j, x, y``): by their labels if all are of one block, else by place alone."""
    labelled, every, blocks = nodes.agg(F.count(F.when(F.expr("block IS NOT NULL AND i IS NOT NULL AND j IS NOT NULL"), 1)), F.count("*"), F.count_distinct("block")).head()
    if every and labelled == every and blocks == 1:
        return infer_geometry(nodes, tolerance, "i", "j")
    return infer_geometry_xy(nodes, cell, tolerance, key)


def structured_points(nodes: DataFrame) -> DataFrame:
    """Defined nodes with 1-based ``column`` and ``row``."""
    return nodes.where("z IS NOT NULL").select((F.col("i") + 1).alias("column"), (F.col("j") + 1).alias("row"), "z")


def duplicate_slots(points: DataFrame, column: str = "column", row: str = "row") -> DataFrame:
    """Slots that several points claim."""
    return points.groupBy(column, row).agg(F.count("*").alias("n")).where("n > 1")


def copy_topology(points: DataFrame, indexed: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """``points`` (with ``seq``) with the ``column`` and ``row`` of the indexed points at the same place; other points have none.

    Places meet on a grid of the tolerance, each point with its own and the neighbouring cells, and are then measured.
    """
    cell = lambda c: F.floor(F.col(c) / tolerance)
    reach = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))).alias("o")
    q = points.select("*", cell("x").alias("_cx"), cell("y").alias("_cy"), reach)
    q = q.withColumns({"_cx": F.col("_cx") + F.col("o.a"), "_cy": F.col("_cy") + F.col("o.b")}).drop("o")
    e = indexed.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("z").alias("_z"), "column", "row", cell("x").alias("_cx"), cell("y").alias("_cy"))
    near = (F.abs(F.col("x") - F.col("_x")) <= tolerance) & (F.abs(F.col("y") - F.col("_y")) <= tolerance) & (F.abs(F.col("z") - F.col("_z")) <= tolerance)
    got = q.join(e, ["_cx", "_cy"]).where(near).groupBy("seq").agg(F.min(F.struct("row", "column")).alias("_t"))
    return points.join(got, "seq", "left").select(*points.columns, F.col("_t.column").alias("column"), F.col("_t.row").alias("row"))


def modal_step(steps: DataFrame, seed: float, bins: int = 240) -> DataFrame:
    """Mean of the fullest of ``bins`` equal bins over 1.4 times the seed; ties to the higher bin."""
    width = 1.4 * seed / bins
    b = steps.where((F.col("d") > 0) & (F.col("d") < 1.4 * seed)).groupBy(F.floor(F.col("d") / width).alias("b")).agg(F.count("*").alias("n"), F.avg("d").alias("mean"))
    return b.agg(F.max_by("mean", F.struct("n", "b")).alias("step"))


def azimuth(steps: DataFrame) -> DataFrame:
    """Mean direction of steps (dx, dy) up to quarter turns, in degrees."""
    t = 4 * F.atan2("dy", "dx")
    return steps.agg((F.degrees(F.atan2(F.sum(F.sin(t)), F.sum(F.cos(t)))) / 4).alias("azimuth"))


def ring_area(rings: DataFrame, ring: str = "ring") -> DataFrame:
    """Signed shoelace area, positive counter-clockwise."""
    own = Window.partitionBy(ring).orderBy("seq")
    last = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = F.coalesce(F.lead("x").over(own), F.first("x").over(last)), F.coalesce(F.lead("y").over(own), F.first("y").over(last))
    e = rings.withColumns({"_nx": nx, "_ny": ny})
    return e.groupBy(ring).agg((F.sum(F.col("x") * F.col("_ny") - F.col("_nx") * F.col("y")) / 2).alias("area"))


def ordered_topology(points: DataFrame, indexed: DataFrame, tolerance: float = 1e-3, seq: str = "seq") -> DataFrame:
    """``points`` with the ``column`` and ``row`` of an indexed export of which they are an ordered subset; else it raises.

    Each point takes the first indexed point of its place that comes after the one its predecessor took. Both tables are
    numbered by ranges of ``seq``. Points begin with the first indexed point of their place; where that does not come
    after all that points before them have, they go on to the next that does, until nothing moves or none is left. Places
    meet on a grid of the tolerance; of repeated places all candidates are kept.
    """
    p = ranks.numbered(points.withColumnRenamed(seq, "_seq"), ["_seq"], "_at")
    e = ranks.numbered(indexed.select(F.col(seq).alias("_order"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("z").alias("_z"), "column", "row"), ["_order"], "_index")
    cell = lambda c: F.floor(F.col(c) / tolerance)
    reach = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))).alias("o")
    q = p.select("_at", "x", "y", "z", cell("x").alias("_cx"), cell("y").alias("_cy"), reach)
    q = q.withColumns({"_cx": F.col("_cx") + F.col("o.a"), "_cy": F.col("_cy") + F.col("o.b")})
    near = " AND ".join(f"abs({c} - _{c}) <= {tolerance!r}" for c in "xyz")
    found = q.join(e.select("_index", "_x", "_y", "_z", cell("_x").alias("_cx"), cell("_y").alias("_cy")), ["_cx", "_cy"]).where(near)
    found = p.select("_at").join(found.groupBy("_at").agg(F.sort_array(F.collect_set("_index")).alias("_all")), "_at", "left")
    now = graph.cut(found.select("_at", "_all", F.get("_all", F.lit(0)).alias("_index")))
    while True:
        here = now.withColumn("_range", F.expr(f"_at div {ranks.RANGE_ROWS}"))
        ends = here.groupBy("_range").agg(F.max("_index").alias("_most")).withColumn("_one", F.lit(0))  # a row a range
        ends = ends.select("_range", F.max("_most").over(Window.partitionBy("_one").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_most"))
        own = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        before = here.withColumn("_own", F.max("_index").over(own)).join(ends, "_range").withColumn("_before", F.greatest("_own", "_most"))
        moved = F.when(F.col("_before").isNull() | (F.col("_index") > F.col("_before")), F.col("_index")).otherwise(F.array_min(F.filter("_all", lambda c: c > F.col("_before"))))
        after = graph.cut(before.select("_at", "_all", moved.alias("_index"), (F.col("_index").isNull() | moved.isNull()).alias("_none"), (~moved.eqNullSafe(F.col("_index"))).alias("_moved")))
        none, changed = after.agg(F.count_if("_none"), F.count_if("_moved")).head()
        if none:
            raise ValueError("the points are not an ordered subset of the indexed export")
        if not changed:
            break
        now = after.select("_at", "_all", "_index")
    labelled = after.select("_at", "_index").join(e.select("_index", "column", "row"), "_index").select("_at", "column", "row")
    kept = [c for c in points.columns if c not in ("column", "row")]
    return p.withColumnRenamed("_seq", seq).select("_at", *kept).join(labelled, "_at").select(*kept, "column", "row")
