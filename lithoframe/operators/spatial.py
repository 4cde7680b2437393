"""Points and polygons: nearest neighbours by cells, inverse distance, containment, areas, hulls."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph

#: Points meet the edges of their band of y, of which there are so many at most; up to so many edges (56 bytes each) are broadcast.
BROADCAST_EDGES, MOST_BANDS = 100_000, 1_000_000
#: Points of a cell that a search begins with, at most (as long as smaller cells part them), and how much smaller a try is.
CELL_POINTS, CELL_STEP = 256, 4.0
#: Control points (40 bytes each) of one block of inverse-distance sums.
BROADCAST_POINTS = 100_000


def _placed(df: DataFrame) -> DataFrame:
    """Rows whose x and y are numbers."""
    return df.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < 1e300" for c in "xy"))


def _fitting(points: DataFrame, cell: float, most: int) -> float:
    """``cell``, or a smaller one that holds at most ``most`` points; a count per cell each try, until points no longer part."""
    size, before, stuck = float(cell), None, 0
    while True:
        full = points.groupBy(F.floor(F.col("x") / size), F.floor(F.col("y") / size)).count().agg(F.max("count")).head()[0] or 0
        stuck = stuck + 1 if before is not None and full > 0.9 * before else 0
        if full <= most or stuck > 2:
            return size * CELL_STEP**stuck
        size, before = size / CELL_STEP, full


def nearest(points: DataFrame, queries: DataFrame, cell: float, key: str = "point_id", query: str = "query_id") -> DataFrame:
    """The nearest point of each query in the plane, ties to the smallest id; none for queries without a position.

    Points and queries meet by cell, at first of size ``cell`` or, where that holds many points, of a fitting one. A query
    is settled once its best distance is no longer than the searched rings reach; the rest go on with rings twice as wide
    (cells doubled), so no pair outside a ring is ever made. Rings end at the extent of all points and queries, and each
    round's result is stored.
    """
    if not cell > 0:
        raise ValueError("cell must be positive")
    points, placed = _placed(points), _placed(queries)
    left = placed.select(query, F.col("x").alias("qx"), F.col("y").alias("qy"))
    nowhere = queries.join(placed.select(query), query, "left_anti").select(query)
    none = lambda q: q.select(query, F.lit(None).cast(dict(points.dtypes)[key]).alias(key), F.lit(None).cast("double").alias("distance"))
    b = points.select("x", "y").union(left.select("qx", "qy")).agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).head()
    if points.isEmpty():
        return none(queries.select(query))
    done = [none(nowhere)]
    size, extent = _fitting(points, cell, CELL_POINTS), 2 * ((b[0] or 0.0) + (b[1] or 0.0))
    while not left.isEmpty():
        pts = points.select(key, "x", "y", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
        around = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
        q = left.select("*", around.alias("o")).select(query, "qx", "qy", (F.floor(F.col("qx") / size) + F.col("o.a")).alias("cx"), (F.floor(F.col("qy") / size) + F.col("o.b")).alias("cy"))
        d = F.sqrt((F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy")))
        best = q.join(pts, ["cx", "cy"]).groupBy(query).agg(F.min(F.struct(d.alias("distance"), F.col(key).alias("id"))).alias("b"))
        # nothing outside the ring of cells can be nearer than one cell; the last ring has everything
        found = best if size > extent else best.where(F.col("b.distance") <= size)
        done.append(graph.cut(found.select(query, F.col("b.id").alias(key), F.col("b.distance").alias("distance"))))
        if size > extent:
            break
        left = graph.cut(left.join(done[-1].select(query), query, "left_anti"))
        size *= 2
    return reduce(DataFrame.unionByName, done)


def knn(points: DataFrame, queries: DataFrame, k: int, cell: float, key: str = "point_id", query: str = "query_id") -> DataFrame:
    """``query, key, rank, distance, dx, dy``: the ``k`` nearest points of each query, ties by id; fewer where there are fewer points.

    As :func:`nearest`: queries meet points by cell, are settled once all ``k`` lie within one cell's reach, and the rest
    go on with doubled cells up to the extent. ``dx`` and ``dy`` lead from the query to the point.
    """
    if not cell > 0 or k < 1:
        raise ValueError("cell and k must be positive")
    points = _placed(points).select(key, "x", "y")
    left = _placed(queries).select(query, F.col("x").alias("qx"), F.col("y").alias("qy"))
    b = points.select("x", "y").union(left.select("qx", "qy")).agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).head()
    size, extent = _fitting(points, cell, max(CELL_POINTS, 8 * k)), 2 * ((b[0] or 0.0) + (b[1] or 0.0))
    first = Window.partitionBy(query).orderBy("distance", key)
    done: list[DataFrame] = []
    while not done or not left.isEmpty():
        pts = points.select("*", F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("y") / size).alias("cy"))
        around = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1))))
        q = left.select("*", around.alias("o")).select(query, "qx", "qy", (F.floor(F.col("qx") / size) + F.col("o.a")).alias("cx"), (F.floor(F.col("qy") / size) + F.col("o.b")).alias("cy"))
        dx, dy = F.col("x") - F.col("qx"), F.col("y") - F.col("qy")
        pair = q.join(pts, ["cx", "cy"]).select(query, key, F.sqrt(dx * dx + dy * dy).alias("distance"), dx.alias("dx"), dy.alias("dy"))
        # the rank's limit is applied before the shuffle, too, so that a full cell sends k rows a query and task
        best = pair.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
        if size <= extent:
            settled = F.count(F.when(F.col("distance") <= size, 1)).over(Window.partitionBy(query)) == k
            best = best.withColumn("_settled", settled).where("_settled")
        done.append(graph.cut(best.select(query, key, "rank", "distance", "dx", "dy")))
        if size > extent:
            break
        left = graph.cut(left.join(done[-1].select(query).distinct(), query, "left_anti"))
        size *= 2
    return reduce(DataFrame.unionByName, done)


def idw(points: DataFrame, targets: DataFrame, keys: list[str], power: float = 2.0) -> DataFrame:
    """Inverse-distance values at ``targets`` from a stated set of control points; exact on a point (smallest id).

    Every point weighs at every target by definition. Up to ``BROADCAST_POINTS`` points meet the targets by broadcast;
    more are dealt into blocks of so many, whose sums are added up per target.
    """
    d2 = (F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py"))
    p = _placed(points).where("z IS NOT NULL").select(F.col("point_id"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))
    n = p.count()
    w = F.when(F.col("_d") > 0, 1 / F.pow("_d", F.lit(power / 2)))
    parts = []
    dealt = p.withColumn("_block", F.pmod(F.xxhash64("point_id"), F.lit(max(1, -(-n // BROADCAST_POINTS)))))
    for k in range(max(1, -(-n // BROADCAST_POINTS))):
        met = targets.join(F.broadcast(dealt.where(F.col("_block") == k)), how="cross").withColumn("_d", d2)
        parts.append(met.groupBy(*keys).agg(F.min(F.when(F.col("_d") == 0, F.struct("point_id", "pz"))).alias("_on"), F.sum(w * F.col("pz")).alias("_z"), F.sum(w).alias("_w")))
    every = reduce(DataFrame.unionByName, parts).groupBy(*keys)
    return every.agg(F.coalesce(F.min("_on")["pz"], F.sum("_z") / F.sum("_w")).alias("z"))


def edges(rings: DataFrame, poly: str = "poly_id", order: str = "vseq") -> DataFrame:
    """``poly, x1, y1, x2, y2`` of closed rings; rings of fewer than three vertices are dropped."""
    own = Window.partitionBy(poly).orderBy(order)
    all_ = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    e = rings.select(poly, F.col("x").alias("x1"), F.col("y").alias("y1"), F.coalesce(F.lead("x").over(own), F.first("x").over(all_)).alias("x2"), F.coalesce(F.lead("y").over(own), F.first("y").over(all_)).alias("y2"), F.count("*").over(Window.partitionBy(poly)).alias("_n"))
    return e.where("_n >= 3").drop("_n")


def inside(points: DataFrame, rings: DataFrame, key: str = "point_id", poly: str = "poly_id", broadcast_edges: int = BROADCAST_EDGES) -> DataFrame:
    """Ids of points in any ring, by even-odd crossings; the boundary is outside."""
    e = edges(rings, poly)
    facts = e.agg(F.count("*").alias("n"), F.avg(F.abs(F.col("y2") - F.col("y1"))).alias("height"), (F.max(F.greatest("y1", "y2")) - F.min(F.least("y1", "y2"))).alias("span")).head()
    points = points.select(key, "x", "y")
    # a band is about as high as two edges
    size = max(2 * (facts["height"] or 0.0), (facts["span"] or 0.0) / MOST_BANDS) or 1.0
    e = e.withColumn("_band", F.explode(F.sequence(F.floor(F.least("y1", "y2") / size), F.floor(F.greatest("y1", "y2") / size))))
    e = F.broadcast(e) if facts["n"] <= broadcast_edges else e
    points = points.withColumn("_band", F.floor(F.col("y") / size))
    x, y = F.col("x"), F.col("y")
    cross = (F.col("x2") - F.col("x1")) * (y - F.col("y1")) - (F.col("y2") - F.col("y1")) * (x - F.col("x1"))
    on = (cross == 0) & x.between(F.least("x1", "x2"), F.greatest("x1", "x2")) & y.between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    hit = ((F.col("y1") > y) != (F.col("y2") > y)) & (x < (F.col("x2") - F.col("x1")) * F.try_divide(y - F.col("y1"), F.col("y2") - F.col("y1")) + F.col("x1"))
    near = (F.col("y") >= F.least("y1", "y2")) & (F.col("y") <= F.greatest("y1", "y2"))
    met = points.join(e, "_band").where(near)
    each = met.groupBy(key, poly).agg(F.sum(F.coalesce(hit, F.lit(False)).cast("int")).alias("n"), F.max(on.cast("int")).alias("on"))
    return each.where("n % 2 = 1 AND on = 0").select(key).distinct()


def polygon_area(rings: DataFrame, poly: str = "poly_id") -> DataFrame:
    """Unsigned shoelace area of each ring."""
    return edges(rings, poly).groupBy(poly).agg((F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))) / 2).alias("area"))


def total_area(rings: DataFrame, poly: str = "poly_id") -> DataFrame:
    """The area of all rings together, 0 if there is none."""
    return polygon_area(rings, poly).agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"))


def bbox(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))


def _chain(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    points = sorted(set(points))
    if len(points) < 3:
        return points
    out: list[tuple[float, float]] = []
    for turn in (points, points[::-1]):
        half: list[tuple[float, float]] = []
        for p in turn:
            while len(half) > 1 and (half[-1][0] - half[-2][0]) * (p[1] - half[-2][1]) - (half[-1][1] - half[-2][1]) * (p[0] - half[-2][0]) <= 0:
                half.pop()
            half.append(p)
        out += half[:-1]
    return out


def hull(points: DataFrame) -> DataFrame:
    """Convex hull, counter-clockwise from the leftmost point: partial hulls per partition, then the hull of those."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[tuple[float, float]] = []
        for b in batches:
            kept = _chain(kept + list(b.itertuples(index=False, name=None)))
        yield pd.DataFrame(kept, columns=["x", "y"])

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = _chain(list(pdf[["x", "y"]].itertuples(index=False, name=None)))
        return pd.DataFrame({"vseq": range(len(ring)), "x": [p[0] for p in ring], "y": [p[1] for p in ring]}).astype({"vseq": "int32", "x": "float64", "y": "float64"})

    small = points.select("x", "y").where("x IS NOT NULL AND y IS NOT NULL").mapInPandas(partial, "x double, y double")
    return small.withColumn("_g", F.lit(1)).groupBy("_g").applyInPandas(final, "vseq int, x double, y double")


def clip(nodes: DataFrame, rings: DataFrame, poly: str = "poly_id") -> DataFrame:
    """Grid nodes (i, j, x, y, z) with z undefined outside every ring."""
    key = F.struct("i", "j")
    hit = inside(nodes.withColumn("_node", key), rings, "_node", poly).select(F.col("_node.i").alias("i"), F.col("_node.j").alias("j"), F.lit(True).alias("_in"))
    return nodes.join(hit, ["i", "j"], "left").withColumn("z", F.when(F.col("_in"), F.col("z"))).drop("_in")
