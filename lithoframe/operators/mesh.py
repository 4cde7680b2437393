"""Triangle meshes as tables: quad splits, edges, boundaries, components, contour segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph


def quad_split(nodes: DataFrame, stride: int = 1, block: str | None = None) -> DataFrame:
    """Two triangles (i, j of each corner) for every cell whose four corners are defined; ``stride`` thins the lattice.

    With ``block`` each fault block is a lattice of its own, and no cell spans two.
    """
    own = [block] if block else []
    n = nodes.where("z IS NOT NULL")
    if stride > 1:
        n = n.where((F.pmod("i", F.lit(stride)) == 0) & (F.pmod("j", F.lit(stride)) == 0))
    n = n.select(*own, "i", "j", F.col("z").alias("z"))
    # each node is a corner of four cells: one shuffle gathers a cell's corners
    cells = n.select(*own, F.explode(F.array(*(F.struct((F.col("i") - a * stride).alias("ci"), (F.col("j") - b * stride).alias("cj"), F.lit(2 * b + a).alias("k")) for a in (0, 1) for b in (0, 1)))).alias("c"), "z")
    cells = cells.groupBy(*own, "c.ci", "c.cj").agg(*(F.max(F.when(F.col("c.k") == k, F.col("z"))).alias(f"z{k}") for k in range(4)))
    cells = cells.where(" AND ".join(f"z{k} IS NOT NULL" for k in range(4)))
    corner = lambda a, b: F.struct((F.col("ci") + a * stride).alias("i"), (F.col("cj") + b * stride).alias("j"), F.col(f"z{2 * b + a}").alias("z"))
    two = F.array(F.struct(F.lit(0).alias("half"), corner(0, 0).alias("a"), corner(1, 0).alias("b"), corner(1, 1).alias("c")), F.struct(F.lit(1).alias("half"), corner(0, 0).alias("a"), corner(1, 1).alias("b"), corner(0, 1).alias("c")))
    return cells.select(*own, "ci", "cj", F.inline(two))


def edges(triangles: DataFrame) -> DataFrame:
    """Undirected edges with the number of triangles at each."""
    at = lambda c: F.struct(F.col(f"{c}.i").alias("i"), F.col(f"{c}.j").alias("j"))
    pair = lambda u, v: F.struct(F.least(at(u), at(v)).alias("u"), F.greatest(at(u), at(v)).alias("v"))
    e = triangles.select(F.inline(F.array(pair("a", "b"), pair("b", "c"), pair("c", "a"))))
    return e.groupBy("u", "v").agg(F.count("*").alias("n"))


def wireframe(triangles: DataFrame) -> DataFrame:
    """Edges without the inner diagonals of cells."""
    diagonal = (F.abs(F.col("u.i") - F.col("v.i")) >= 1) & (F.abs(F.col("u.j") - F.col("v.j")) >= 1)
    return edges(triangles).where(~((F.col("n") == 2) & diagonal))


def boundary(triangles: DataFrame) -> DataFrame:
    """Edges of one triangle only."""
    return edges(triangles).where("n = 1")


def contour_segments(triangles: DataFrame, levels: list[float]) -> DataFrame:
    """Where each level crosses each triangle: ``level, ci, cj, half`` and the two ends in node units."""
    t = triangles.select("*", F.explode(F.array(*(F.lit(float(x)) for x in levels))).alias("level"))
    above = {c: F.col(f"{c}.z") >= F.col("level") for c in "abc"}

    def cut(u: str, v: str):
        f = F.try_divide(F.col("level") - F.col(f"{u}.z"), F.col(f"{v}.z") - F.col(f"{u}.z"))
        at = lambda k: F.col(f"{u}.{k}") + (F.col(f"{v}.{k}") - F.col(f"{u}.{k}")) * f
        return F.when(above[u] != above[v], F.struct(at("i").alias("x"), at("j").alias("y")))

    ends = F.array_compact(F.array(cut("a", "b"), cut("b", "c"), cut("c", "a")))
    t = t.select("level", "ci", "cj", "half", ends.alias("ends")).where(F.size("ends") == 2)
    return t.select("level", "ci", "cj", "half", *(F.get("ends", F.lit(k))[c].alias(f"{c}{k + 1}") for k in (0, 1) for c in "xy"))


def value_layer(nodes: DataFrame, stride: int = 1, value: str = "z", block: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A layer to draw: its nodes with the value and the ``low`` and ``high`` of all nodes, and its triangles.

    ``stride`` thins nodes and triangles, not the range, so that colours stay as they are; nodes keep their own values.
    """
    own = [block] if block else []
    n = nodes.select(*own, "i", "j", F.when(~F.isnan(value), F.col(value)).alias("z"))
    span = n.where("abs(z) < double('Infinity')").agg(F.min("z").alias("low"), F.max("z").alias("high"))
    kept = n.where((F.pmod("i", F.lit(stride)) == 0) & (F.pmod("j", F.lit(stride)) == 0))
    return kept.join(F.broadcast(span)), quad_split(n, stride, block)  # one row


def aligned_levels(low: float, high: float, interval: float) -> list[float]:
    """Multiples of ``interval`` within the range."""
    from math import ceil, floor

    if interval <= 0:
        raise ValueError("interval must be positive")
    e = 1e-9 * max(abs(low), abs(high), 1.0)
    return [k * interval for k in range(ceil((low - e) / interval), floor((high + e) / interval) + 1)]


def wireframe_blocks(triangles: DataFrame, stride: int = 1, block: str = "block", mesh: str = "mesh_id") -> DataFrame:
    """``mesh, u, v`` of the wireframe of meshes whose corners carry ``vid``, and ``block, i, j`` where they are labelled.

    Inner cell diagonals of a block are left out. Of the rest, every ``stride``-th grid line stays, and all boundary
    edges, edges without labels and seams between blocks.
    """
    end = lambda u, v: F.struct(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"))
    at = {c: F.struct(F.col(f"{c}.vid").alias("vid"), F.col(f"{c}.{block}").alias("block"), F.col(f"{c}.i").alias("i"), F.col(f"{c}.j").alias("j")) for c in "abc"}
    e = triangles.select(mesh, F.inline(F.array(end(at["a"], at["b"]), end(at["b"], at["c"]), end(at["c"], at["a"])))).groupBy(mesh, "u", "v").agg(F.count("*").alias("n"))
    same = F.coalesce(F.expr("u.block = v.block"), F.lit(False))
    di, dj = F.abs(F.col("u.i") - F.col("v.i")), F.abs(F.col("u.j") - F.col("v.j"))
    on = lambda c: F.pmod(F.col(f"u.{c}"), F.lit(stride)) == 0
    keep = F.when(F.col("n") == 1, True).when(same & (F.col("n") == 2) & (di == 1) & (dj == 1), False)
    keep = keep.when(same & (di == 1) & (dj == 0), on("j")).when(same & (di == 0) & (dj == 1), on("i")).otherwise(True)
    return e.where(keep).select(mesh, F.col("u.vid").alias("u"), F.col("v.vid").alias("v"))


def islands(triangles: DataFrame, least: int = 8, mesh: str = "mesh_id") -> DataFrame:
    """Triangles of components with at least so many of them."""
    size = components(triangles, mesh).withColumn("_n", F.count("*").over(Window.partitionBy(mesh, "component")))
    return triangles.join(size.where(F.col("_n") >= least).select(mesh, "tid"), [mesh, "tid"], "left_semi")


def wireframe_stride(triangles: DataFrame, stride: int) -> DataFrame:
    """The wireframe's every ``stride``-th grid lines, with all boundary edges."""
    on = lambda c: F.pmod(F.col(f"u.{c}"), F.lit(stride)) == 0
    along_i, along_j = F.col("u.j") == F.col("v.j"), F.col("u.i") == F.col("v.i")
    return wireframe(triangles).where((F.col("n") == 1) | (along_i & on("j")) | (along_j & on("i")))


def components(triangles: DataFrame, mesh: str = "mesh_id") -> DataFrame:
    """Component of each triangle (``mesh``, ``tid``, vertices ``a``, ``b``, ``c``) by shared vertices: the smallest vertex.

    Vertices are linked along edges and joined in rounds, so a mesh of any size spreads over tasks.
    """
    at = lambda c: F.struct(F.col(mesh).alias("mesh"), F.col(c).alias("vertex"))
    links = triangles.select(F.inline(F.array(F.struct(at("a").alias("u"), at("b").alias("v")), F.struct(at("a").alias("u"), at("c").alias("v")))))
    found = graph.components(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
    own = triangles.withColumn("_a", at("a")).join(found, F.col("_a") == F.col("node"), "left")
    return own.select(mesh, "tid", F.coalesce("component.vertex", "a").alias("component"))


def faults(triangles: DataFrame, vertices: DataFrame, mesh: str = "mesh_id") -> DataFrame:
    """What is wrong with a mesh: ``mesh, kind, n`` for unknown vertices, triangles that repeat one, and edges of more than two."""
    known = vertices.select(mesh, F.col("vid").alias("v"), F.lit(True).alias("_known")).distinct()
    corners = triangles.select(mesh, F.explode(F.array("a", "b", "c")).alias("v"))
    unknown = corners.join(known, [mesh, "v"], "left").where("_known IS NULL").groupBy(mesh).agg(F.count("*").alias("n")).withColumn("kind", F.lit("unknown vertex"))
    flat = triangles.where("a = b OR b = c OR c = a").groupBy(mesh).agg(F.count("*").alias("n")).withColumn("kind", F.lit("repeated vertex"))
    pair = lambda u, v: F.struct(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"))
    sides = triangles.select(mesh, F.inline(F.array(pair("a", "b"), pair("b", "c"), pair("c", "a"))))
    many = sides.where("u <> v").groupBy(mesh, "u", "v").agg(F.count("*").alias("_n")).where("_n > 2").groupBy(mesh).agg(F.count("*").alias("n")).withColumn("kind", F.lit("edge of more than two"))
    columns = [mesh, "kind", "n"]
    return unknown.select(columns).union(flat.select(columns)).union(many.select(columns))


def corners(triangles: DataFrame, mesh: str = "mesh_id") -> DataFrame:
    """The corner table of triangles (``mesh, tid, a, b, c``): a row a corner ``k`` (0 to 2) with its ``vertex``, the vertices
    of the ``next`` and ``prev`` corner, and the corner across the side between these, ``opposite`` (tid, k).

    One shuffle on sides. A side of the outline has no opposite, nor has one that more than two triangles share (``shared``
    has their number): such sides belong to :func:`faults`.
    """
    name = "abc"
    each = F.array(*(F.struct(F.lit(k).alias("k"), F.col(name[k]).alias("vertex"), F.col(name[(k + 1) % 3]).alias("next"), F.col(name[(k + 2) % 3]).alias("prev")) for k in range(3)))
    c = triangles.select(mesh, "tid", F.inline(each)).withColumns({"_u": F.least("next", "prev"), "_v": F.greatest("next", "prev")})
    side = Window.partitionBy(mesh, "_u", "_v")
    # the other corner of a pair is the one that the row is not: with two of them, their extremes
    own = F.struct("tid", "k")
    both = c.withColumns({"shared": F.count("*").over(side), "_low": F.min(own).over(side), "_high": F.max(own).over(side)})
    across = F.when(F.col("shared") == 2, F.when(own == F.col("_low"), F.col("_high")).otherwise(F.col("_low")))
    return both.select(mesh, "tid", "k", "vertex", "next", "prev", across.alias("opposite"), "shared")


def outline(corner_table: DataFrame, mesh: str = "mesh_id") -> DataFrame:
    """Directed sides ``u, v`` of a corner table that have no triangle beyond them."""
    return corner_table.where("shared = 1").select(mesh, F.col("next").alias("u"), F.col("prev").alias("v"))


def fans(corner_table: DataFrame, mesh: str = "mesh_id") -> DataFrame:
    """``mesh, vertex, seq, tid, piece``: the triangles around each vertex, counter-clockwise, by stepping over shared sides.

    A fan that is open begins at the outline, a closed one at its smallest neighbour. A vertex at which several fans meet
    has several pieces, numbered by where they begin. One shuffle on vertices; a task holds the triangles of one vertex.
    """
    around = corner_table.groupBy(mesh, "vertex").agg(F.sort_array(F.collect_list(F.struct("next", "prev", "tid"))).alias("x"))
    # where each corner's fan begins: sides that no other corner of the vertex ends with, then what is left over
    ends = F.transform("x", lambda c: c["prev"])
    opened = F.filter("x", lambda c: ~F.array_contains(ends, c["next"]))

    def walk(start: Column, rest: Column) -> Column:
        """Corners from ``start`` on, as long as the next one is among ``rest``."""

        def step(done: Column, _: Column) -> Column:
            at = F.element_at(done, -1)
            found = F.filter(rest, lambda c: (c["next"] == at["prev"]) & (c["tid"] != at["tid"]) & ~F.exists(done, lambda d: d["tid"] == c["tid"]))
            return F.when(F.size(found) > 0, F.concat(done, F.slice(found, 1, 1))).otherwise(done)

        return F.aggregate(rest, F.array(start), step)

    every = F.transform(opened, lambda c: walk(c, F.col("x")))
    # closed fans: what no open one reaches, from its smallest corner, until nothing is left
    def close(done: Column, c: Column) -> Column:
        seen = F.exists(done, lambda fan: F.exists(fan, lambda d: d["tid"] == c["tid"]))
        return F.when(seen, done).otherwise(F.concat(done, F.array(walk(c, F.col("x")))))

    pieces = F.aggregate("x", every, close)
    out = around.select(mesh, "vertex", F.posexplode(pieces).alias("piece", "fan"))
    return out.select(mesh, "vertex", "piece", F.posexplode("fan").alias("seq", "c")).select(mesh, "vertex", "piece", "seq", F.col("c.tid").alias("tid"))
