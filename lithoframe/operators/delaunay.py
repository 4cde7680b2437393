"""Delaunay triangles of scattered points, found edge by edge from neighbours, and surfaces made of them.

An edge p q is Delaunay if some circle through both is empty. Circles through both have their centers on the bisector;
a point c on the left lies in every circle whose center is beyond the place s(c) = (c-p).(c-q) / (2 (q-p) x (c-p)) on it,
in lengths of the edge. So the third corner on the left is the point with the least s, and from the nearest neighbour of p,
whose edge is always Delaunay, one third corner after the other leads round p.

Points meet by cells so small that none has many, with a halo. A point is settled when all circles round it lie within its
cell and halo, where every point is known. What is not settled goes on with larger cells, along with the settled corners of
its triangles: these fill its circles' places, so that other settled points are not needed again. In the largest cells, the
halo is longer than the longest edge. Circles that are larger still, which only edges of gaps and of the outline have, are
checked against a pyramid of occupied cells, from the extent down, where a cell that lies in the circle settles it at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import cos, radians, sin

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph, mesh

#: The longest link in cells if none is given, and what it must lie between (a cell's diagonal, two cells).
DEFAULT_LINK, LEAST_LINK, MOST_LINK = 1.8, 2**0.5, 2.0
#: Sine of the sum of opposite angles up to which four corners are on one circle, as those of a lattice's cell are; all four
#: see the same value. Corners whose places on a bisector (in lengths of the edge) differ by ``WIDE`` times that are compared.
SAME, WIDE = 1e-7, 1000
#: Points that a cell has at first at most, its halo in cells, the largest cell in longest edges (its halo exceeds one).
CELL_POINTS, HALO, LARGEST = 400, 0.25, 4.5
#: Times that the largest cell may be halved, and the pyramid's extent; distances that a kernel holds at once.
HALVINGS, LEVELS, BLOCK = 40, 30, 1 << 16
#: Points in cells that a circle's line crosses, a circle and in all, that the pyramid's last step compares one by one.
DIRECT, LEAST_DIRECT = 64, 100_000


def _round(ex: np.ndarray, ey: np.ndarray, begin: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Corners to the left, one after the other, from the neighbour ``begin`` of each row; ``ex, ey`` lead to all points.

    Integers (row, u, w, least rank of u, w and others on their circle), the circles (x, y from the row's point, r), and
    which rows came round to where they began.
    """
    closed, sides, circles = np.zeros(len(ex), dtype=bool), [np.zeros((0, 4), dtype=np.int64)], [np.zeros((0, 3))]
    rows, at = np.arange(len(ex)), begin
    for _ in range(ex.shape[1] + 1):
        x, y, n = ex[rows], ey[rows], np.arange(len(rows))
        dx, dy = x[n, at], y[n, at]
        cross, dot = dx[:, None] * y - dy[:, None] * x, x * (x - dx[:, None]) + y * (y - dy[:, None])
        with np.errstate(all="ignore"):
            s = np.where(cross > 0, dot / (2 * cross), np.inf)
            to = s.argmin(axis=1)
            best = s[n, to]
            same = s <= (best + WIDE * SAME)[:, None]
            r = np.sqrt((dx * dx + dy * dy) * (0.25 + best * best))
            circle = np.stack([dx / 2 - best * dy, dy / 2 + best * dx, r], axis=1)
        found = np.isfinite(r)
        one = found & (same.sum(axis=1) == 1)
        sides.append(np.stack([rows[one], at[one], to[one], np.minimum(rank[at[one]], rank[to[one]])], axis=1))
        circles.append(circle[one])
        for k in np.flatnonzero(found & ~one):  # several on one circle, in order of their angle
            on = np.flatnonzero(same[k])
            on = on[np.argsort(-(dx[k] * x[k, on] + dy[k] * y[k, on]) / cross[k, on], kind="stable")]
            t, place = to[k], np.arange(len(on))
            early = place < np.flatnonzero(on == t)[0]
            a, b = np.where(early, on, t), np.where(early, t, on)
            around = np.hypot(dx[k], dy[k]) * np.hypot(x[k, a] - dx[k], y[k, a] - dy[k]) * np.hypot(x[k, b] - x[k, a], y[k, b] - y[k, a]) * np.hypot(x[k, b], y[k, b])
            on = on[(on == t) | (2 * cross[k, on] * cross[k, t] * (s[k, on] - best[k]) <= SAME * around)]
            if (back := np.flatnonzero(on == begin[rows[k]])).size:
                on = on[: back[0] + 1]
            chain, to[k] = np.append(at[k], on), on[-1]
            sides.append(np.stack([np.full(len(on), rows[k]), chain[:-1], on, np.full(len(on), rank[chain].min())], axis=1))
            circles.append(np.repeat(circle[k : k + 1], len(on), axis=0))
        back_ = found & (to == begin[rows])
        closed[rows[back_]] = True
        rows, at = rows[found & ~back_], to[found & ~back_]
        if not len(rows):
            break
    return np.concatenate(sides), np.concatenate(circles), closed


#: Kinds of rows that a cell gives: a triangle; a triangle whose circle leaves the halo; a point that is not settled (a, at
#: x, y); a settled point (a, at x, y) that shares a triangle with a point b which may not be.
SURE, LARGE, OPEN, LINK = range(4)


def _stars(size: float, reach: float, last: bool) -> Callable:
    """The kernel of a cell: its own points' triangles, from all points of the cell and its halo."""

    def per_cell(key: tuple, rows: pa.Table) -> pa.Table:
        ids, x, y = rows["id"].combine_chunks(), rows["x"].to_numpy(), rows["y"].to_numpy()
        own, is_open = (rows[c].to_numpy(zero_copy_only=False) for c in ("own", "open"))
        rank = np.empty(len(x), dtype=np.int64)
        rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(x))
        low, high = ([(k.as_py() + d) * size for k in key] for d in (-HALO, 1 + HALO))
        settled, parts = np.zeros(len(x), dtype=bool), []
        mine, step = np.flatnonzero(own), max(1, BLOCK // max(1, len(x)))
        for k in range(0, len(mine) if len(x) > 1 else 0, step):
            p = mine[k : k + step]
            ex, ey = x[None, :] - x[p, None], y[None, :] - y[p, None]
            far = ex * ex + ey * ey
            far[np.arange(len(p)), p] = np.inf
            begin = far.argmin(axis=1)
            side, circle, closed = _round(ex, ey, begin, rank)
            if last and not closed.all():  # the outline: also to the right, as in a mirror
                (edge,) = np.nonzero(~closed)
                more, mirrored, _ = _round(ex[edge], -ey[edge], begin[edge], rank)
                side = np.concatenate([side, np.stack([edge[more[:, 0]], more[:, 2], more[:, 1], more[:, 3]], axis=1)])
                circle = np.concatenate([circle, mirrored * [1, -1, 1]])
            q, r = p[side[:, 0]], circle[:, 2] * (1 + 1e-6)
            cx, cy = x[q] + circle[:, 0], y[q] + circle[:, 1]
            slack = 1e-9 * (size + np.abs(x[q]) + np.abs(y[q]))
            within = (cx - r > low[0] + slack) & (cx + r < high[0] - slack) & (cy - r > low[1] + slack) & (cy + r < high[1] - slack)
            settled[p] = closed & (np.bincount(side[~within, 0], minlength=len(p)) == 0)
            parts.append((q, side[:, 1], side[:, 2], side[:, 3], cx, cy, circle[:, 2], within))
        q, u, w, least, cx, cy, r, within = (np.concatenate(c) for c in zip(*parts)) if parts else [np.zeros(0, dtype=np.int64)] * 7 + [np.zeros(0, dtype=bool)]
        short = lambda a, b: (x[a] - x[b]) ** 2 + (y[a] - y[b]) ** 2 <= reach * reach
        # of a triangle's corners, the one with the smallest id gives it, when it is settled
        gives = (rank[q] < least) & (settled[q] | last) & short(q, u) & short(u, w) & short(w, q)
        links = settled[q] & is_open[u] & ~settled[u]
        rest = own & ~settled
        if last:
            links, rest = np.zeros_like(links), np.zeros_like(rest)
        out = [(np.where(within[gives], SURE, LARGE), q[gives], u[gives], w[gives], cx[gives], cy[gives], r[gives])]
        (o,), f = np.nonzero(rest), q[links]
        out.append((np.full(len(o), OPEN), o, o, o, x[o], y[o], np.zeros(len(o))))
        out.append((np.full(len(f), LINK), f, u[links], f, x[f], y[f], np.zeros(len(f))))
        kind, a, b, c, cx, cy, r = (np.concatenate(c) for c in zip(*out))
        return pa.table({"kind": kind.astype(np.int32), "a": ids.take(pa.array(a)), "b": ids.take(pa.array(b)), "c": ids.take(pa.array(c)), "x": cx, "y": cy, "r": r})

    return per_cell


def _halvings(p: DataFrame, largest: float, most: int) -> int:
    """How often the ``largest`` cell is halved until none has more than ``CELL_POINTS`` of the points, ``most`` at most."""
    fits = lambda k: (p.groupBy(*(F.floor(F.col(c) / (largest / 2**k)) for c in "xy")).count().agg(F.max("count")).head()[0] or 0) <= CELL_POINTS
    low, high = -1, 0
    while high < most and not fits(high):
        low, high = high, min(most, 2 * high + 1)
    while high - low > 1:
        k = (low + high) // 2
        low, high = (low, k) if fits(k) else (k, high)
    return high


def triangles(points: DataFrame, reach: float, key: str = "point_id") -> DataFrame:
    """``a, b, c`` (counter-clockwise, ``a`` the smallest id) of the Delaunay triangles without a side longer than ``reach``.

    Of points at one place the smallest id counts; points without a place do not. Where more than three points lie on an
    empty circle (to ``SAME``), they are cut as a fan from the smallest id, so that the result depends on the points alone.
    Work grows with the number of points, whatever their density; what goes on to larger cells is points along gaps and the
    outline, where it grows with the square of such points in a cell.
    """
    if not 0 < reach < float("inf"):
        raise ValueError("reach must be positive")
    placed = points.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < 1e300" for c in "xy"))
    p = graph.cut(placed.groupBy("x", "y").agg(F.min(key).alias("id")).select("id", "x", "y"))
    kind = p.schema["id"].dataType.simpleString()
    largest, links, sure = LARGEST * reach, None, []
    known, halvings = p.withColumn("open", F.lit(True)), _halvings(p, LARGEST * reach, HALVINGS)
    while True:
        size = largest / 2**halvings
        at, cells = (lambda c: F.col(c) / size), lambda c: F.explode(F.sequence(F.floor(F.col(c) / size - HALO), F.floor(F.col(c) / size + HALO)))
        dealt = known.select("*", cells("x").alias("i")).select("*", cells("y").alias("j"))
        dealt = dealt.withColumn("own", F.col("open") & (F.col("i") == F.floor(at("x"))) & (F.col("j") == F.floor(at("y"))))
        found = graph.cut(dealt.groupBy("i", "j").applyInArrow(_stars(size, reach, not halvings), f"kind int, a {kind}, b {kind}, c {kind}, x double, y double, r double"))
        sure.append(found.where(F.col("kind") == SURE).select("a", "b", "c"))
        if not halvings:
            break
        rest = found.where(F.col("kind") == OPEN).select(F.col("a").alias("id"), "x", "y", F.lit(True).alias("open"))
        new = found.where(F.col("kind") == LINK).select("a", "b", "x", "y")
        links = graph.cut((new if links is None else links.unionByName(new)).join(rest.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b", "x", "y"))
        known = graph.cut(rest.unionByName(links.select(F.col("a").alias("id"), "x", "y", F.lit(False).alias("open")).distinct()))
        halvings = _halvings(known, largest, halvings - 1)
    for part in sure[1:]:
        sure[0] = sure[0].unionByName(part)
    return sure[0].unionByName(empty_circles(graph.cut(found.where(F.col("kind") == LARGE).drop("kind")), p).select("a", "b", "c"))


def empty_circles(circles: DataFrame, points: DataFrame) -> DataFrame:
    """The ``circles`` (x, y, r, and columns that tell them apart) that no point (x, y) lies in, those on the line aside.

    Cells are quartered twice a step, until those that the circles' lines cross have few points, which are then compared.
    """
    n = circles.count()
    if not n:
        return circles
    circles = graph.cut(circles.withColumn("_c", F.monotonically_increasing_id()))
    low_x, low_y, high_x, high_y = points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).head()
    extent = max(high_x - low_x, high_y - low_y) * (1 + 1e-9)
    at = lambda c, low: F.floor((F.col(c) - low) / extent * 2**LEVELS).cast("long")
    placed = points.select(at("x", low_x).alias("i"), at("y", low_y).alias("j"), F.col("x").alias("px"), F.col("y").alias("py"))
    inner = F.col("r") * (1 - 1e-9)

    def span(c: str, k: str, low: float, size: float) -> tuple[Column, Column]:
        """The least and the greatest distance along an axis from the center to a cell, to a rounding."""
        a, b = F.col(c) - (low + F.col(k) * size), (low + (F.col(k) + 1) * size) - F.col(c)
        return F.greatest(-a - size * 1e-9, -b - size * 1e-9, F.lit(0.0)), F.greatest(a, b) + size * 1e-9

    quarters = F.explode(F.array(*(F.struct(F.lit(a).cast("long").alias("i"), F.lit(b).cast("long").alias("j")) for a in range(4) for b in range(4)))).alias("k")
    full, left = None, circles.select("*", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
    for level in range(2, LEVELS + 1, 2):
        size, by = extent / 2**level, LEVELS - level
        to = [F.shiftright(c, by).alias(c) for c in "ij"]
        occupied = placed.groupBy(*to).agg(F.count("*").alias("_n"))
        open_ = left.select("*", quarters).select(*(c for c in left.columns if c not in "ij"), (4 * F.col("i") + F.col("k.i")).alias("i"), (4 * F.col("j") + F.col("k.j")).alias("j"))
        (near_x, far_x), (near_y, far_y) = span("x", "i", low_x, size), span("y", "j", low_y, size)
        met = open_.where(F.sqrt(near_x * near_x + near_y * near_y) < inner).join(F.broadcast(occupied) if level <= 8 else occupied, ["i", "j"])
        met = graph.cut(met.withColumn("_in", F.sqrt(far_x * far_x + far_y * far_y) < inner))
        hit = met.where("_in").select("_c").distinct()
        full = hit if full is None else full.unionByName(hit)
        left = met.join(hit, "_c", "left_anti")
        volume = left.agg(F.sum("_n")).head()[0] or 0
        left = left.drop("_n", "_in")
        if volume <= max(LEAST_DIRECT, DIRECT * n):
            break
    px, py = F.col("px") - F.col("x"), F.col("py") - F.col("y")
    last = left.join(placed.select(*to, "px", "py"), ["i", "j"])
    full = full.unionByName(last.where(F.sqrt(px * px + py * py) < inner).select("_c"))
    return circles.join(full.distinct(), "_c", "left_anti").drop("_c")


@dataclass
class Surface:
    """``nodes`` (vid, x, y, z and labels, if any) and ``triangles`` (mesh_id, tid, a, b, c by vid)."""

    nodes: DataFrame
    triangles: DataFrame


def tri_surface(points: DataFrame, azimuth_deg: float, xinc: float, yinc: float, labels: DataFrame | None = None, refused: DataFrame | None = None, max_link: float = DEFAULT_LINK, max_bridge: float | None = None, least_island: int = 8, key: str = "point_id") -> Surface:
    """Points (``key, x, y, z``) as a triangulated surface over a lattice's axes and steps.

    Lengths are in cells along the lattice's axes. A side is kept up to ``max_link`` (between a cell's diagonal and two
    cells) unless its ends are labelled (``labels``: key, block, i, j) in different blocks or not as neighbours, or are a
    ``refused`` pair (p, q); up to ``max_bridge``, if given, every side is. Triangles with three kept sides stay, without
    islands of fewer than ``least_island``. Nodes that no triangle has are left out.
    """
    if not LEAST_LINK < max_link < MOST_LINK:
        raise ValueError("max_link must lie between the diagonal of a cell and two cells")
    if max_bridge is not None and not max_link <= max_bridge < float("inf"):
        raise ValueError("max_bridge must be at least max_link")
    c, s = cos(radians(azimuth_deg)), sin(radians(azimuth_deg))
    turned = points.select(F.col(key).alias("vid"), ((F.col("x") * c + F.col("y") * s) / xinc).alias("x"), ((F.col("y") * c - F.col("x") * s) / yinc).alias("y"))
    found = graph.cut(triangles(turned, max_bridge or max_link, "vid"))
    sides = found.select("a", "b", "c", F.inline(F.array(*(F.struct(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")) for u, v in ("ab", "bc", "ca")))))
    known = turned.select("vid", "x", "y")
    if labels is not None:
        known = known.join(labels.select(F.col(key).alias("vid"), "block", "i", "j"), "vid", "left")
    else:
        known = known.selectExpr("*", "cast(null AS long) AS block", "cast(null AS long) AS i", "cast(null AS long) AS j")
    for end in "uv":
        sides = sides.join(known.select(F.col("vid").alias(end), F.struct("x", "y", "block", "i", "j").alias(f"_{end}")), end)
    d = lambda k: F.col(f"_u.{k}") - F.col(f"_v.{k}")
    d2 = d("x") * d("x") + d("y") * d("y")
    adjacent = (F.col("_u.block") == F.col("_v.block")) & (F.greatest(F.abs(d("i")), F.abs(d("j"))) == 1)
    ok = (d2 <= max_link * max_link) & F.coalesce(adjacent, F.lit(True))
    if refused is not None:
        no = refused.select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v"), F.lit(True).alias("_no")).distinct()
        sides = sides.join(no, ["u", "v"], "left")
        ok = ok & F.col("_no").isNull()
    if max_bridge is not None:
        ok = ok | (d2 <= max_bridge * max_bridge)
    kept = sides.groupBy("a", "b", "c").agg(F.every(ok).alias("ok")).where("ok").select(F.lit(0).alias("mesh_id"), F.struct("a", "b", "c").alias("tid"), "a", "b", "c")
    kept = graph.cut(mesh.islands(graph.cut(kept), least_island))
    used = kept.select(F.explode(F.array("a", "b", "c")).alias("vid")).distinct()
    nodes = points.withColumnRenamed(key, "vid").join(used, "vid", "left_semi")
    return Surface(nodes if labels is None else nodes.join(labels.select(F.col(key).alias("vid"), "block", "i", "j"), "vid", "left"), kept)
