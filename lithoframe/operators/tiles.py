"""Least-curvature surfaces of grids of any size, by tiles that exchange halos.

The energy is the one of ``kernels.min_curvature_grid``: squared second differences along and across, with data nodes held
and free edges. Its linear system is solved by conjugate gradients whose vectors are tables of tiles. A step costs three
exchanges of strips along tile edges and two sums that come to the driver: the force of the direction (two nodes of
halo), and, as preconditioner, exact solves of every tile with ``overlap`` nodes of its neighbours, added up where they
overlap. So no task holds more than one tile with its halo, and no tile waits for one far away but through the steps.
A start from a coarser lattice, or from a surface that is known, leaves less to do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import xy_to_ij
from . import graph, kernels

#: Nodes along a side of a tile and of the strips that neighbours solve for it, too.
SIDE, OVERLAP = 256, 16
#: Force on a node, relative to the range of values, at which a surface counts as solved.
TOLERANCE = 1e-10
_STATE = "ti int, tj int, ni int, nj int, held binary, x binary, r binary, p binary, q binary, z binary"
_WAYS = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]


def _array(data, ni: int, nj: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(ni, nj).copy()


def forces(v: np.ndarray) -> np.ndarray:
    """The gradient of half the energy at every node of an array with free edges."""
    g = np.zeros_like(v)
    for x, out in ((v, g), (v.T, g.T)):
        if len(x) > 2:
            d = x[2:] - 2 * x[1:-1] + x[:-2]
            out[2:] += d
            out[1:-1] -= 2 * d
            out[:-2] += d
    if min(v.shape) > 1:
        c = 2 * (v[1:, 1:] - v[1:, :-1] - v[:-1, 1:] + v[:-1, :-1])
        g[1:, 1:] += c
        g[1:, :-1] -= c
        g[:-1, 1:] -= c
        g[:-1, :-1] += c
    return g


def _solve(force: np.ndarray, held: np.ndarray, inner: tuple[slice, slice]) -> np.ndarray:
    """Displacements within ``inner`` under ``force``, all other nodes and held ones fast; by conjugate gradients."""
    fast = held.copy()
    mask = np.ones_like(fast)
    mask[inner] = False
    fast |= mask
    left = np.where(fast, 0.0, force)
    x, step, size = np.zeros_like(left), left, float((left * left).sum())
    goal = 1e-26 * size
    for _ in range(20 * left.size):
        if size <= goal or not size:
            break
        pull = forces(step)
        pull[fast] = 0.0
        by = size / float((step * pull).sum())
        x += by * step
        left = left - by * pull
        size, before = float((left * left).sum()), size
        step = left + size / before * step
    return x


def _exchange(state: DataFrame, lane: str, width: int, work, schema: str) -> DataFrame:
    """``work(row, extended, held, inner)`` of every tile, where lane and held of up to ``width`` nodes of its neighbours are around it."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                v, h = _array(getattr(r, lane), r.ni, r.nj), np.frombuffer(r.held, bool).reshape(r.ni, r.nj)
                rows = []
                for a, b in _WAYS:
                    if a == b == 0:
                        continue
                    s = tuple(slice(-width, None) if d > 0 else slice(0, width) if d < 0 else slice(None) for d in (a, b))
                    part = np.ascontiguousarray(v[s])
                    rows.append((r.ti + a, r.tj + b, -a, -b, *part.shape, part.tobytes(), np.ascontiguousarray(h[s]).tobytes()))
                yield pd.DataFrame(rows, columns=["ti", "tj", "a", "b", "pi", "pj", "strip", "fast"]).astype({c: "int32" for c in ("ti", "tj", "a", "b", "pi", "pj")})

    strips = state.select("ti", "tj", "ni", "nj", "held", lane).mapInPandas(send, "ti int, tj int, a int, b int, pi int, pj int, strip binary, fast binary")
    around = strips.groupBy("ti", "tj").agg(F.collect_list(F.struct("a", "b", "pi", "pj", "strip", "fast")).alias("around"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                found = {(s["a"], s["b"]): s for s in (r.around if r.around is not None else ())}
                grow = lambda d, side, found=found: next((s["pi" if d == 0 else "pj"] for k, s in found.items() if k[d] == side and k[1 - d] == 0), 0)
                low, high = [grow(d, -1) for d in (0, 1)], [grow(d, 1) for d in (0, 1)]
                v = np.zeros((low[0] + r.ni + high[0], low[1] + r.nj + high[1]))
                h = np.zeros(v.shape, bool)
                inner = (slice(low[0], low[0] + r.ni), slice(low[1], low[1] + r.nj))
                v[inner], h[inner] = _array(getattr(r, lane), r.ni, r.nj), np.frombuffer(r.held, bool).reshape(r.ni, r.nj)
                for (a, b), s in found.items():
                    at = tuple(slice(0, low[d]) if k < 0 else slice(low[d] + n, None) if k > 0 else inner[d] for d, k, n in ((0, a, r.ni), (1, b, r.nj)))
                    v[at], h[at] = np.frombuffer(s["strip"], np.float64).reshape(s["pi"], s["pj"]), np.frombuffer(s["fast"], bool).reshape(s["pi"], s["pj"])
                out.append(work(r, v, h, inner, low))
            if out:
                yield pd.DataFrame(out)

    return state.join(around, ["ti", "tj"], "left").mapInPandas(run, schema)


def _same(row, /, **new) -> dict:
    return {c: new.get(c, getattr(row, c)) for c in ("ti", "tj", "ni", "nj", "held", "x", "r", "p", "q", "z")}


def _local(state: DataFrame, work) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame([work(r) for r in batch.itertuples(index=False)])

    return state.mapInPandas(run, _STATE)


def _dot(state: DataFrame, a: str, b: str) -> tuple[float, float]:
    """The inner product of two lanes and the largest value of the first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = [(np.frombuffer(x, np.float64), np.frombuffer(y, np.float64)) for x, y in zip(batch[a], batch[b], strict=True)]
            yield pd.DataFrame({"dot": [float(x @ y) for x, y in both], "most": [float(np.abs(x).max(initial=0.0)) for x, _ in both]})

    found = state.select(F.col(a).alias("u"), F.col(b).alias("v")).withColumnsRenamed({"u": a, "v": b}) if a != b else state.select(a)
    dot, most = found.mapInPandas(run, "dot double, most double").agg(F.sum("dot"), F.max("most")).head()
    return dot or 0.0, most or 0.0


def _weighted(state: DataFrame, overlap: int) -> DataFrame:
    """``z``: the tiles' own solves for the force ``r``, with ``overlap`` nodes of their neighbours, added up."""

    def solve(r, v, h, inner, low):
        # the lattice goes on beyond the halo, where nothing moves: two nodes that stay fast
        pad = [(2 if low[d] else 0, 2 if v.shape[d] > low[d] + n else 0) for d, n in ((0, r.ni), (1, r.nj))]
        inside = tuple(slice(a, a + n) for (a, _), n in zip(pad, v.shape, strict=True))
        x = np.ascontiguousarray(_solve(np.pad(v, pad), np.pad(h, pad, constant_values=True), inside)[inside])
        return {"ti": r.ti, "tj": r.tj, "li": low[0], "lj": low[1], "ei": v.shape[0], "ej": v.shape[1], "ni": r.ni, "nj": r.nj, "w": x.tobytes()}

    solved = graph.cut(_exchange(state, "r", overlap, solve, "ti int, tj int, li int, lj int, ei int, ej int, ni int, nj int, w binary"))

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                w, rows = np.frombuffer(r.w, np.float64).reshape(r.ei, r.ej), []
                for a, b in _WAYS:
                    at = tuple(slice(0, k) if d < 0 else slice(k + n, None) if d > 0 else slice(k, k + n) for d, k, n in ((a, r.li, r.ni), (b, r.lj, r.nj)))
                    part = np.ascontiguousarray(w[at])
                    if part.size:
                        rows.append((r.ti + a, r.tj + b, -a, -b, *part.shape, part.tobytes()))
                yield pd.DataFrame(rows, columns=["ti", "tj", "a", "b", "pi", "pj", "part"]).astype({c: "int32" for c in ("ti", "tj", "a", "b", "pi", "pj")})

    sent = solved.mapInPandas(parts, "ti int, tj int, a int, b int, pi int, pj int, part binary").groupBy("ti", "tj").agg(F.collect_list(F.struct("a", "b", "pi", "pj", "part")).alias("parts"))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                z = np.zeros((r.ni, r.nj))
                for s in sorted(r.parts, key=lambda s: (s["a"], s["b"])):
                    # what a neighbour on the low side solved lies at the low edge
                    at = tuple(slice(0, n) if d < 0 else slice(-n, None) if d > 0 else slice(None) for d, n in ((s["a"], s["pi"]), (s["b"], s["pj"])))
                    z[at] += np.frombuffer(s["part"], np.float64).reshape(s["pi"], s["pj"])
                out.append(_same(r, z=z.tobytes()))
            if out:
                yield pd.DataFrame(out)

    return graph.cut(state.join(sent, ["ti", "tj"], "left").mapInPandas(add, _STATE))


def _force(state: DataFrame, lane: str, out: str, sign: float) -> DataFrame:
    """``out``: ``sign`` times the force of ``lane`` on free nodes."""

    def work(r, v, h, inner, low):
        g = forces(v)[inner] * sign
        g[h[inner]] = 0.0
        return _same(r, **{out: np.ascontiguousarray(g).tobytes()})

    return graph.cut(_exchange(state, lane, 2, work, _STATE))


def min_curvature(points: DataFrame, g: dict, start: DataFrame | None = None, side: int = SIDE, overlap: int = OVERLAP, coarse: int = 8, tolerance: float = TOLERANCE) -> tuple[DataFrame, int]:
    """``i, j, z`` of points (x, y, z) gridded with least curvature, and the number of steps that took.

    Points snap to nodes (several: their mean) and are held. ``start`` (i, j, z) is a surface to begin with; without one
    it is that of the points on a lattice ``coarse`` times as wide, in one task if that has at most ``side`` squared nodes
    and by tiles, from a coarser one again, if it has more. Three held nodes that are not in line fix the surface; fewer
    leave a start that is level. Points outside of the geometry do not count; without any there is no surface (no rows).
    """
    if side < 2 * overlap or overlap < 2:
        raise ValueError("a tile must be at least twice as wide as the overlap, which is at least two nodes")
    ncol, nrow = g["ncol"], g["nrow"]
    fi, fj = xy_to_ij(F.col("x"), F.col("y"), g)
    near = points.where("z IS NOT NULL").select(F.round(fi).cast("int").alias("i"), F.round(fj).cast("int").alias("j"), "z")
    held = graph.cut(near.where((F.col("i") >= 0) & (F.col("i") < ncol) & (F.col("j") >= 0) & (F.col("j") < nrow)).groupBy("i", "j").agg(F.avg("z").alias("z")))
    n, mean, low, high = held.agg(F.count("*"), F.avg("z"), F.min("z"), F.max("z")).head()
    spark = points.sparkSession
    if not n:
        return spark.createDataFrame([], "i int, j int, z double"), 0
    if start is None and min(ncol, nrow) > 2 * coarse:
        wide = {"xori": 0.0, "yori": 0.0, "xinc": float(coarse), "yinc": float(coarse), "ncol": -(-(ncol - 1) // coarse) + 1, "nrow": -(-(nrow - 1) // coarse) + 1, "rotation_deg": 0.0, "yflip": False}
        small = held.select(F.col("i").cast("double").alias("x"), F.col("j").cast("double").alias("y"), "z")
        if wide["ncol"] * wide["nrow"] <= side * side:
            rough = kernels.min_curvature_grid(small.withColumn("surface_id", F.lit(0)), wide).select("i", "j", "z")
        else:
            rough = min_curvature(small, wide, None, side, overlap, coarse, 1e-6)[0]
        start = _refined(rough, coarse, ncol, nrow)
    # tiles of about one size, none thinner than the overlap
    cut = lambda k: F.least(F.floor(F.col(k) / side), F.lit(max(({"i": ncol, "j": nrow}[k]) // side - 1, 0))).cast("int")
    known = held.select("i", "j", F.col("z").alias("v"), F.lit(True).alias("h"))
    if start is not None:
        known = start.where("z IS NOT NULL").select("i", "j", F.col("z").alias("v"), F.lit(False).alias("h")).join(held.select("i", "j"), ["i", "j"], "left_anti").unionByName(known)
    last = [max(m // side - 1, 0) for m in (ncol, nrow)]
    every = spark.range((last[0] + 1) * (last[1] + 1)).select((F.col("id") % (last[0] + 1)).cast("int").alias("ti"), F.expr(f"id div {last[0] + 1}").cast("int").alias("tj"))
    filled = known.withColumns({"ti": cut("i"), "tj": cut("j")}).groupBy("ti", "tj").agg(F.collect_list(F.struct("i", "j", "v", "h")).alias("nodes"))

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                i0, j0 = r.ti * side, r.tj * side
                ni, nj = (ncol - i0 if r.ti == last[0] else side), (nrow - j0 if r.tj == last[1] else side)
                x, h = np.full((ni, nj), mean), np.zeros((ni, nj), bool)
                for s in r.nodes if r.nodes is not None else ():
                    x[s["i"] - i0, s["j"] - j0], h[s["i"] - i0, s["j"] - j0] = s["v"], s["h"]
                none = np.zeros((ni, nj)).tobytes()
                out.append({"ti": r.ti, "tj": r.tj, "ni": ni, "nj": nj, "held": h.tobytes(), "x": x.tobytes(), "r": none, "p": none, "q": none, "z": none})
            if out:
                yield pd.DataFrame(out)

    state = graph.cut(every.join(filled, ["ti", "tj"], "left").mapInPandas(begin, _STATE))
    state = _force(state, "x", "r", -1.0)
    scale, steps, before = max(high - low, 1e-12), 0, None
    while _dot(state, "r", "r")[1] > tolerance * scale:
        state = _weighted(state, overlap)
        now = _dot(state, "r", "z")[0]
        turn = 0.0 if before is None else now / before
        state = _local(state, lambda r, turn=turn: _same(r, p=(np.frombuffer(r.z, np.float64) + turn * np.frombuffer(r.p, np.float64)).tobytes()))
        state = _force(state, "p", "q", 1.0)
        pull = _dot(state, "p", "q")[0]
        by = now / pull
        state = graph.cut(_local(state, lambda r, by=by: _same(r, x=(np.frombuffer(r.x, np.float64) + by * np.frombuffer(r.p, np.float64)).tobytes(), r=(np.frombuffer(r.r, np.float64) - by * np.frombuffer(r.q, np.float64)).tobytes())))
        before, steps = now, steps + 1

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                i, j = np.meshgrid(np.arange(r.ni, dtype=np.int32) + r.ti * side, np.arange(r.nj, dtype=np.int32) + r.tj * side, indexing="ij")
                yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "z": np.frombuffer(r.x, np.float64)})

    return state.select("ti", "tj", "ni", "nj", "x").mapInPandas(nodes, "i int, j int, z double"), steps


def _refined(rough: DataFrame, times: int, ncol: int, nrow: int) -> DataFrame:
    """A surface on a lattice ``times`` as fine, bilinear: each coarse cell gives the nodes in it."""
    corners = F.explode(F.array(*(F.struct((F.col("i") - a).alias("ci"), (F.col("j") - b).alias("cj"), F.lit(2 * a + b).alias("k")) for a in (0, 1) for b in (0, 1)))).alias("c")
    cells = rough.select(corners, "z").groupBy("c.ci", "c.cj").agg(*(F.max(F.when(F.col("c.k") == k, F.col("z"))).alias(f"z{k}") for k in range(4))).where("z0 IS NOT NULL AND z1 IS NOT NULL AND z2 IS NOT NULL AND z3 IS NOT NULL")
    inside = F.explode(F.sequence(F.lit(0), F.lit(times * times - 1))).alias("m")
    u, v = (F.col("m") % times) / times, F.floor(F.col("m") / times) / times
    z = (1 - u) * (1 - v) * F.col("z0") + (1 - u) * v * F.col("z1") + u * (1 - v) * F.col("z2") + u * v * F.col("z3")
    fine = cells.select("*", inside).select((F.col("ci") * times + F.col("m") % times).cast("int").alias("i"), (F.col("cj") * times + F.floor(F.col("m") / times)).cast("int").alias("j"), z.alias("z"))
    return fine.where((F.col("i") < ncol) & (F.col("j") < nrow))
