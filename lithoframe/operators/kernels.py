"""Per-object numerics that no relational plan expresses, as small grouped kernels: scale comes from many objects."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph

#: Force on a node, relative to the range of values, at which a surface counts as solved, and the most steps for it.
TOLERANCE, STEPS = 1e-10, 200_000


def _biharmonic(z: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The surface of least squared curvature through the held nodes, by conjugate gradients; edges are free.

    Curvature is the sum of squared second differences along and across (twice); ``z`` is where free nodes start.
    """
    z = z.astype(float)
    scale = max(float(np.ptp(z[held])) if held.any() else 0.0, 1e-12)

    def forces(v: np.ndarray) -> np.ndarray:
        g = np.zeros_like(v)
        for x, out in ((v, g), (v.T, g.T)):
            d = x[2:] - 2 * x[1:-1] + x[:-2]
            out[2:] += d
            out[1:-1] -= 2 * d
            out[:-2] += d
        c = 2 * (v[1:, 1:] - v[1:, :-1] - v[:-1, 1:] + v[:-1, :-1])
        g[1:, 1:] += c
        g[1:, :-1] -= c
        g[:-1, 1:] -= c
        g[:-1, :-1] += c
        g[held] = 0.0
        return g

    left = -forces(z)
    step, size = left, float((left * left).sum())
    for _ in range(STEPS):
        if np.abs(left).max() <= TOLERANCE * scale:
            return z
        pull = forces(step)
        by = size / float((step * pull).sum())
        z += by * step
        left = left - by * pull
        size, before = float((left * left).sum()), size
        step = left + size / before * step
    raise ArithmeticError(f"no surface within {STEPS} steps: the largest force left is {np.abs(left).max()}")


def min_curvature_grid(points: DataFrame, g: dict, key: str = "surface_id") -> DataFrame:
    """``key, i, j, z`` of each point set gridded on one geometry; points snap to nodes (several: their mean) and are held."""
    from ..functions.scalars import xy_to_ij

    fi, fj = xy_to_ij(F.col("x"), F.col("y"), g)
    at = points.where("z IS NOT NULL").withColumns({"i": F.round(fi).cast("int"), "j": F.round(fj).cast("int")})
    at = at.where((F.col("i") >= 0) & (F.col("i") < g["ncol"]) & (F.col("j") >= 0) & (F.col("j") < g["nrow"])).groupBy(key, "i", "j").agg(F.avg("z").alias("z"))
    n, m = g["ncol"], g["nrow"]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        z, held = np.full((n, m), float(pdf["z"].mean())), np.zeros((n, m), dtype=bool)
        z[pdf["i"], pdf["j"]], held[pdf["i"], pdf["j"]] = pdf["z"], True
        z = _biharmonic(z, held)
        i, j = np.meshgrid(np.arange(n, dtype=np.int32), np.arange(m, dtype=np.int32), indexing="ij")
        return pd.DataFrame({key: pdf[key].iloc[0], "i": i.ravel(), "j": j.ravel(), "z": z.ravel()})

    kind = dict(points.dtypes)[key]
    return at.groupBy(key).applyInPandas(solve, f"{key} {kind}, i int, j int, z double")


def chain(segments: pd.DataFrame) -> list[list[tuple[float, float]]]:
    """Polylines from segments: those from odd ends first, then closed loops, in order of coordinates."""
    ends: dict[tuple, list[int]] = {}
    seg = [((a, b), (c, d)) for a, b, c, d in segments[["x1", "y1", "x2", "y2"]].round(9).itertuples(index=False, name=None)]
    seg = sorted({tuple(sorted(s)) for s in seg if s[0] != s[1]})
    for k, (u, v) in enumerate(seg):
        ends.setdefault(u, []).append(k)
        ends.setdefault(v, []).append(k)
    used = [False] * len(seg)
    out = []
    for start in [*sorted(p for p, s in ends.items() if len(s) % 2), *sorted(ends)]:
        while any(not used[k] for k in ends[start]):
            line, at = [start], start
            while (k := next((k for k in ends[at] if not used[k]), None)) is not None:
                used[k] = True
                at = seg[k][1] if seg[k][0] == at else seg[k][0]
                line.append(at)
                if at == start:
                    break
            out.append(line)
    return out


def simplify(line: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Douglas-Peucker; ends stay, rings keep their closure and at least four points."""
    if tolerance <= 0 or len(line) < 3:
        return line
    p = np.array(line)
    keep = np.zeros(len(p), dtype=bool)
    keep[[0, -1]] = True
    ring = len(line) > 3 and line[0] == line[-1]
    if ring:
        keep[int(((p - p[0]) ** 2).sum(axis=1).argmax())] = True
    marks = np.flatnonzero(keep)
    todo = list(zip(marks[:-1], marks[1:], strict=True))
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = p[b] - p[a]
        q = p[a + 1 : b] - p[a]
        length = float(np.hypot(*d))
        off = np.abs(d[0] * q[:, 1] - d[1] * q[:, 0]) / length if length else np.hypot(q[:, 0], q[:, 1])
        k = int(off.argmax())
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    short = [x for x, good in zip(line, keep, strict=True) if good]
    return line if ring and len(short) < 4 else short


def _pieces(segments: DataFrame, key: str) -> DataFrame:
    """``key, piece_x, piece_y, x1, y1, x2, y2``: segments (undirected, once) with the smallest point that they are linked to."""
    at = lambda k: F.struct(F.col(key).alias("key"), F.round(f"x{k}", 9).alias("x"), F.round(f"y{k}", 9).alias("y"))
    links = segments.select(F.least(at(1), at(2)).alias("u"), F.greatest(at(1), at(2)).alias("v")).where("u <> v").distinct()
    links = graph.cut(links)
    own = links.join(graph.components(links), F.col("u") == F.col("node"))
    ends = (F.col(f"{e}.{c}").alias(f"{c}{k}") for k, e in ((1, "u"), (2, "v")) for c in "xy")
    return own.select(F.col("u.key").alias(key), F.col("component.x").alias("piece_x"), F.col("component.y").alias("piece_y"), *ends)


def _chained(pieces: DataFrame, key: str, name: str, tolerance: float = 0.0) -> DataFrame:
    def per_piece(pdf: pd.DataFrame) -> pd.DataFrame:
        own = tuple(pdf[[key, "piece_x", "piece_y"]].iloc[0])
        rows = [(*own, n, k, x, y) for n, line in enumerate(chain(pdf)) for k, (x, y) in enumerate(simplify(line, tolerance))]
        return pd.DataFrame(rows, columns=[key, "piece_x", "piece_y", name, "seq", "x", "y"]).astype({name: "int32", "seq": "int32"})

    kind = dict(pieces.dtypes)[key]
    return pieces.groupBy(key, "piece_x", "piece_y").applyInPandas(per_piece, f"{key} {kind}, piece_x double, piece_y double, {name} int, seq int, x double, y double")


def contour_lines(segments: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """``level, piece_x, piece_y, line, seq, x, y`` from contour segments, a group for each connected piece of a level.

    A piece is named by its smallest point; its lines are numbered, those from odd ends first, then closed ones.
    """
    return _chained(_pieces(segments, "level"), "level", "line", tolerance)


def boundary_rings(directed: DataFrame, mesh: str = "mesh_id") -> DataFrame:
    """Rings of each mesh from boundary edges ``mesh, x1, y1, x2, y2``: ``mesh, piece_x, piece_y, ring, seq, x, y``, as :func:`contour_lines`."""
    return _chained(_pieces(directed, mesh), mesh, "ring")
