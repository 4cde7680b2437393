"""Least-curvature surfaces by tiles against one dense solve and the solver of one task."""

import random

import numpy as np
import pytest

from lithoframe.operators import kernels, tiles

G = {"xori": 0.0, "yori": 0.0, "xinc": 1.0, "yinc": 1.0, "ncol": 30, "nrow": 22, "rotation_deg": 0.0, "yflip": False}


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(6)
    at = {(rng.randrange(30), rng.randrange(22)): rng.gauss(0, 10) for _ in range(40)}
    return at, spark.createDataFrame([(float(i), float(j), z) for (i, j), z in at.items()], "x double, y double, z double")


def dense(at):
    """The same energy as one matrix, solved directly."""
    n, m = G["ncol"], G["nrow"]
    matrix = np.stack([tiles.forces(e.reshape(n, m)).ravel() for e in np.eye(n * m)])
    held = np.array([(k // m, k % m) in at for k in range(n * m)])
    z = np.array([at.get((k // m, k % m), 0.0) for k in range(n * m)])
    z[~held] = np.linalg.solve(matrix[np.ix_(~held, ~held)], -matrix[np.ix_(~held, held)] @ z[held])
    return z.reshape(n, m)


def surface(df):
    out = np.full((G["ncol"], G["nrow"]), np.nan)
    for r in df.collect():
        out[r["i"], r["j"]] = r["z"]
    return out


def test_tiles(spark, data):
    at, points = data
    want = dense(at)
    one = surface(kernels.min_curvature_grid(points.selectExpr("0 AS surface_id", "*"), G))
    got, steps = tiles.min_curvature(points, G, side=10, overlap=5, coarse=4)
    z = surface(got)
    assert np.abs(one - want).max() < 1e-5 and np.abs(z - want).max() < 1e-6 and steps
    # a known surface leaves nothing to do, one that is nearly right less
    again, none = tiles.min_curvature(points, G, start=got, side=10, overlap=5)
    near = got.selectExpr("i", "j", "z + 1e-6 * sin(i) AS z")
    _, few = tiles.min_curvature(points, G, start=near, side=10, overlap=5)
    assert none == 0 and np.abs(surface(again) - z).max() == 0 and few < steps


def test_tiles_cases(spark, data):
    _, points = data
    assert tiles.min_curvature(points.limit(0), G)[0].count() == 0
    one, steps = tiles.min_curvature(points.limit(1), G, side=16, overlap=4, coarse=100)
    assert steps == 0 and len({r["z"] for r in one.collect()}) == 1 and one.count() == 660
    with pytest.raises(ValueError):
        tiles.min_curvature(points, G, side=4, overlap=4)
