"""Neighbours, lattices, contour pieces, blocks and layers against brute force."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lithoframe.operators import grid, kernels, lattice, mesh, spatial


def test_knn(spark):
    rnd = random.Random(5)
    pts = [(k, rnd.randint(0, 30) * 1.0, rnd.randint(0, 30) * 1.0) for k in range(200)] + [(900, 5000.0, 0.0), (901, None, 1.0)]
    qs = [(k, rnd.uniform(-50, 80), rnd.uniform(-50, 80)) for k in range(20)] + [(99, None, None), (98, float("nan"), 0.0)]
    p, q = spark.createDataFrame(pts, "point_id long, x double, y double"), spark.createDataFrame(qs, "query_id long, x double, y double")
    got = {(r["query_id"], r["rank"]): r["point_id"] for r in spatial.knn(p, q, 4, 3.0).collect()}
    want = {}
    for qid, qx, qy in qs[:20]:
        near = sorted(((((x - qx) ** 2 + (y - qy) ** 2) ** 0.5, k) for k, x, y in pts if x is not None))[:4]
        want |= {(qid, n): k for n, (_, k) in enumerate(near, 1)}
    assert got == want
    few = spatial.knn(p.limit(2), q.where("query_id = 0"), 4, 3.0)
    assert few.count() == 2 and spatial.knn(p.limit(0), q, 4, 3.0).count() == 0
    with pytest.raises(ValueError):
        spatial.knn(p, q, 0, 1.0)


def test_lattice_by_place(spark):
    pts = [(i * 10 + j, 100 + 3.0 * i, 50 + 7.0 * j) for i in range(6) for j in range(5) if (i, j) != (2, 2)]
    p = spark.createDataFrame(pts, "point_id long, x double, y double")
    got = lattice.infer_geometry_xy(p, 4.0).head()
    assert (got["xori"], got["yori"], got["xinc"], got["yinc"], got["ncol"], got["nrow"], got["fits"]) == (100, 50, 3, 7, 6, 5, True)
    off = p.withColumn("x", F.col("x") + F.when(F.col("point_id") == 33, 0.5).otherwise(0.0))
    assert not lattice.infer_geometry_xy(off, 4.0).head()["fits"]
    with pytest.raises(ValueError, match="four"):
        lattice.infer_geometry_xy(p.limit(3), 4.0)
    with pytest.raises(ValueError, match="two axes"):
        lattice.infer_geometry_xy(p.where("y = 50"), 4.0)
    steps = {r["axis"]: r["step"] for r in lattice.axis_steps(p, 0.0, 3.0, 4.0).collect()}
    assert steps == pytest.approx({0: 3.0, 1: 7.0})


def test_contour_pieces(spark):
    rnd = random.Random(3)
    seg = [(float(level), *a, *b) for level in (1, 2) for _ in range(60) for a in [(rnd.randint(0, 12), rnd.randint(0, 12))] for b in [(a[0] + 1, a[1]), (a[0], a[1] + 1)][rnd.randint(0, 1) :][:1]]
    df = spark.createDataFrame([tuple(map(float, s)) for s in seg], "level double, x1 double, y1 double, x2 double, y2 double")
    got = kernels.contour_lines(df).toPandas().sort_values(["level", "piece_x", "piece_y", "line", "seq"])
    sides = lambda lines: sorted(tuple(sorted(e)) for line in lines for e in zip(line[:-1], line[1:], strict=True))
    for level, own in got.groupby("level"):
        lines = [list(zip(x["x"], x["y"], strict=True)) for _, x in own.groupby(["piece_x", "piece_y", "line"])]
        whole = kernels.chain(pd.DataFrame([s[1:] for s in seg if s[0] == level], columns=["x1", "y1", "x2", "y2"]).astype(float))
        assert sides(lines) == sides(whole) and len(lines) == len(whole)
    rings = kernels.boundary_rings(df.withColumn("mesh_id", F.col("level").cast("int")))
    assert rings.count() == len(got) and "ring" in rings.columns
    assert kernels.contour_lines(df.limit(0)).count() == 0


def _corner(v, label):
    return (v, *(label or (None, None, None)))


def test_block_wireframe(spark):
    """Two blocks of 2 x 2 cells side by side, a fringe node without a label."""
    label = {b * 100 + i * 10 + j: (b, i - 1, j) for b in (0, 1) for i in range(3) for j in range(3)}
    tri = []
    for b in (0, 1):
        for i in range(2):
            for j in range(2):
                a, c = b * 100 + i * 10 + j, b * 100 + (i + 1) * 10 + j + 1
                tri += [(a, a + 10, c), (a, c, a + 1)]
    tri += [(20, 100, 21), (21, 100, 101), (21, 101, 22), (22, 101, 102), (2, 12, 500), (12, 22, 500)]
    rows = [(1, *(_corner(v, label.get(v)) for v in t)) for t in tri]
    at = "struct<vid: int, block: int, i: int, j: int>"
    df = spark.createDataFrame(rows, f"mesh_id int, a {at}, b {at}, c {at}")
    count: dict = {}
    for t in tri:
        for e in zip(t, (*t[1:], t[0]), strict=True):
            count[tuple(sorted(e))] = count.get(tuple(sorted(e)), 0) + 1

    def keeps(u, v, n, k):
        a, b = label.get(u), label.get(v)
        same = a and b and a[0] == b[0]
        di, dj = (abs(a[1] - b[1]), abs(a[2] - b[2])) if same else (None, None)
        if n == 2 and (di, dj) == (1, 1):
            return False
        if n == 1 or not same:
            return True
        return a[2] % k == 0 if (di, dj) == (1, 0) else a[1] % k == 0 if (di, dj) == (0, 1) else True

    for k in (1, 2):
        got = {(r["u"], r["v"]) for r in mesh.wireframe_blocks(df, k).collect()}
        assert got == {e for e, n in count.items() if keeps(*e, n, k)}
    flat = df.select("mesh_id", F.monotonically_increasing_id().alias("tid"), *(F.col(f"{c}.vid").alias(c) for c in "abc"))
    far = spark.createDataFrame([(1, 10**15, 800, 801, 802)], flat.schema)
    assert mesh.islands(flat.union(far)).count() == len(tri)


def test_value_layer(spark):
    nodes = spark.createDataFrame([(i, j, float("nan") if (i, j) == (1, 1) else float(i * j)) for i in range(-2, 5) for j in range(5)], "i int, j int, z double")
    layer, triangles = mesh.value_layer(nodes, 2)
    got = layer.collect()
    assert len(got) == 12 and {(r["low"], r["high"]) for r in got} == {(-8.0, 16.0)} and triangles.count() == 2 * 3 * 2
    assert mesh.value_layer(nodes)[1].count() == 2 * (6 * 4 - 4)


G = {"xori": 10.0, "yori": 20.0, "xinc": 2.0, "yinc": 3.0, "ncol": 4, "nrow": 3, "rotation_deg": 0.0, "yflip": False}


def test_edges(spark):
    nodes = grid.constant(G, spark, 1.0)
    full = [(r["x"], r["y"]) for r in lattice.edge(nodes, G, "full").orderBy("seq").collect()]
    assert full == [(10, 20), (16, 20), (16, 26), (10, 26)]
    around = [(r["i"], r["j"]) for r in lattice.perimeter(grid.lift(nodes, G), 4, 3).orderBy("seq").collect()]
    assert around == [(0, 0), (1, 0), (2, 0), (3, 0), (3, 1), (3, 2), (2, 2), (1, 2), (0, 2), (0, 1)]
    traced = lattice.edge(nodes.where("NOT (i = 3 AND j = 2)"), G).orderBy("seq").collect()
    assert len(traced) == 11 and (traced[0]["x"], traced[0]["y"]) == (traced[-1]["x"], traced[-1]["y"]) and (14, 23) in {(r["x"], r["y"]) for r in traced}
    assert {(r["x"], r["y"]) for r in lattice.edge(nodes, G, "hull").collect()} == set(full)
    with pytest.raises(ValueError):
        lattice.edge(nodes, G, "other")


def test_lift_and_lanes(spark):
    wide = grid.constant(G, spark, 0.0).withColumns({"z": (F.col("i") * 10 + F.col("j")).cast("double"), "phi": F.when(F.col("i") > 0, F.col("j") / 10.0)})
    lifted = grid.lift(wide, G).withColumn("point_id", (F.col("i") * 100 + F.col("j")).cast("long"))
    back = {(r["i"], r["j"]): (r["z"], r["phi"]) for r in grid.resample_lanes(lifted, G, ["z", "phi"]).collect()}
    assert len(back) == 12 and all(z == i * 10 + j and phi == j / 10 for (i, j), (z, phi) in back.items())
    mesh_nodes = lifted.withColumnRenamed("point_id", "vid")
    by_label, by_place = (lattice.infer_grid(n, 3.0).head() for n in (mesh_nodes, mesh_nodes.withColumn("block", F.when(F.col("vid") > 0, 0))))
    for r in (by_label, by_place):
        assert (r["xori"], r["yori"], r["xinc"], r["yinc"], r["ncol"], r["nrow"], r["fits"]) == (10, 20, 2, 3, 4, 3, True)
    with pytest.raises(ValueError):
        grid.resample_lanes(lifted, G, [])
