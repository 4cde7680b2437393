"""Triangulations and lattice topology against brute force and against labels known from construction."""

import itertools
import math
import random
from fractions import Fraction

import pytest

from lithoframe.operators import delaunay, graph, grid, topology, zones

SCHEMA = "point_id long, x double, y double, z double"


def inside(a, b, c, d):
    """Whether d lies in the circle of a, b, c, which turn left; exact."""
    rows = [(Fraction(p[0]) - Fraction(d[0]), Fraction(p[1]) - Fraction(d[1])) for p in (a, b, c)]
    (ax, ay, a2), (bx, by, b2), (cx, cy, c2) = ((x, y, x * x + y * y) for x, y in rows)
    return ax * (by * c2 - b2 * cy) - ay * (bx * c2 - b2 * cx) + a2 * (bx * cy - by * cx) > 0


def brute(pts, reach):
    """Delaunay triangles (smallest id first, counter-clockwise) without a side over ``reach``: empty circles of all triples."""
    out = set()
    for a, b, c in itertools.combinations(sorted(pts), 3):
        (ax, ay), (bx, by), (cx, cy) = pts[a], pts[b], pts[c]
        if max(math.dist(pts[u], pts[v]) for u, v in ((a, b), (b, c), (a, c))) > reach:
            continue
        d = 2 * ((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))
        if d:
            b, c = (b, c) if d > 0 else (c, b)
            if not any(inside(pts[a], pts[b], pts[c], q) for k, q in pts.items() if k not in (a, b, c)):
                out.add((a, b, c))
    return out


def frame(spark, pts):
    return spark.createDataFrame([(k, float(x), float(y), float(k)) for k, (x, y) in pts.items()], SCHEMA)


@pytest.mark.parametrize("reach", [1.2, 6.0])
def test_triangles(spark, reach):
    # clusters, a gap and a nearly straight row, so that slivers and large circles occur
    rng = random.Random(3)
    pts = {k: (rng.random() * 8, rng.random() * 4) for k in range(40)} | {40 + k: (k / 2, -3 + rng.random() * 1e-3) for k in range(12)}
    got = [tuple(r) for r in delaunay.triangles(frame(spark, pts), reach).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(pts, reach)


def test_triangles_of_dense_points(spark, monkeypatch):
    # all points lie within reach of each other: what is stored grows with the points, not with their pairs
    rng, rows, cut = random.Random(5), [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: rows.append((stored := cut(df)).count()) or stored)
    pts = {k: (rng.random(), rng.random()) for k in range(600)}
    got = [tuple(r) for r in delaunay.triangles(frame(spark, pts), 2.0).collect()]
    sides = {frozenset(e) for a, b, c in got for e in ((a, b), (b, c), (a, c))}
    assert len(got) == len(set(got)) and len(pts) - len(sides) + len(got) == 1 and sum(rows) < 60 * len(pts)


def test_triangles_by_cells(spark, monkeypatch):
    # cells so small that points are settled in several rounds; a clump far denser than the rest
    monkeypatch.setattr(delaunay, "CELL_POINTS", 8)
    rng = random.Random(7)
    pts = {k * 37 % 71: (4 + rng.random() * 1e-2, 4 + rng.random() * 1e-2) if k < 30 else (rng.random() * 8, rng.random() * 8) for k in range(71)}
    got = [tuple(r) for r in delaunay.triangles(frame(spark, pts), 1.5).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(pts, 1.5)


def test_triangles_of_nearly_one_circle(spark):
    # trapezoids off their circle by ever more: whichever way one is cut, all four corners must agree on it
    rng, pts = random.Random(2), {}
    for k in range(60):
        corners = [(0, 0), (10, 0), (5.5 + 10 ** (-10 + k / 10), 1), (4.5, 1)]
        pts |= {4 * k + i: (1000.0 * k + x, y) for i, (x, y) in zip(rng.sample(range(4), 4), corners)}
    got = [tuple(sorted(r)) for r in delaunay.triangles(frame(spark, pts), 15.0).collect()]
    assert len(set(got)) == len(got) and sorted(t[0] // 4 for t in got) == sorted(2 * list(range(60)))


def test_triangles_of_a_lattice(spark):
    # corners of a cell are on one circle: each cell is two triangles, fanned from its smallest id
    c, s = math.cos(0.5), math.sin(0.5)
    pts = {j * 9 + i: (3 + i * c - j * s, 5 + i * s + j * c) for i in range(9) for j in range(7)}
    df = frame(spark, pts | {1000: pts[12]}).unionByName(spark.createDataFrame([(2000, None, 1.0, 1.0), (2001, float("nan"), 1.0, 1.0)], SCHEMA))
    got = {tuple(r) for r in delaunay.triangles(df, 1.8).collect()}
    assert got == {t for j in range(6) for i in range(8) for k in [j * 9 + i] for t in ((k, k + 1, k + 10), (k, k + 10, k + 9))}
    assert delaunay.triangles(df.limit(0), 1.8).count() == 0
    with pytest.raises(ValueError):
        delaunay.triangles(df, 0)


def bent(ncol, nrow):
    """A lattice of swelling, bent cells, turned, without its far corner."""
    for j in range(nrow):
        for i in range(ncol):
            if i < ncol - 2 or j < nrow - 2:
                u, v = 50 * i * (1 + 0.004 * i), 50 * j + 0.007 * i * i
                yield i, j, (1000 + u * math.cos(0.5) - v * math.sin(0.5), 2000 + u * math.sin(0.5) + v * math.cos(0.5))


def test_topology_of_one_block(spark):
    known = {100 * i + j: (i, j, p) for i, j, p in bent(14, 9)}
    found = topology.detect(frame(spark, {k: p for k, (_, _, p) in known.items()}))
    report = found.report.head()
    assert report["verified"] and report["blocks"] == 1 and report["distinct_nodes"] == len(known) and report["azimuth_deg"] == pytest.approx(math.degrees(0.5), abs=1)
    # axes may be taken either way round
    got = {r["point_id"]: (r["column"] - 1, r["row"] - 1) for r in found.labelled().collect()}
    assert got == {k: (i, j) for k, (i, j, _) in known.items()}
    assert found.refused.count() == 0 and found.conflicts.count() == 0


def test_topology_of_fault_blocks(spark):
    # the right half is thrown by half a cell, so no link leads over the fault
    pts = {100 * i + j: (10.0 * i, 10.0 * j + (5.0 if i >= 6 else 0.0)) for i in range(12) for j in range(8)}
    found = topology.detect(frame(spark, pts))
    report = found.report.head()
    assert not report["verified"] and found.labelled() is None and report["blocks"] == 2 and report["largest_block"] == 48
    assert {(r["point_id"], r["block"], r["i"], r["j"]) for r in found.nodes.collect()} == {(k, 0 if k < 600 else 600, k // 100 % 6, k % 100) for k in pts}
    # across the fault nothing lies straight on, but for bridges along the seam, which a triangulation must not make
    surface = delaunay.tri_surface(frame(spark, pts), report["azimuth_deg"], report["cell_i"], report["cell_j"], found.nodes.select("point_id", "block", "i", "j"), found.refused)
    side = {(r["a"] // 600, r["b"] // 600, r["c"] // 600) for r in surface.triangles.collect()}
    assert side == {(0, 0, 0), (1, 1, 1)} and surface.triangles.count() == 2 * 2 * 5 * 7 and surface.nodes.count() == len(pts)
    bridged = delaunay.tri_surface(frame(spark, pts), 0.0, 10.0, 10.0, found.nodes.select("point_id", "block", "i", "j"), found.refused, max_bridge=1.9)
    assert bridged.triangles.count() > 140
    for wrong in ({"max_link": 1.2}, {"max_link": 2.5}, {"max_bridge": 1.0}):
        with pytest.raises(ValueError):
            delaunay.tri_surface(frame(spark, pts), 0.0, 10.0, 10.0, **wrong)


def test_topology_gates(spark):
    pts = {k: (10.0 * (k % 6), 10.0 * (k // 6)) for k in range(36)}
    df = frame(spark, pts)
    twice = df.unionByName(df.where("point_id = 7")).unionByName(df.where("point_id = 8").selectExpr("point_id + 100 AS point_id", "x", "y", "z + 1 AS z"))
    report = topology.detect(twice).report.head()
    assert (report["coincident_dropped"], report["coincident_ambiguous"], report["blocks"], report["verified"]) == (1, 1, 1, False)
    with pytest.raises(ValueError):
        topology.detect(df.limit(3))
    with pytest.raises(ValueError):
        topology.detect(df, nominal=-1.0)


def test_placed_components(spark, monkeypatch):
    # a snake through a grid, cut in two; steps add up, and a star is dealt
    monkeypatch.setattr(graph, "LEAST_HOT", 20)
    rng, links = random.Random(1), []
    places = {k: (rng.randrange(100), rng.randrange(100)) for k in range(200)}
    for k in range(1, 200):
        other = k - 1 if k < 100 else 100
        if k != 100:
            links.append((k, other, places[other][0] - places[k][0], places[other][1] - places[k][1]))
    got = {r["node"]: (r["component"], r["di"], r["dj"]) for r in graph.placed(spark.createDataFrame(links, "u long, v long, di long, dj long"), ["di", "dj"]).collect()}
    root = lambda k: 0 if k < 100 else 100
    assert got == {k: (root(k), places[k][0] - places[root(k)][0], places[k][1] - places[root(k)][1]) for k in places}
    assert {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "u long, v long, di long, dj long")).collect()} == {k: root(k) for k in places}


def test_geometry_or_surface(spark):
    regular = frame(spark, {k: (10.0 * (k % 6), 10.0 * (k // 6)) for k in range(36)})
    kind, found = topology.geometry_or_surface(regular, 20.0)
    assert kind == "grid_geometry" and (found.head()["ncol"], found.head()["nrow"]) == (6, 6)
    assert grid.default_geometry(regular, 20.0)["xinc"] == pytest.approx(10.0)
    assert grid.from_points(regular, None, "nearest").count() == 36
    bent_ = frame(spark, {100 * i + j: p for i, j, p in bent(9, 7)})
    with pytest.warns(UserWarning, match="triangulated"):
        kind, found = topology.geometry_or_surface(bent_, 100.0)
    assert kind == "tri_surface" and found.triangles.count() > 80
    with pytest.raises(ValueError):
        topology.geometry_or_surface(bent_, 100.0, fallback="error")
    with pytest.raises(ValueError):
        grid.default_geometry(bent_, 100.0)


def test_picks(spark):
    rows = [("a", "Top", 0, 10.0, 9.0), ("a", "Mid", 1, 20.0, 19.0), ("a", "Low", 2, 30.0, 18.0)]
    z = spark.createDataFrame(rows, "bore_id string, name string, zone_ord int, top_md double, top_tvd double")
    assert [(r["seq"], r["name"], r["tvd"]) for r in zones.picks(z, ["top ", "LOW", "none"]).orderBy("seq").collect()] == [(0, "Top", 9.0), (1, "Low", 18.0)]
    with pytest.raises(Exception, match="not in order of depth at Low"):
        zones.picks(z).collect()
