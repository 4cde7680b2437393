"""Hand-calculated cases and brute force for operators that SQL does not cover."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from lithoframe.functions import scalars
from lithoframe.operators import bores, grid, kernels, path, series, sets, spatial, zones
from lithoframe.plans import expressions as X


def test_survey(spark):
    s = spark.createDataFrame([("A", 0.0, 0.0, 0.0), ("A", 600.0, 0.0, 0.0), ("A", 900.0, 90.0, 90.0)], "bore_id string, md double, inc double, azi double")
    r = {x["md"]: x for x in path.positions(s, 1000.0, 2000.0, 18.5).collect()}
    assert -r[600.0]["z"] == pytest.approx(581.5, abs=1e-9)
    radius = 300 / (math.pi / 2)
    assert r[900.0]["x"] == pytest.approx(1000 + radius) and r[900.0]["y"] == pytest.approx(2000) and -r[900.0]["z"] == pytest.approx(581.5 + radius)
    mid = path.position_at(path.positions(s, 1000.0, 2000.0, 18.5), spark.createDataFrame([("A", 750.0), ("A", 600.0), ("A", 901.0)], "bore_id string, md double"))
    got = {x["md"]: x for x in mid.collect()}
    assert got[750.0]["x"] == pytest.approx(1000 + radius * (1 - math.cos(math.pi / 4))) and got[600.0]["x"] == 1000.0 and got[901.0]["x"] is None


def test_at_md_edges(spark):
    src = spark.createDataFrame([(1, 10.0, 1.0), (1, 20.0, None), (1, 30.0, 3.0), (2, 5.0, 7.0), (3, 0.0, 1.0), (3, 10.0, 2.0)], "bore_id int, md double, value double")
    to = spark.createDataFrame([(1, 30.0), (1, 10.0), (1, 9.0), (1, 31.0), (2, 5.0), (2, 6.0), (3, 0.0), (3, 5.0), (4, 1.0)], "bore_id int, md double")
    got = {(r["bore_id"], r["md"]): r["value"] for r in series.at_md(src, to, ["bore_id"]).collect()}
    assert got == {(1, 30.0): None, (1, 10.0): None, (1, 9.0): None, (1, 31.0): None, (2, 5.0): 7.0, (2, 6.0): None, (3, 0.0): 1.0, (3, 5.0): 1.5, (4, 1.0): None}
    exact = {(r["bore_id"], r["md"]): r["value"] for r in series.interpolate(src, to, ["bore_id"], "linear").collect()}
    assert exact[1, 30.0] == 3.0 and exact[1, 10.0] == 1.0


def test_zone_edges(spark):
    tops = spark.createDataFrame([(1, "A", 0, 0.0), (1, "B", 1, 10.0), (1, "C", 2, 10.0)], "bore_id int, name string, ord int, md double")
    td = spark.createDataFrame([(1, 20.0)], "bore_id int, td double")
    z = zones.zones_from_tops(tops, td)
    assert {(r["name"], r["top_md"], r["base_md"]) for r in z.collect()} == {("A", 0.0, 10.0), ("B", 10.0, 10.0), ("C", 10.0, 20.0)}
    s = spark.createDataFrame([(1, 10.0, 5.0), (1, 20.0, 6.0), (1, 0.0, None)], "bore_id int, md double, value double")
    assert {(r["md"], r["zone"]) for r in zones.clip(s, z).collect()} == {(10.0, "C"), (0.0, "A")}
    stats = {r["zone"]: (r["count"], r["sum"]) for r in zones.zone_stats(s, z).collect()}
    assert stats == {"A": (0, 0.0), "B": (0, 0.0), "C": (1, 5.0)}


def test_expressions():
    e = ((X.channel("a") + 1) / X.channel("b") > 2) & ~X.channel("c").is_null()
    assert X.from_dict(X.to_dict(e)) == e and X.channels(e) == {"a", "b", "c"}
    assert X.resolve("phie", ["PHI", "GR"]) == "PHI" and X.resolve("x", ["GR"], {"x": "gr"}) == "GR"
    with pytest.raises(KeyError, match="ambiguous"):
        X.resolve("phie", ["PHI", "EFFPHI"])


def test_hull_and_area(spark):
    rng = random.Random(1)
    pts = [(i, rng.randint(0, 20) * 1.0, rng.randint(0, 20) * 1.0) for i in range(200)] + [(900 + k, x, y) for k, (x, y) in enumerate([(0.0, 0.0), (20.0, 0.0), (20.0, 20.0), (0.0, 20.0)])]
    h = spatial.hull(spark.createDataFrame(pts, "point_id int, x double, y double")).orderBy("vseq").collect()
    assert [(r["x"], r["y"]) for r in h] == [(0.0, 0.0), (20.0, 0.0), (20.0, 20.0), (0.0, 20.0)]
    ring = spark.createDataFrame([(1, r["vseq"], r["x"], r["y"]) for r in h], "poly_id int, vseq int, x double, y double")
    assert spatial.polygon_area(ring).first()["area"] == 400.0
    inside = {r["point_id"] for r in spatial.inside(spark.createDataFrame(pts, "point_id int, x double, y double"), ring).collect()}
    assert inside == {i for i, x, y in pts if 0 < x < 20 and 0 < y < 20}


def test_strat_order(spark):
    picks = spark.createDataFrame(
        [(1, "Top", 1.0, 1), (1, "Mid", 2.0, 2), (1, "Sand", 2.0, 3), (1, "Lower", 3.0, 4), (2, "Top", 1.0, 5), (2, "Sand", 2.0, 6), (2, "Mid", 3.0, 7), (3, "Mid", 1.0, 8), (3, "Lower", 2.0, 9)], "well int, name string, md double, seq int"
    )
    assert sets.strat_order(picks) == ["Top", "Sand", "Mid", "Lower"]
    tied = picks.where("well = 1")
    assert sets.strat_order(tied, [("Sand", "Mid")]) == ["Top", "Sand", "Mid", "Lower"]


def test_min_curvature(spark):
    g = {"xori": 0.0, "yori": 0.0, "xinc": 1.0, "yinc": 1.0, "ncol": 7, "nrow": 6, "rotation_deg": 0.0}
    pts = [("plane", float(x), float(y), 2.0 * x - y) for x, y in ((0, 0), (6, 0), (0, 5), (6, 5), (3, 2))]
    z = kernels.min_curvature_grid(spark.createDataFrame(pts, "surface_id string, x double, y double, z double"), g).collect()
    assert len(z) == 42 and max(abs(r["z"] - (2 * r["i"] - r["j"])) for r in z) < 1e-2


def test_lines():
    seg = pd.DataFrame([(0, 0, 1, 0), (2, 0, 1, 0), (5, 5, 6, 5), (6, 5, 6, 6), (6, 6, 5, 5)], columns=["x1", "y1", "x2", "y2"]).astype(float)
    lines = kernels.chain(seg)
    assert lines[0] == [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)] and lines[1][0] == lines[1][-1] and len(lines[1]) == 4
    wave = [(float(x), math.sin(x) * 0.01) for x in np.linspace(0, 6, 60)]
    assert kernels.simplify(wave, 0.1) == [wave[0], wave[-1]]


def test_scalars(spark):
    df = spark.createDataFrame([(float("nan"), 0.0), (1e30, 2.0), (None, -1.0)], "a double, b double")
    got = df.select(scalars.defined(df.a).alias("d"), scalars.sentinel(df.a).alias("s"), scalars.divided(df.b, df.b * 0).alias("q"), scalars.clamp(df.a, 0, 1).alias("c"), scalars.sqrt(df.b).alias("r")).collect()
    assert got[0]["d"] is None and got[1]["s"] is None and all(r["q"] is None for r in got) and got[2]["c"] is None and got[2]["r"] is None
    with pytest.raises(ValueError):
        scalars.clamp(df.a, 2, 1)
    g = {"xori": 10.0, "yori": 20.0, "xinc": 2.0, "yinc": 3.0, "rotation_deg": 30.0, "yflip": True}
    p = spark.createDataFrame([(2.0, 5.0)], "i double, j double")
    x, y = scalars.node_xy(p.i, p.j, g)
    back = p.select(x.alias("x"), y.alias("y"))
    i, j = scalars.xy_to_ij(back.x, back.y, g)
    r = back.select(i.alias("i"), j.alias("j")).first()
    assert r["i"] == pytest.approx(2) and r["j"] == pytest.approx(5)


def test_stream(spark, sf_dir, tmp_path):
    from lithoframe.streaming import events

    static = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", __import__("pyspark").sql.functions.col("ts").cast("timestamp"))
    static.write.parquet(str(tmp_path / "in"))
    stream = events.read(spark, str(tmp_path / "in"), static.schema)
    q = events.last_values(stream).writeStream.outputMode("complete").format("memory").queryName("last_values_test").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(map(tuple, df.select("user_id", "event_type", "value").collect()))
    assert key(spark.table("last_values_test")) == key(events.last_values(static))


def test_empty(spark):
    none = spark.createDataFrame([], "i int, j int, z double")
    assert grid.hypsometry(none, 1.0).count() == 0 and grid.smooth(none, 2).count() == 0


def test_mesh_components(spark):
    from lithoframe.operators import mesh

    t = spark.createDataFrame([("m", 1, 5, 6, 7), ("m", 2, 7, 8, 9), ("m", 3, 20, 21, 22), ("n", 1, 5, 6, 7)], "mesh_id string, tid long, a long, b long, c long")
    assert {(r["mesh_id"], r["tid"]): r["component"] for r in mesh.components(t).collect()} == {("m", 1): 5, ("m", 2): 5, ("m", 3): 20, ("n", 1): 5}


def test_families():
    assert X.resolve("poro", ["PORO"]) == "PORO"
    with pytest.raises(KeyError):
        X.resolve("poro", ["PHI"])


def test_geometry_mismatch(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "i int, j int, z double")
    b = spark.createDataFrame([(0, 0, 1.0)], "i int, j int, z double")
    with pytest.raises(Exception, match="geometry mismatch"):
        grid.combine(a, b, "plus").collect()
    assert grid.combine(a, b, "plus", sparse=True).count() == 1
    g = {"xori": 0.0, "xinc": 1.0, "ncol": 2}
    with pytest.raises(ValueError, match="xinc"):
        grid.combine(a, a, "plus", (g, g | {"xinc": 2.0}))
    assert grid.combine(a, a, "minus", (g, dict(g))).agg({"z": "sum"}).head()[0] == 0.0


def test_nearest_ends(spark):
    rng = random.Random(2)
    points = [(i, rng.uniform(0, 1e4), rng.uniform(0, 10)) for i in range(60)] + [(90, None, 1.0), (91, float("nan"), 1.0), (92, float("inf"), 0.0), (93, 5.0, None)]
    queries = [(i, rng.uniform(-1e5, 1e5), rng.uniform(-1e5, 1e5)) for i in range(20)] + [(50, None, 1.0), (51, float("nan"), 1.0), (52, 1.0, float("inf"))]
    p, q = spark.createDataFrame(points, "point_id long, x double, y double"), spark.createDataFrame(queries, "query_id long, x double, y double")
    got = {r["query_id"]: r["point_id"] for r in spatial.nearest(p, q, 500.0).collect()}
    want = {k: min((math.dist((x, y), (a, b)), i) for i, a, b in points[:60])[1] for k, x, y in queries[:20]}
    assert got == want | {50: None, 51: None, 52: None}
    nowhere = spatial.nearest(p.where("point_id >= 90"), q, 1.0).collect()
    assert len(nowhere) == 23 and all(r["point_id"] is None for r in nowhere)
    assert spatial.nearest(p, q.limit(0), 1.0).count() == 0


def test_inside_by_bands(spark):
    rng = random.Random(7)
    rings = []
    for k in range(30):
        cx, cy, r = rng.uniform(0, 100), rng.uniform(0, 100), rng.uniform(1, 20)
        rings += [(k, n, cx + r * math.cos(n), cy + r * math.sin(n)) for n in range(6)]
    rings += [(99, 0, 0.0, 0.0), (99, 1, 1.0, 1.0)]
    r = spark.createDataFrame(rings, "poly_id int, vseq int, x double, y double")
    points = spark.createDataFrame([(i, rng.uniform(-5, 105), rng.uniform(-5, 105)) for i in range(800)] + [(900, None, 1.0)], "point_id long, x double, y double")
    bands = spatial.inside(points, r, broadcast_edges=10)
    assert "CartesianProduct" not in bands._jdf.queryExecution().toString() and "NestedLoop" not in bands._jdf.queryExecution().toString()
    assert {x[0] for x in bands.collect()} == {x[0] for x in spatial.inside(points, r).collect()} != set()


def test_idw_blocks(spark, monkeypatch):
    rng = random.Random(3)
    p = spark.createDataFrame([(i, rng.uniform(0, 9), rng.uniform(0, 9), rng.uniform(0, 5)) for i in range(50)] + [(70, 1.0, 1.0, 4.0), (71, 1.0, 1.0, 9.0)], "point_id long, x double, y double, z double")
    t = spark.createDataFrame([(i, j, float(i), float(j)) for i in range(4) for j in range(4)], "i int, j int, x double, y double")
    whole = {(r["i"], r["j"]): r["z"] for r in spatial.idw(p, t, ["i", "j"]).collect()}
    monkeypatch.setattr(spatial, "BROADCAST_POINTS", 9)
    for r in spatial.idw(p, t, ["i", "j"]).collect():
        assert r["z"] == pytest.approx(whole[r["i"], r["j"]])
    assert whole[1, 1] == 4.0


def test_hypsometry_ties(spark):
    rng = random.Random(5)
    rows = [(i, j, rng.choice([1.0, 2.0, 2.0, 2.0, rng.uniform(0, 3)])) for i in range(40) for j in range(30)] + [(50, 0, None)]
    got = {(r["i"], r["j"]): r["area"] for r in grid.hypsometry(spark.createDataFrame(rows, "i int, j int, z double"), 2.0).collect()}
    want = {(i, j): 2.0 * n for n, (z, i, j) in enumerate(sorted((z, i, j) for i, j, z in rows if z is not None), 1)}
    assert got == want


def test_strat_order_many(spark):
    # a thousand names, in more wells than one, and a cycle at the end
    names = [f"n{i:04d}" for i in range(1000)]
    picks = [(w, n, float(k), 1000 * w + k) for w in range(2) for k, n in enumerate(names[w * 500 : w * 500 + 510])]
    picks += [(5, "x", 1.0, 9001), (5, "y", 2.0, 9002), (6, "y", 1.0, 9003), (6, "x", 2.0, 9004)]
    order = sets.strat_order(spark.createDataFrame(picks, "well int, name string, md double, seq long"))
    assert order == [*names, "x", "y"]


def test_hints(spark):
    assert sets.parse_hint("A < B top") == ("A", "B top") and sets.parse_hint(" C > D") == ("D", "C")
    for bad in ("A B", "< B", "A >"):
        with pytest.raises(ValueError):
            sets.parse_hint(bad)
    tops = spark.createDataFrame([("Sand Top",), ("Sandy",), ("Lower shale",), ("Upper shale",)], "name string")
    assert sets.resolve_hints(tops, ["sand < lower", "UPPER > Sandy"]) == [("Sand Top", "Lower shale"), ("Sandy", "Upper shale")]
    for bad in ("shale < sand", "lime < sand"):
        with pytest.raises(ValueError):
            sets.resolve_hints(tops, [bad])


def test_unconverged_surface(spark, monkeypatch):
    monkeypatch.setattr(kernels, "STEPS", 2)
    p = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (1, 9.0, 9.0, 7.0), (1, 0.0, 9.0, -3.0)], "surface_id int, x double, y double, z double")
    g = {"xori": 0.0, "yori": 0.0, "xinc": 1.0, "yinc": 1.0, "ncol": 10, "nrow": 10, "rotation_deg": 0.0, "yflip": False}
    import numpy as np

    held = np.zeros((10, 10), dtype=bool)
    held[0, 0] = held[9, 9] = held[0, 9] = True
    with pytest.raises(ArithmeticError):
        kernels._biharmonic(np.where(held, 5.0, 0.0) + np.arange(100).reshape(10, 10) % 7, held)
    monkeypatch.undo()
    # brute force: the least curvature by least squares on all second differences
    rng = np.random.default_rng(1)
    held = np.zeros((7, 6), dtype=bool)
    held[rng.integers(0, 7, 9), rng.integers(0, 6, 9)] = True
    z = np.where(held, rng.uniform(-5, 5, (7, 6)), 0.0)
    rows = []
    for i in range(7):
        for j in range(6):
            for stencil, w in ((((i, j, 1), (i + 1, j, -2), (i + 2, j, 1)), 1.0), (((i, j, 1), (i, j + 1, -2), (i, j + 2, 1)), 1.0), (((i, j, 1), (i + 1, j, -1), (i, j + 1, -1), (i + 1, j + 1, 1)), 2**0.5)):
                if all(a < 7 and b < 6 for a, b, _ in stencil):
                    row = np.zeros((7, 6))
                    for a, b, x in stencil:
                        row[a, b] = w * x
                    rows.append(row.ravel())
    m, f = np.array(rows), held.ravel()
    best = z.ravel().copy()
    best[~f] = np.linalg.lstsq(m[:, ~f], -m[:, f] @ best[f], rcond=None)[0]
    assert np.abs(kernels._biharmonic(z, held).ravel() - best).max() < 1e-6
    z = grid.from_points(p.withColumn("point_id", p["x"].cast("long")), g, "min_curvature").where("i = 9 AND j = 9").head()["z"]
    assert z == pytest.approx(7.0)


def test_in_range(spark):
    rows = [("phie ", 0.5, True), ("PHIE", 1.5, False), ("gr", -1.0, False), ("own", 9e9, True), ("own", float("inf"), False), ("own", float("nan"), False), ("PERM", float("nan"), False), ("GR", None, False)]
    df = spark.createDataFrame(rows, "family string, x double, want boolean")
    f, x = df["family"], df["x"]
    got = df.select("want", scalars.in_range(f, x).alias("ok"), scalars.out_of_range(f, x).alias("out")).collect()
    assert [r["ok"] for r in got] == [r["want"] for r in got]
    assert [r["out"] for r in got] == [False, True, True, False, False, False, False, False]


def test_bores(spark):
    rows = [("w1", "", True), ("w2", "", False), ("w2", "A", True), ("w3", "", False), ("w3", "A", True), ("w3", "B", True), ("w4", "", False)]
    b = spark.createDataFrame(rows, "well string, bore string, has_path boolean")
    got = {r["well"]: (r["bore"], r["how"]) for r in bores.resolve(b).collect()}
    assert got == {"w1": ("", "only path"), "w2": ("A", "only path"), "w3": ("", "main"), "w4": ("", "main")}
    chosen = spark.createDataFrame([("w3", "B"), ("w1", "gone")], "well string, bore string")
    got = {r["well"]: (r["bore"], r["how"]) for r in bores.resolve(b, chosen, strict=True).collect()}
    assert got["w3"] == ("B", "default") and got["w1"] == ("", "only path")
    with pytest.raises(Exception, match="choose a bore of w3"):
        bores.resolve(b, strict=True).collect()


def test_path_inputs(spark):
    def at(p):
        return [(r["md"], round(r["x"], 6), round(r["y"], 6), round(r["z"], 6)) for r in p.orderBy("md").collect()]

    plan = "bore_id string, md double, inc double, azi double, length double, build double, turn double"
    down = spark.createDataFrame([("A", 100.0, 0.0, 0.0, 50.0, 0.0, 0.0)], plan)
    assert at(path.from_input("hold", down, 1.0, 2.0, 10.0)) == [(100.0, 1.0, 2.0, -90.0), (150.0, 1.0, 2.0, -140.0)]
    curve = path.from_input("steer", spark.createDataFrame([("A", 0.0, 0.0, 0.0, 100.0, 90.0, 0.0)], plan)).orderBy("md").collect()
    assert [r["md"] for r in curve] == [0.0, 30.0, 60.0, 90.0, 100.0] and curve[-1]["y"] == pytest.approx(200 / math.pi)
    rows = spark.createDataFrame([("A", 1, 0.0, 1.0, 2.0, -3.0, 0.0, 0.0), ("A", 2, 10.0, 1.0, 2.0, -13.0, 0.0, 0.0)], "bore_id string, seq int, md double, x double, y double, z double, inc double, azi double")
    assert at(path.from_input("positioned", rows)) == [(0.0, 1.0, 2.0, -3.0), (10.0, 1.0, 2.0, -13.0)]
    assert [x[0] for x in at(path.from_input("xyz", rows))] == [0.0, 10.0]
    with pytest.raises(Exception, match="increase strictly"):
        path.from_input("positioned", rows.withColumn("md", rows["md"] * 0)).collect()
    with pytest.raises(ValueError):
        path.from_input("other", rows)


def test_assigned_log(spark):
    rows = [(1, "a", float(k), 1.0 * k, k) for k in range(4)] + [(1, "b", float(k), 10.0, 10 + k) for k in range(4)] + [(2, "a", 0.0, 1.0, 20), (1, "sum", 0.0, -1.0, 30)]
    curves, report = X.assign(spark.createDataFrame(rows, "bore_id int, mnemonic string, md double, value double, seq long"), "sum", X.channel("a") + X.channel("b"), "a")
    assert {tuple(r) for r in report.collect()} == {(1, "created", 4), (2, "skipped", 0)}
    assert sorted(r["value"] for r in curves.where("mnemonic = 'sum'").collect()) == [10.0, 11.0, 12.0, 13.0]
