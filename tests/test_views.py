"""Specs, lanes, gathered logs, shapefiles, trees and late data."""

import base64
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithoframe.operators import bores, logs, path
from lithoframe.sources import detect, load, shapes
from lithoframe.specs import IngestSpec, NetSettings, ViewSettings, ViewSpec
from lithoframe.streaming import events


def test_specs():
    for spec in (NetSettings(phi_min=0.1), IngestSpec({"PhiX ": "PHIE"}, ("A < B", ("C", "D")), "ft"), ViewSpec(["GR"], ["Brent"], "Brent", cutoff=NetSettings(0.2)), ViewSpec(tops=True, cutoff=None), ViewSettings(False, "a.html")):
        assert type(spec).from_dict(spec.to_dict()) == spec and hash(type(spec).from_dict(spec.to_dict())) == hash(spec)
    assert IngestSpec({"PhiX ": "PHIE"}).aliases == {"phix": "PHIE"} and IngestSpec(strat_hints=["B > A"]).strat_hints == (("A", "B"),)
    assert ViewSpec(cutoff=NetSettings(0.2)).porosity_cutoff() == 0.2 and ViewSpec().replace(cutoff=0.3).porosity_cutoff() == 0.3
    with pytest.raises(TypeError):
        ViewSettings().replace(other=1)
    with pytest.raises(ValueError):
        IngestSpec(unit="furlong")
    with pytest.raises(ValueError):
        NetSettings.from_dict(ViewSettings().to_dict())


def test_lanes(spark):
    curves = spark.createDataFrame([("w", "GR", 1.0, 10.0), ("w", "GR", 3.0, 30.0), ("w", "NPHI", 2.0, 5.0), ("w", "XX", 2.5, 1.0)], "bore_id string, mnemonic string, md double, value double")
    kb = spark.createDataFrame([("w", 0.5)], "bore_id string, kb double")
    got = logs.gather(curves, kb, names=["gr", "nphi"])
    rows = {(r["mnemonic"], r["md"]): (r["tvd"], r["value"]) for r in got.collect()}
    assert rows[("GR", 2.0)] == (1.5, 20.0) and rows[("NPHI", 1.0)] == (0.5, None) and len(rows) == 6
    lane = {r["mnemonic"]: r for r in logs.lanes(got).collect()}
    raw = base64.b64decode(lane["NPHI"]["value"])
    assert raw[:4] == struct.pack("<I", 0x7FC00000) and np.frombuffer(raw, "<f4")[1] == 5 and lane["GR"]["n"] == 3
    assert (lane["GR"]["low"], lane["GR"]["high"]) == (10.0, 30.0)
    none = logs.lanes(got.withColumn("value", F.lit(None).cast("double"))).head()
    assert (none["low"], none["high"]) == (0.0, 1.0)
    survey = spark.createDataFrame([("w", 0, 0.0, 0.0, 0.0), ("w", 1, 2.0, 0.0, 0.0)], "bore_id string, seq int, md double, inc double, azi double")
    way = path.from_input("stations", survey, 0.0, 0.0, 0.0)
    deep = {r["md"]: r["tvd"] for r in logs.gather(curves, kb, way, ["GR"]).collect()}
    assert deep[1.0] == pytest.approx(1.0) and deep[3.0] == pytest.approx(2.5)  # beyond the path: below the datum
    assert logs.gather(curves.limit(0), kb).count() == 0


def test_view_bore(spark):
    b = spark.createDataFrame([("a", "", True), ("a", "ST", True), ("b", "", False), ("c", "", False), ("c", "ST", True)], "well string, bore string, has_logs boolean")
    given = spark.createDataFrame([("a", "ST")], "well string, bore string")
    assert {tuple(r) for r in bores.view_bore(b, given).collect()} == {("a", "ST"), ("b", ""), ("c", "ST")}
    with pytest.raises(Exception, match="choose a bore of a"):
        bores.view_bore(b).collect()
    with pytest.raises(Exception, match="no such default bore of a"):
        bores.view_bore(b, given.withColumn("bore", F.lit("X"))).collect()


def _shp(parts, kind=5):
    xy = [p for part in parts for p in part]
    first, at = [], 0
    for part in parts:
        first.append(at)
        at += len(part)
    body = struct.pack("<i4d2i", kind, 0, 0, 0, 0, len(parts), len(xy)) + struct.pack(f"<{len(parts)}i", *first) + b"".join(struct.pack("<2d", *p) for p in xy)
    return body


def _file(*records):
    body = b"".join(struct.pack(">2i", n, len(r) // 2) + r for n, r in enumerate(records, 1))
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + len(body) // 2) + struct.pack("<2i", 1000, 5) + bytes(64) + body


def test_shapefile(spark, tmp_path):
    square, line = [(0, 0), (0, 2), (2, 2), (0, 0)], [(5, 5), (6, 6)]
    (tmp_path / "a.shp").write_bytes(_file(_shp([square, line]), struct.pack("<i", 0), _shp([line], 13), struct.pack("<i2d", 1, 0, 0)))
    got = shapes.shapefile_rings(spark, str(tmp_path / "a.shp")).orderBy("poly_id", "vseq").collect()
    assert [(r["poly_id"], r["x"], r["y"]) for r in got] == [(k, *map(float, p)) for k, ring in ((1, square), (2, line), (3, line)) for p in ring]
    assert load.polygons(spark, str(tmp_path / "a.shp")).count() == len(got)
    assert list(shapes.parts_of(_file())) == []
    for bad in (b"", bytes(100), _file(_shp([square]))[:-4]):
        with pytest.raises(ValueError):
            list(shapes.parts_of(bad))


LAS = "~V\nVERS. 2.0 :\nWRAP. NO :\n~W\nNULL. -999.25 :\n~C\nDEPT.M :\nGR.API :\n~A\n1 10\n2 20\n"
GEO = '{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": {"type": "%s", "coordinates": %s}}]}'


def test_tree(spark, tmp_path):
    root = tmp_path / "field (1)"
    files = {
        "wells/99_9-1/logs/99_9-1_A.las": LAS, "wells/Brent 7/logs/log.las": LAS, "points/p.xyz": "1 2 3\n4 5 6\n", "more/p.xyz": "7 8 9\n", "tops.csv": "name,md\nBrent,5\n",
        "a.geojson": GEO % ("Polygon", "[[[0,0],[1,0],[1,1],[0,0]]]"), "b.geojson": GEO % ("Point", "[1,2,3]"), "fault_x.geojson": '{"type": "FeatureCollection", "features": []}', "c.geojson": '{"type": "FeatureCollection", "features": []}', "readme.txt": "hello\n",
    }
    for name, body in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    project, found = load.tree(spark, str(root))
    reason = {r["path"].rsplit("/", 1)[-1]: r["reason"] for r in found.collect()}
    assert reason["c.geojson"] == "points or polygons" and reason["readme.txt"] == "unknown kind" and reason["fault_x.geojson"] is None
    assert sorted(project.names["points"]) == ["b", "more/p", "points/p"] and sorted(project.names["polygons"]) == ["a", "fault_x"]
    assert sorted(project.names["curves"]) == ["99/9-1", "Brent 7"] and project.get("curves", "Brent 7").count() == 2
    assert project.get("points", "more/p").count() == 1 and project.get("tops", "tops").head()["pick"] == "Brent"
    assert project.inventory() == {"points": 3, "polygons": 2, "curves": 2, "tops": 1}
    assert detect.kind_of("x", "a.shp") == "shapefile"


def test_late_data(spark, tmp_path):
    """A sample behind the watermark is left out; one within it counts."""
    schema = "user_id long, event_type string, ts timestamp, value double"
    folder = str(tmp_path / "in")

    def put(*rows):
        spark.createDataFrame([(1, "a", ts, v) for ts, v in rows], "user_id long, event_type string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)

    put(("2024-01-01 00:10:00", 1.0), ("2024-01-02 12:00:00", 1.0))
    stream = events.read(spark, folder, schema)
    out = {
        "late_tumbling": events.tumbling(stream, late="1 hour"),
        "late_sessions": events.sessions(stream, gap="1 hour", late="1 hour"),
        "late_dedup": events.deduplicated(stream, ["user_id", "value"], late="1 hour"),
    }
    running = [df.writeStream.outputMode("append").format("memory").queryName(name).start() for name, df in out.items()]
    try:
        for q in running:
            q.processAllAvailable()
        for more in ([("2024-01-01 05:00:00", 7.0), ("2024-01-02 11:30:00", 2.0), ("2024-01-02 11:40:00", 2.0)], [("2024-01-05 00:00:00", 1.0)], [("2024-01-06 00:00:00", 1.0)]):
            put(*more)
            for q in running:
                q.processAllAvailable()
    finally:
        for q in running:
            q.stop()
    day = {r["start"].day: (r["n"], r["total"]) for r in spark.table("late_tumbling").collect()}
    assert day[1] == (1, 1.0) and day[2] == (3, 5.0)
    assert sum(r["n"] for r in spark.table("late_sessions").where("start < '2024-01-03'").collect()) == 4
    values = sorted((r["ts"].day, r["value"]) for r in spark.table("late_dedup").collect())
    assert (1, 7.0) not in values and values.count((2, 2.0)) == 1 and not any(math.isnan(v) for _, v in values)
