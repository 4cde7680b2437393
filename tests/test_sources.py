"""Readers and writers on small files."""

import pytest

from lithoframe.sources import detect, load, sinks, text


def put(folder, name, body):
    p = folder / name
    p.write_text(body, encoding="latin-1")
    return str(p)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_irap_round_trip(spark, tmp_path):
    path = put(tmp_path, "a.irap", "-996 4 50.0 25.0\n1000.0 1100.0 2000.0 2075.0\n3 30.0 1000.0 2000.0\n0 0 0 0 0 0 0\n1 2 3 4 5 6\n7 9999900 9 10 11 12\n")
    g = text.irap_grid(spark, path)
    first = g.first()
    assert (first["ncol"], first["nrow"], first["xinc"], first["yinc"], first["rotation_deg"], first["xori"], first["yori"]) == (3, 4, 50.0, 25.0, 30.0, 1000.0, 2000.0)
    want = [(k % 3, k // 3, None if k == 7 else k + 1.0) for k in range(12)]
    assert rows(g, "i", "j", "z") == sorted(want, key=repr)
    geometry = {k: first[k] for k in ("ncol", "nrow", "xori", "yori", "xinc", "yinc", "rotation_deg", "yflip")}
    sinks.irap_grid(g.select("i", "j", "z"), geometry, str(tmp_path / "out"))
    again = text.irap_grid(spark, str(tmp_path / "out" / "part-*"))
    assert rows(again, "i", "j", "z") == sorted(want, key=repr)


def test_cps3(spark, tmp_path):
    path = put(tmp_path, "a.cps3", "FSASCI 0 1 COMPUTED 0 1.0E+30\nFSATTR 0 0\nFSLIMI 0 100 10 60 1 9\nFSNROW 2 3\nFSXINC 50 50\n->MSMODL: x\n1 2 1.0E+30\n4 5\n")
    got = rows(text.cps3_grid(spark, path), "i", "j", "z")
    assert got == sorted([(0, 0, 1.0), (1, 0, 2.0), (2, 0, None), (0, 1, 4.0), (1, 1, 5.0), (2, 1, None)], key=repr)
    lines = put(tmp_path, "l.cps3", "ignored 1 2 3\n-> one\n0 0 1\n1 0 1\nbad\n-> two\n5 5 0\n")
    assert rows(text.cps3_lines(spark, lines), "poly_id", "vseq", "x") == [(1, 0, 0.0), (1, 1, 1.0), (2, 0, 5.0)]


def test_points(spark, tmp_path):
    path = put(tmp_path, "p.xyz", "# c\n1 2 3\n4,5,1e30\n999.0 999.0 999.0\n! c\n")
    assert rows(text.xyz_points(spark, path), "x", "y", "z") == [(1.0, 2.0, 3.0), (4.0, 5.0, None)]
    bad = put(tmp_path, "b.xyz", "1 2 x\n")
    with pytest.raises(Exception, match="not three numbers"):
        text.xyz_points(spark, bad).collect()
    poly = put(tmp_path, "s.pol", "0 0 1\n1 0 1\n1 1 1\n999 999 999\n999 999 999\n5 5 5\n")
    assert rows(text.xyz_polygons(spark, poly), "vseq", "x", "y") == [(0, 0.0, 0.0), (0, 5.0, 5.0), (1, 1.0, 0.0), (2, 1.0, 1.0)]
    csv = put(tmp_path, "p.csv", "x,y,z,Po-ro,well\n1,2,3,0.1,A\n4,5,6,0.2,B\n")
    df = text.csv_points(spark, csv)
    assert df.columns == ["x", "y", "z", "po_ro"] and rows(df, "x", "po_ro") == [(1.0, 0.1), (4.0, 0.2)]
    ev = put(tmp_path, "e.dat", "# Type: x\n# Null_value: 1.0e+31\n1 2 3 7 8\n1 2 1.0e+31 7 9\n")
    assert rows(text.earthvision(spark, ev), "x", "z", "column", "row") == [(1.0, 3.0, 7.0, 8.0)]


def test_geojson(spark, tmp_path):
    path = put(tmp_path, "p.geojson", '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]},"properties":{"poro":0.2,"name":"a"}},'
               '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1]],[[5,5],[6,5],[6,6]]]},"properties":{}}]}')
    p = text.geojson_points(spark, path).collect()
    assert [(r["x"], r["y"], r["z"], r["attributes"]) for r in p] == [(1.0, 2.0, 0.0, {"poro": 0.2})]
    assert text.geojson_rings(spark, path).groupBy("poly_id").count().count() == 2
    sinks.points_geojson(spark.createDataFrame([(1.0, 2.0, 3.0, None)], "x double, y double, z double, poro double"), str(tmp_path / "g"))
    assert '"poro":null' in spark.read.text(str(tmp_path / "g")).first()[0]


def test_las(spark, tmp_path):
    body = "~Version\nVERS. 2.0 :\nWRAP. NO :\n~Well\nNULL. -999.25 :\n~Curve\nDEPT.m : d\nGR.gAPI : g\nNTG.v/v : n\n~ASCII\n2400 10 1\n2410 -999.25 0\n2420 30\n"
    got = rows(text.las(spark, put(tmp_path, "a.las", body)), "mnemonic", "unit", "md", "value")
    assert got == sorted([("GR", "gAPI", 2400.0, 10.0), ("GR", "gAPI", 2410.0, None), ("GR", "gAPI", 2420.0, 30.0), ("NTG", "v/v", 2400.0, 1.0), ("NTG", "v/v", 2410.0, 0.0), ("NTG", "v/v", 2420.0, None)], key=repr)
    three = body.replace("2.0", "3.0").replace("WRAP", "DLM. COMMA :\nWRAP").replace("~Curve", "~Log_Definition").replace("~ASCII", "~Log_Data | Log_Definition").replace("2400 10 1", "2400,10,1").replace("2410 -999.25 0", "2410,,0")
    assert (2410.0, None) in rows(text.las(spark, put(tmp_path, "b.las", three)).where("mnemonic = 'GR'"), "md", "value")
    with pytest.raises(Exception, match="wrapped"):
        text.las(spark, put(tmp_path, "c.las", body.replace("WRAP. NO", "WRAP. YES"))).collect()


def test_wells(spark, tmp_path):
    path = put(tmp_path, "w.wellpath", "# WELL TRACE FROM PETREL\nMD X Y Z TVD DX DY AZ INCL DLS AZIM\n0 1 2 -3 4 0 0 10 5 0 11\n1 2\n")
    assert rows(text.wellpath(spark, path), "md", "tvd", "inc", "azi") == [(0.0, 4.0, 5.0, 11.0)]
    tops = put(tmp_path, "w.tops", '# Petrel well tops\nBEGIN HEADER\nX\nEND HEADER\n1 2 3 4 5 6 2400 7 Horizon "Top A" "W 1"\n1 2 3 4 5 6 -999 7 Horizon "Top B" "W 1"\n1 2 3 4 5 6 2500 7 Other OWC "W 1"\n')
    assert rows(text.well_tops(spark, tops), "md", "kind", "surface", "well") == [(2400.0, "Horizon", "Top A", "W 1"), (2500.0, "Other", "OWC", "W 1")]
    crs = put(tmp_path, "c.xml", '<a name="x"><label> ED50 </label></a>')
    assert text.crs_label(spark, crs).first()["label"] == "ED50"


def test_detect(spark, tmp_path):
    put(tmp_path, "a.txt", "~Version\n")
    put(tmp_path, "b.las", "-996 4 50 25\n")
    put(tmp_path, "c.bin", "1 2 3\n")
    put(tmp_path, "d.shp", "\x00\x00")
    got = {r["path"].rsplit("/", 1)[1]: r["kind"] for r in detect.scan(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "las", "b.las": "irap_grid", "c.bin": "xyz_points", "d.shp": "shapefile"}


def test_project(spark, tmp_path):
    a = spark.createDataFrame([("A", 1.0)], "name string, z double")
    sinks.save_project(spark, {"surfaces": a, "other": a}, str(tmp_path / "p"), {"unit": "m"})
    assert set(sinks.inspect(spark, str(tmp_path / "p"))["kinds"]) == {"surfaces", "other"}
    assert rows(sinks.open_project(spark, str(tmp_path / "p"), {"surfaces"})["surfaces"], "name", "z") == [("A", 1.0)]


def test_geojson_back(spark, tmp_path):
    pts = spark.createDataFrame([(1.0, 2.0, 3.0, 0.25), (4.0, 5.0, None, None)], "x double, y double, z double, poro double")
    sinks.points_geojson(pts, str(tmp_path / "p"))
    assert rows(text.geojson_points(spark, str(tmp_path / "p" / "part-*")), "x", "y", "z") == [(1.0, 2.0, 3.0), (4.0, 5.0, 0.0)]
    ring = [(k, n, float(k + n % 2), float(n // 2)) for k in range(3) for n in range(4)]
    sinks.polygons_geojson(spark.createDataFrame(ring, "poly_id int, vseq int, x double, y double").repartition(3), str(tmp_path / "r"))
    got = text.geojson_rings(spark, str(tmp_path / "r" / "part-*"))
    assert rows(got, "vseq", "x", "y") == sorted(r[1:] for r in ring)


def test_tops_csv(spark, tmp_path):
    path = put(tmp_path, "t.csv", "name,md,comment\nBl\u00e5b\u00e6r,2400,x\nDunlin, 2450.5 ,\n")
    assert rows(text.tops_csv(spark, path), "name", "md") == [("Bl\u00e5b\u00e6r", 2400.0), ("Dunlin", 2450.5)]
    with pytest.raises(KeyError):
        text.tops_csv(spark, path, md="depth")
    bad = put(tmp_path, "b.csv", "name,md\nA,deep\n")
    with pytest.raises(Exception, match="not a depth"):
        text.tops_csv(spark, bad).collect()


@pytest.mark.parametrize("body,kind", [("~Version\n1 2 3\n", "LAS"), ("FSNROW 2 3\n1 2 3\n", "CPS-3"), ("# Grid_size: 3 x 4\n1 2 3\n", "EarthVision")])
def test_foreign_formats(spark, tmp_path, body, kind):
    path = put(tmp_path, "p.xyz", body)
    for reader in (text.xyz_points, text.xyz_polygons):
        with pytest.raises(Exception, match=kind):
            reader(spark, path).collect()


def test_load_by_content(spark, tmp_path):
    irap = put(tmp_path, "s.dat", "-996 2 50.0 25.0\n0.0 50.0 0.0 25.0\n2 0.0 0.0 0.0\n0 0 0 0 0 0 0\n1 2 3 4\n")
    assert load.surface(spark, irap).count() == 4
    plain = put(tmp_path, "p.dat", "1 2 3\n4 5 6\n")
    assert load.points(spark, plain).count() == 2 and load.polygons(spark, plain).count() == 2
    with pytest.raises(ValueError, match="not a surface"):
        load.surface(spark, plain)


LAS = "~V\nVERS. 2.0 :\nWRAP. NO :\n~W\nNULL. -999.25 :\n~C\nDEPT.M :\nGR.API :\n~A\n1 10\n2 20\n"
WELLPATH = "# WELL TRACE FROM PETREL\n# WELL HEAD X-COORDINATE: 1000.5 (m)\n# WELL HEAD Y-COORDINATE: 2000 (m)\n# WELL KB: 27.5 (m)\nMD X Y Z TVD DX DY AZIM_TN INCL DLS AZIM_GN\n0 1 2 3 4 5 6 7 8 9 10\n10 1 2 3 14 5 6 7 8 9 10\n"


def test_load_well(spark, tmp_path):
    for name, body in (("99_9-1_A.wellpath", WELLPATH), ("99_9-1_ST2.wellpath", WELLPATH), ("99_9-1_ST2_comp.las", LAS), ("99_9-1_core.las", LAS), ("99_9-2.las", LAS), ("99_9-1_tops.csv", "name,md\nBrent,5\n")):
        put(tmp_path, name, body)
    got = load.well(spark, str(tmp_path), "99/9-1")
    assert set(got) == {"curves", "paths", "tops"}
    assert rows(got["curves"].groupBy("bore").count(), "bore", "count") == [("", 2), ("ST2", 2)]
    assert rows(got["paths"].groupBy("bore").count(), "bore", "count") == [("A", 2), ("ST2", 2)]
    assert rows(got["tops"], "bore", "name") == [("", "Brent")]
    head = text.wellpath_head(spark, str(tmp_path / "99_9-1_A.wellpath")).head()
    assert (head["x"], head["y"], head["kb"], head["crs"]) == (1000.5, 2000.0, 27.5, None)
    other = load.well(spark, str(tmp_path), "99/9-2")
    assert set(other) == {"curves"} and other["curves"].count() == 2
