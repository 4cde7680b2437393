"""Rules of format detection one by one, and loading that leaves broken files out with a reason."""

import pytest

from lithoframe.operators import grid
from lithoframe.sources import detect, load, text

LAS = "~V\nVERS. 2.0 :\nWRAP. NO :\n~W\nNULL. -999.25 :\n~C\nDEPT.M :\nGR.API :\n~A\n100 10\n250 20\n"

RULES = {
    "las": ("a.txt", "# c\n ~Version\n"),
    "tops": ("a.txt", "# Petrel well tops\n"),
    "cps3_grid": ("a", "FSASCI 0 1\nFSXINC 1 1\n"),
    "cps3_lines": ("a", "FFASCI 0\nFSATTR 0 0\nFSASCI 0 1 COMPUTED 0 1E30\n->1\n1 2 3\n"),
    "earthvision": ("a", "# Type: scattered data\n# Field: 1 x\n"),
    "wellpath": ("a", "# WELL HEAD X 1\nMD X Y Z TVD DX DY AZIM_TN INCL DLS\n"),
    "xml": ("a", '<?xml version="1.0"?>\n<CrsMeta><label>x</label></CrsMeta>'),
    "geojson": ("a", '{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}}'),
    "csv_points": ("a", 'Name,"Easting",Northing,Depth\n'),
    "tops_csv": ("a", "name,md\n"),
    "irap_grid": ("a", "-996 4 50 25\n"),
    "xyz_points": ("a", "# c\n1, 2, 3 x\n"),
}


@pytest.mark.parametrize("kind", RULES)
def test_rule(kind):
    name, header = RULES[kind]
    assert detect.kind_of(header, name) == kind


def test_rules_against_each_other():
    # records of a grid come before those of lines, columns of a path need a head, four lines name tops, the rest goes by name
    assert detect.kind_of("FSNROW 1 2\n->1\n", "a") == "cps3_grid"
    assert detect.kind_of("MD X Y Z TVD DX DY AZIM INCL\n", "a") is None and detect.kind_of("FSASCI 0 1\n", "a") is None
    assert detect.kind_of("VERSION 2\nBEGIN HEADER\nMD\nType\nSurface\nWell\nEND HEADER\n", "a") == "tops"
    assert detect.kind_of('{"kind": 1}', "a") is None and detect.kind_of("<a/>", "a.xml") == "xml"
    assert detect.kind_of("x", "a.dat") == "xyz_points" and detect.kind_of("x", "a.cps3lines") == "cps3_lines" and detect.kind_of("1 2\n", "a") is None
    assert detect.kind_of("x\n" * 159 + "~A\n", "a") == "las" and detect.kind_of("x\n" * 160 + "~A\n", "a") is None


def put(root, files):
    for name, body in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)


def test_foreign_lines(spark, tmp_path):
    put(tmp_path, {"late.xyz": "# c\n" * 58 + "FSLIMI 1\n1 2 3\n", "later.xyz": "# c\n" * 60 + "# Field: 1\n1 2 3\n"})
    with pytest.raises(Exception, match="looks like CPS-3"):
        text.xyz_points(spark, str(tmp_path / "late.xyz")).collect()
    assert text.xyz_points(spark, str(tmp_path / "later.xyz")).count() == 1


def test_well_with_broken_files(spark, tmp_path):
    put(tmp_path, {"w.las": LAS, "wrapped.las": LAS.replace("WRAP. NO", "WRAP. YES"), "empty.las": "~V\nVERS. 2.0 :\n", "tops.csv": "name,md\nA,5\n"})
    got = load.well(spark, str(tmp_path), "W 1", (10.0, 20.0), 25.0)
    assert {(r["path"].rsplit("/", 1)[1], r["problem"]) for r in got["skipped"].collect()} == {("wrapped.las", "wrapped data"), ("empty.las", "no curves")}
    assert [(r["md"], r["value"]) for r in got["curves"].orderBy("md").collect()] == [(100.0, 10.0), (250.0, 20.0)] and got["tops"].count() == 1
    # no path file: a vertical one over the logs
    assert [(r["md"], r["x"], r["y"], r["z"], r["inc"]) for r in got["paths"].orderBy("md").collect()] == [(100.0, 10.0, 20.0, 75.0, 0.0), (250.0, 10.0, 20.0, 225.0, 0.0)]


def test_tree_with_broken_files(spark, tmp_path):
    root = tmp_path / "field"
    put(root, {"1_1/a.las": LAS, "1_1/b.las": LAS.replace("WRAP. NO", "WRAP. YES"), "p.xyz": "1 2 3\n4 5 6\n", "bad.xyz": "1 2 3\n4 x 6\n", "g.gri": "-996 2 1\n", "c.geojson": '{"type": "FeatureCollection", "point'})
    project, files = load.tree(spark, str(root))
    reason = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in files.collect()}
    assert reason == {"a.las": None, "b.las": "wrapped data", "p.xyz": None, "bad.xyz": "a row is not three numbers", "g.gri": "no header", "c.geojson": reason["c.geojson"]}
    assert project.elements["curves"].count() == 2 and project.elements["points"].count() == 2


def test_well_tops(spark, tmp_path):
    line = '1 2 3 4 5 6 {} 7 {} "{}" "{}"\n'
    body = "# Petrel well tops\nEND HEADER\n" + "".join(
        line.format(*r) for r in ((10, "Horizon", "Top A", "W 1"), (20, "Horizon", "Top B", "W 1 ST2"), (25, "Other", "OWC", "W 1"), (30, "Horizon", "Top B", "W 1 Z"), (5, "Horizon", "Top A", "Elsewhere"), (9, "Horizon", "Top C", "Elsewhere"))
    )
    put(tmp_path, {"x.tops": body})
    wells = spark.createDataFrame([("W 1", 0)], "id string, load_seq int")
    bores = spark.createDataFrame([("W 1", ""), ("W 1", "ST2")], "id string, bore string")
    got = load.well_tops(spark, str(tmp_path / "x.tops"), wells, bores, ["Top C < Top B"])
    assert sorted((r["id"], r["bore"], r["name"], r["md"]) for r in got["tops"].collect()) == [("W 1", "", "Top A", 10.0), ("W 1", "", "Top B", 30.0), ("W 1", "ST2", "Top B", 20.0)]
    assert [(r["bore"], r["name"]) for r in got["contacts"].collect()] == [("", "OWC")] and got["strat"] == ["Top A", "Top C", "Top B"]


def test_sparse_grids(spark):
    a = spark.createDataFrame([(0, 0, 10.0), (1, 0, 20.0), (2, 0, None)], "i int, j int, z double")
    b = spark.createDataFrame([(1, 0, 23.0), (2, 0, 5.0), (3, 0, 7.0)], "i int, j int, z double")
    assert grid.volume_between(a, b, 2.0).head()["volume"] == 6.0
    assert {(r["i"], r["z"]) for r in grid.thickness(a, b, sparse=True).collect()} == {(1, 3.0), (2, None)}
    with pytest.raises(Exception, match="geometry mismatch"):
        grid.thickness(a, b).collect()
    with pytest.raises(ValueError, match="geometry mismatch"):
        grid.volume_between(a, b, 2.0, ({"xinc": 1.0}, {"xinc": 2.0}))


def test_hypsometry_of_a_common_value(spark):
    g = spark.range(3000).selectExpr("cast(id % 60 AS int) AS i", "cast(id div 60 AS int) AS j", "if(id % 3 > 0, 5.0D, id * 1.0D) AS z")
    got = [(r["z"], r["i"], r["j"], r["area"]) for r in grid.hypsometry(g, 2.0).orderBy("area").collect()]
    assert [r[:3] for r in got] == sorted(r[:3] for r in got) and [r[3] for r in got] == [2.0 * (k + 1) for k in range(3000)]
