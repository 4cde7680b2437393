"""The project facade and log bundles."""

import json

import pytest

from lithoframe.project import Project, log_bundle, overwrite_log


def grid(spark, z):
    return spark.createDataFrame([(0, 0, z)], "i int, j int, z double")


def test_project(spark, tmp_path):
    p = Project(spark, "m", "me").add("surfaces", "a/top", grid(spark, 1.0)).add("surfaces", "a/base", grid(spark, 2.0)).add("surfaces", "a/top", grid(spark, 9.0))
    assert p.inventory() == {"surfaces": 2} and p.get("surfaces", "top").first()["z"] == 1.0
    assert p.folder("surfaces") == ["a/"] and p.folder("surfaces", "a") == ["top", "base"]
    with pytest.raises(KeyError):
        p.get("surfaces", "none")
    with pytest.raises(ValueError):
        p.rename("surfaces", "a/top", "a/base")
    p.rename("surfaces", "a/top", "b/top").tags["b/top"] = ["x"]
    other = Project(spark).add("surfaces", "b/top", grid(spark, 5.0)).add("points", "p", grid(spark, 3.0))
    m = p.merge(other)
    assert m.get("surfaces", "top").first()["z"] == 5.0 and m.inventory() == {"surfaces": 2, "points": 1}
    assert p.export(["x"]).inventory() == {"surfaces": 1} and p.split(["a/base"]).get("surfaces", "base").first()["z"] == 2.0
    m.save(str(tmp_path / "p"))
    again = Project.open(spark, str(tmp_path / "p"))
    assert again.inventory() == m.inventory() and again.get("points", "p").first()["z"] == 3.0
    assert p.delete("surfaces", "a/base").inventory() == {"surfaces": 1}


def test_logs(spark):
    c = spark.createDataFrame([(1, "GR", 1.0, 5.0), (1, "gr", 2.0, 6.0), (1, "NTG", 1.0, 1.0)], "bore_id int, mnemonic string, md double, value double")
    new = spark.createDataFrame([(1, "Gr", 3.0, 7.0)], "bore_id int, mnemonic string, md double, value double")
    assert {(r["mnemonic"], r["md"]) for r in overwrite_log(c, new).collect()} == {("Gr", 3.0), ("NTG", 1.0)}
    b = json.loads(log_bundle(c, spark.createDataFrame([(1, "A", 0.0)], "bore_id int, name string, md double")).first()["bundle"])
    assert b["kind"] == "wells_logs" and {x["mnemonic"] for x in b["logs"]} == {"GR", "gr", "NTG"} and b["tops"][0]["name"] == "A"
