"""Predicates, column arithmetic, assignment, promotion, ordered topology and table functions."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lithoframe.catalog import QUERIES
from lithoframe.operators import attributes, lattice


@pytest.fixture(scope="module")
def points(spark):
    rows = [(1, 1.0, 2.0, 3.0), (2, -4.0, 0.0, None), (3, 0.0, 5.0, float("nan"))]
    return spark.createDataFrame(rows, "point_id long, x double, y double, z double").cache()


def test_where(points):
    ids = lambda df: sorted(r["point_id"] for r in df.collect())
    for predicate in (F.col("x") > 0, "x > 0", lambda x: x > 0):
        assert ids(attributes.where(points, predicate)) == [1]
    assert ids(attributes.where(points, lambda z, y: (z < 9) | (y == 5))) == [1, 3]
    with pytest.raises(ValueError):
        attributes.condition(points, lambda q: q > 0)


def test_columns(spark, points):
    got = {r["point_id"]: r["v"] for r in points.select("point_id", attributes.combined(F.col("y"), "/", F.col("x")).alias("v")).collect()}
    assert got == {1: 2.0, 2: 0.0, 3: None}
    assert [r["v"] for r in points.select(attributes.combined(F.col("x"), "**", 0.5).alias("v")).collect()] == [1.0, None, 0.0]
    with pytest.raises(ValueError):
        attributes.combined(F.col("x"), "%", 2)
    out = attributes.assign(points, " My-Attr ", 2)
    assert out.columns[-1] == "my_attr" and attributes.assign(out, "my attr", F.col("x")).columns.count("my_attr") == 1
    for name in ("x", "point_id", " "):
        with pytest.raises(ValueError):
            attributes.assign(points, name, 1)
    twice = spark.createDataFrame([(1, 1.0), (1, 2.0)], "point_id long, value double")
    with pytest.raises(PySparkException, match="two values"):
        attributes.assign(points, "v", twice).collect()


def test_promote(spark):
    grid = spark.createDataFrame([(0, 0, 1.0, 9.0)], "i int, j int, z double, poro double")
    assert attributes.promote(grid, "Poro").head().asDict() == {"i": 0, "j": 0, "primary": 1.0, "z": 9.0}
    for lane, was in (("none", "primary"), ("z", "primary"), ("poro", "i")):
        with pytest.raises(ValueError):
            attributes.promote(grid, lane, was)


def test_ordered_topology(spark):
    schema = "seq long, x double, y double, z double, column int, row int"
    # places 0 to 4, of which 1 comes twice
    every = spark.createDataFrame([(k, float(p), 0.0, 1.0, k, 100 + k) for k, p in enumerate((0, 1, 2, 1, 3, 4))], schema)
    take = lambda *places: spark.createDataFrame([(k, float(p), 0.0, 1.0, "kept") for k, p in enumerate(places)], "seq long, x double, y double, z double, more string")
    for places, want in (((0, 1, 3), [0, 1, 4]), ((2, 1, 4), [2, 3, 5]), ((1, 1, 3), [1, 3, 4]), ((0, 2, 1, 3, 4), [0, 2, 3, 4, 5])):
        got = lattice.ordered_topology(take(*places), every).orderBy("seq").collect()
        assert [r["column"] for r in got] == want and [r["row"] for r in got] == [100 + c for c in want] and got[0]["more"] == "kept"
    for places in ((3, 2), (1, 1, 1), (0, 7)):
        with pytest.raises(ValueError, match="ordered subset"):
            lattice.ordered_topology(take(*places), every)


def test_lines_by_sql(spark, sf_dir):
    rows = lambda name: sorted(tuple(r) for r in QUERIES[name](spark, sf_dir).collect())
    assert rows("contour_lines_sql") == rows("contour_lines")
