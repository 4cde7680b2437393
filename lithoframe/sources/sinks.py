"""Writers: grids, points and polygons as exchange files; projects as a manifest with one Parquet folder per kind."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import IRAP_UNDEFINED

#: Version of the project layout; a newer one is refused.
SCHEMA_VERSION = 1


def irap_grid(nodes: DataFrame, g: dict, path: str) -> None:
    """IRAP classic text, six values a line, along x first; undefined nodes are written as 9999900."""
    spark = nodes.sparkSession
    yinc = -g["yinc"] if g.get("yflip") else g["yinc"]
    xmax, ymax = g["xori"] + (g["ncol"] - 1) * g["xinc"], g["yori"] + (g["nrow"] - 1) * g["yinc"]
    head = [
        f"-996 {g['nrow']} {g['xinc']!r} {yinc!r}", f"{g['xori']!r} {xmax!r} {g['yori']!r} {ymax!r}", f"{g['ncol']} {g['rotation_deg']!r} {g['xori']!r} {g['yori']!r}", "0 0 0 0 0 0 0",
    ]
    grid = spark.range(g["ncol"] * g["nrow"]).select("id", (F.col("id") % g["ncol"]).cast("int").alias("i"), F.floor(F.col("id") / g["ncol"]).cast("int").alias("j"))
    v = grid.join(nodes, ["i", "j"], "left").select("id", F.coalesce("z", F.lit(IRAP_UNDEFINED)).cast("string").alias("s"))
    lines = v.groupBy(F.floor(F.col("id") / 6).alias("n")).agg(F.array_sort(F.collect_list(F.struct("id", "s"))).alias("c"))
    body = lines.select("n", F.array_join(F.transform("c", lambda c: c["s"]), " ").alias("line"))
    top = spark.createDataFrame([(k - len(head), x) for k, x in enumerate(head)], "n long, line string")
    # the format is one text file: lines, already packed, are written in order
    top.unionByName(body).orderBy("n").coalesce(1).select("line").write.mode("overwrite").text(path)


def points_geojson(points: DataFrame, path: str) -> None:
    """A feature per line in ``path``; undefined attributes are null."""
    attrs = [c for c in points.columns if c not in ("x", "y", "z")]
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("x", "y", F.coalesce("z", F.lit(0.0))).alias("coordinates")).alias("geometry"),
        (F.struct(*attrs) if attrs else F.create_map().cast("map<string,string>")).alias("properties"),
    )
    points.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def polygons_geojson(rings: DataFrame, path: str) -> None:
    """A polygon per line in ``path``, from ``poly_id, vseq, x, y``; a ring, which its line must hold, is one row while it is written."""
    order = F.transform(F.array_sort(F.collect_list(F.struct("vseq", "x", "y"))), lambda v: F.array(v["x"], v["y"]))
    line = rings.groupBy("poly_id").agg(order.alias("ring"))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array("ring").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.create_map().cast("map<string,string>").alias("properties"))
    line.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)


def points_csv(points: DataFrame, path: str) -> None:
    points.select("x", "y", "z", *(c for c in points.columns if c not in ("x", "y", "z"))).write.mode("overwrite").option("header", True).option("nullValue", "NaN").csv(path)


def _manifest(spark: SparkSession, path: str, value: dict) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def save_project(spark: SparkSession, elements: dict[str, DataFrame], path: str, meta: dict | None = None) -> None:
    """One Parquet folder per kind and a manifest of kinds, schemas and metadata."""
    for kind, df in elements.items():
        df.write.mode("overwrite").parquet(f"{path}/{kind}")
    _manifest(spark, path, {"version": SCHEMA_VERSION, "kinds": {k: df.schema.simpleString() for k, df in elements.items()}, "meta": meta or {}})


def inspect(spark: SparkSession, path: str) -> dict:
    """The manifest alone."""
    return json.loads(spark.read.text(f"{path}/manifest").head()[0])


def open_project(spark: SparkSession, path: str, known: set[str] | None = None) -> dict[str, DataFrame]:
    """Elements by kind; unknown kinds are skipped, a newer layout is refused."""
    m = inspect(spark, path)
    if m["version"] > SCHEMA_VERSION:
        raise ValueError(f"project layout {m['version']} is newer than {SCHEMA_VERSION}")
    return {k: spark.read.parquet(f"{path}/{k}") for k in m["kinds"] if known is None or k in known}
