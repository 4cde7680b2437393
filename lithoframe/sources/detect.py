"""File kinds by content first, by extension where content says nothing."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Header bytes that are looked at, and lines of them.
HEADER_BYTES, HEADER_LINES = 64 * 1024, 160
#: Kinds by extension.
EXTENSIONS = {
    "las": "las", "irap": "irap_grid", "gri": "irap_grid", "cps3": "cps3_grid", "cps3grid": "cps3_grid", "cps3lines": "cps3_lines", "csv": "csv_points",
    "geojson": "geojson", "json": "geojson", "shp": "shapefile", "wellpath": "wellpath", "tops": "tops", "xyz": "xyz_points", "dat": "xyz_points",
    "irapclassicpoints": "xyz_points", "earthvisiongrid": "earthvision", "xml": "xml", "pol": "xyz_polygons",
}
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def kind_of(header: str, path: str) -> str | None:
    """The kind of a file from its first bytes (Latin-1) and its name.

    A section line or a title settles it at once; then grid records before line records, directives, well paths (which
    need a well head and their columns), tops by four column lines, structured text, named columns, and numbers.
    """
    lines = [x.strip() for x in header[:HEADER_BYTES].splitlines()[:HEADER_LINES]]
    filled = [x for x in lines if x]
    upper = [x.upper() for x in filled]
    for x in upper:
        if x.startswith("~"):
            return "las"
        if "PETREL WELL TOPS" in x:
            return "tops"
    heads = {x.split()[0] for x in upper}
    if heads & {"FSNROW", "FSXINC", "FSLIMI"}:
        return "cps3_grid"
    if any(x.startswith("->") for x in upper):
        return "cps3_lines"
    if any(word in x for x in upper for word in ("EARTHVISION", "GRID_SIZE", "GRID_SPACE")) or any(x.startswith("#") and "FIELD:" in x for x in upper):
        return "earthvision"
    well_head = any(word in x for x in upper for word in ("WELL TRACE", "WELL HEAD", "KELLY BUSHING"))
    if well_head and any(all(word in x for word in ("MD", "TVD", "INCL", "AZIM")) for x in upper):
        return "wellpath"
    if {"MD", "TYPE", "SURFACE", "WELL"} <= set(upper):
        return "tops"
    start = header.lstrip()[:512].lower()
    if start.startswith(("<?xml", "<crsmeta")) and "crsmeta" in start:
        return "xml"
    if start.startswith(("{", "[")) and '"type"' in start and any(word in start for word in ("featurecollection", '"feature"', "point", "polygon")):
        return "geojson"
    table = next((x for x in filled if "," in x and re.search("[A-Za-z]", x)), None)
    if table:
        names = {x.strip().strip('"').lower() for x in table.split(",")}
        if names & {"x", "easting"} and names & {"y", "northing"} and names & {"z", "depth", "tvd"}:
            return "csv_points"
        if {"name", "md"} <= names:
            return "tops_csv"
    first = next((x for x in filled if not x.startswith(("#", "!"))), "")
    if re.match(r"-996\s+\+?\d+(?:\s|$)", first):
        return "irap_grid"
    if sum(re.fullmatch(_NUMBER, x) is not None for x in [x for x in re.split(r"[\s,]+", first) if x][:4]) >= 3:
        return "xyz_points"
    return EXTENSIONS.get(path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else "")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """``path, kind, length`` of every file under a folder; the kind follows from headers, whose files are read whole."""

    @F.pandas_udf("string")
    def kind(headers: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([kind_of(h, p) for h, p in zip(headers, paths, strict=True)], dtype=object)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", kind(F.decode(F.substring("content", 1, HEADER_BYTES), "ISO-8859-1"), "path").alias("kind"), "length")
