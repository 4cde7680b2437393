"""Rings and lines of ESRI shapefiles (``.shp``), by the published layout; attribute tables are not read."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the layout: file code, length of the file header, and shape codes of lines and areas (plain, with z, with m).
FILE_CODE, HEADER, LINES = 9994, 100, {3, 5, 13, 15, 23, 25}
SCHEMA = "path string, poly_id int, vseq int, x double, y double"


def parts_of(content: bytes) -> Iterator[np.ndarray]:
    """The points (x, y) of each part of each line or area, in file order."""
    if len(content) < HEADER or struct.unpack(">i", content[:4])[0] != FILE_CODE:
        raise ValueError("not a shapefile")
    at = HEADER
    while at + 12 <= len(content):
        size = 2 * struct.unpack(">i", content[at + 4 : at + 8])[0]
        record, at = content[at + 8 : at + 8 + size], at + 8 + size
        if len(record) < size:
            raise ValueError("a record is cut short")
        if int.from_bytes(record[:4], "little") not in LINES:
            continue
        n, m = struct.unpack("<2i", record[36:44])
        first = [*np.frombuffer(record, "<i4", n, 44), m]
        xy = np.frombuffer(record, "<f8", 2 * m, 44 + 4 * n).reshape(-1, 2)
        yield from (xy[a:b] for a, b in zip(first[:-1], first[1:], strict=True))


def shapefile_rings(spark: SparkSession, path: str) -> DataFrame:
    """``path, poly_id, vseq, x, y``: every part of lines and areas as a ring of its own; other shapes are left out. A task per file."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in batch.itertuples(index=False, name=None):
                for k, xy in enumerate(parts_of(bytes(content)), 1):
                    yield pd.DataFrame({"path": name, "poly_id": np.int32(k), "vseq": np.arange(len(xy), dtype=np.int32), "x": xy[:, 0], "y": xy[:, 1]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[sS][hH][pP]").load(path).select("path", "content")
    return files.mapInPandas(read, SCHEMA)
