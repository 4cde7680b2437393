"""Kernels that give several rows as table functions of SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from ..operators import kernels


class ChainLines:
    """Lines of the segments ``x1, y1, x2, y2`` of a partition, ``line, seq, x, y``, thinned to a tolerance.

    ``SELECT level, t.* FROM chain_lines(TABLE(...) PARTITION BY level, piece_x, piece_y, 0.05) t``: a partition is one
    connected piece, as ``kernels._pieces`` marks them, so that tasks hold pieces and not levels.
    """

    def __init__(self):
        self.rows: list[tuple[float, float, float, float]] = []
        self.tolerance, self.own = 0.0, None

    def eval(self, row: Row, tolerance: float) -> None:
        self.rows.append((row["x1"], row["y1"], row["x2"], row["y2"]))
        self.tolerance, self.own = float(tolerance), (float(row["level"]), row["piece_x"], row["piece_y"])

    def terminate(self) -> Iterator[tuple]:
        if self.rows:
            lines = kernels.chain(pd.DataFrame(self.rows, columns=["x1", "y1", "x2", "y2"]))
            for n, line in enumerate(lines):
                for k, (x, y) in enumerate(kernels.simplify(line, self.tolerance)):
                    yield (*self.own, n, k, float(x), float(y))


def register(spark: SparkSession) -> None:
    """Makes ``chain_lines`` known to the session's SQL."""
    spark.udtf.register("chain_lines", F.udtf(ChainLines, returnType="level double, piece_x double, piece_y double, line int, seq int, x double, y double"))
