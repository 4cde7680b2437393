"""Positions in a global order, without a task that has all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph

#: Rows of a range, about, and ranges whose counts are added up together.
RANGE_ROWS, TOGETHER = 1_000_000, 1024


def numbered(rows: DataFrame, order: list[str], position: str = "position", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with their 0-based ``position`` in the order of the columns ``order``, which should tell rows apart.

    Rows are dealt by ranges of the order, stored with the number of their range, ranked within it and offset by the
    rows before it; the offsets are sums of at most ``TOGETHER`` ranges, and of so many of these.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // range_rows + 1)
    dealt = graph.cut(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_size")).withColumns({"_many": F.expr(f"_range div {TOGETHER}"), "_in": F.lit(0).cast("long")})
    sizes = sizes.withColumn("_in", F.coalesce(F.sum("_size").over(before("_many", "_range")), F.lit(0).cast("long")))
    many = sizes.groupBy("_many").agg(F.sum("_size").alias("_all")).withColumn("_one", F.lit(0))
    many = many.select("_many", F.coalesce(F.sum("_all").over(before("_one", "_many")), F.lit(0).cast("long")).alias("_at"))
    offsets = sizes.join(many, "_many").select("_range", (F.col("_in") + F.col("_at")).alias("_offset"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn(position, own).join(offsets, "_range").withColumn(position, F.col(position) + F.col("_offset")).drop("_range", "_offset")
