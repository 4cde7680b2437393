"""Connected components of a link table by alternating large-star and small-star steps.

Links stay distributed; each round is a minimum per node and a join, and its result is written to the shared folder.
Nodes with very many links are dealt over several parts where rounds join on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LEAST_HOT, hot_keys, met, written


def _large_star(links: DataFrame, n: int) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
    joined = met(both, least.select("u", "m"), "u", hot_keys(least.select("u", "n"), 2 * n), "v")
    return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(links: DataFrame, n: int) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    joined = met(down, least.select("u", "m"), "u", hot_keys(least.select("u", "n"), n), "v")
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _mark(links: DataFrame):
    return links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).head()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(u, v)``; the component is the smallest node reachable.

    Nodes that are linked only with themselves, and null ones, are left out.
    """
    now = written(links.where("u <> v").distinct(), "links")
    mark = _mark(now)
    while mark["n"]:
        n, before = mark["n"], mark
        # one star step may leave as many links as it got
        large = written(_large_star(now, n).distinct(), "large") if n > LEAST_HOT else _large_star(now, n).distinct()
        now = written(_small_star(large, n).distinct(), "links")
        mark = _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
