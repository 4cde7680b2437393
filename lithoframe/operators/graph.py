"""Connected components by distributed star steps, and tables that are stored between the rounds of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _shared(spark: SparkSession) -> str:
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if not found:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored as a table in the folder of ``spark.checkpoint.dir``, which stays there.

    It cuts lineage and survives lost executors. The folder is a new local one only where that is unset and Spark runs on this machine alone.
    """
    spark = df.sparkSession
    path = f"{_shared(spark).rstrip('/')}/lithoframe-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key is hot with so many rows of a table at least, and with a thousandth of them; its rows are dealt over ``PARTS``.
LEAST_HOT, HOT_SHARE, PARTS = 10_000, 1000, 64


def _met(rows: DataFrame, facts: DataFrame, n: int) -> DataFrame:
    """``rows`` (u, v) with the fact ``m`` of their ``u``; ``facts`` has one row a ``u`` and the number ``n`` of its rows.

    Rows of hot keys, at most ``HOT_SHARE`` of which can be, are dealt by ``v`` and meet copies of the fact.
    """
    limit = max(LEAST_HOT, n // HOT_SHARE)
    hot = [r[0] for r in facts.where(F.col("n") > limit).select(F.xxhash64("u")).distinct().collect()] if n > limit else []
    facts = facts.select("u", "m")
    if not hot:
        return rows.join(facts, "u")
    is_hot = F.xxhash64("u").isin(hot)
    dealt = rows.withColumn("_part", F.when(is_hot, F.pmod(F.xxhash64("v"), F.lit(PARTS))).otherwise(0).cast("int"))
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(facts.withColumn("_part", F.explode(every)), ["u", "_part"]).drop("_part")


def _contracted(links: DataFrame, steps: list[str]) -> DataFrame:
    """Links as stars (u, v) to the smallest node reachable, with what ``steps`` add up to from ``u`` to ``v``."""
    back = [(-F.col(c)).alias(c) for c in steps]
    to = lambda row, c: F.col(f"{row}.{c}")
    once = lambda df: df.groupBy("u", "v").agg(F.min(F.struct(*steps)).alias("s")).select("u", "v", "s.*") if steps else df.distinct()
    mark = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v", *steps))).head()
    # where u is the head of a link to v and m its least neighbour, v is linked to m instead
    moved = lambda df: df.select(F.col("v").alias("u"), to("m", "v").alias("v"), *((to("m", c) - F.col(c)).alias(c) for c in steps))
    now = cut(once(links.select("u", "v", *steps).where("u <> v")))
    before = mark(now)
    while before[0]:
        n = before[0]
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"), *back))
        least = F.min(F.struct("v", *steps)).alias("b")
        own = F.struct(F.col("u").alias("v"), *(F.lit(0).cast(dict(now.dtypes)[c]).alias(c) for c in steps))
        facts = both.groupBy("u").agg(least, F.count("*").alias("n")).select("u", F.when(F.col("u") < F.col("b.v"), own).otherwise(F.col("b")).alias("m"), "n")
        facts = cut(facts) if n > LEAST_HOT else facts
        up = once(moved(_met(both, facts, 2 * n).where("v > u AND v <> m.v")))
        up = cut(up) if n > LEAST_HOT else up
        low = up.groupBy("u").agg(least, F.count("*").alias("n")).select("u", F.col("b").alias("m"), "n")
        low = cut(low) if n > LEAST_HOT else low
        down = moved(_met(up, low, 2 * n).where("v <> m.v")).unionByName(low.select("u", "m.*"))
        now = cut(once(down))
        after = mark(now)
        if after == before:
            break
        before = after
    return now


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of a link table ``u, v``: the smallest node reachable. Nodes with no other node are left out.

    Each round is a minimum per node and a join, until nothing moves; rows of nodes with very many links are dealt.
    """
    now = _contracted(links, [])
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def placed(links: DataFrame, steps: list[str]) -> DataFrame:
    """``node, component`` and the place of each node from its component's smallest one, where links say the step from ``u`` to ``v``.

    As :func:`components`, so rounds grow with the logarithm of the number of nodes and not with the longest way. Where
    the links of a component contradict each other, one of the places they give is taken.
    """
    now = _contracted(links, steps)
    zero = [F.lit(0).cast(dict(links.dtypes)[c]).alias(c) for c in steps]
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"), *((-F.col(c)).alias(c) for c in steps)).union(now.select("v", F.col("v").alias("w"), *zero).distinct())
