"""Domain tables derived from the test tables, and the same as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def curve(spark, d) -> DataFrame:
    """A bore per user, a log per event type, depth in hours."""
    md = F.round((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / F.lit(3.6e9), 6)
    return table(spark, d, "events").select(F.col("user_id").alias("bore_id"), F.col("event_type").alias("mnemonic"), md.alias("md"), F.col("value").cast("double").alias("value"), F.col("event_id").alias("seq"))


def log(spark, d, mnemonic: str) -> DataFrame:
    """One log, one sample per depth."""
    one = curve(spark, d).where(F.col("mnemonic") == mnemonic)
    return one.groupBy("bore_id", "md").agg(F.min_by("value", "seq").alias("value"))


def tops(spark, d) -> DataFrame:
    """Four picks per bore; C and D coincide in every third bore."""
    bores = table(spark, d, "events").select(F.col("user_id").alias("bore_id")).distinct()
    b = F.col("bore_id")
    picks = [("A", F.lit(0.0)), ("B", 150.0 + b % 50), ("C", 300.0 + (b % 3) * 60), ("D", F.lit(420.0))]
    each = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(i).alias("ord"), m.cast("double").alias("md")) for i, (n, m) in enumerate(picks)))
    return bores.select("bore_id", F.inline(each))


def td(spark, d) -> DataFrame:
    return curve(spark, d).groupBy("bore_id").agg(F.max("md").alias("td"))


def node(spark, d) -> DataFrame:
    """A sparse grid of at most 50 x 25 nodes."""
    i, j = (F.col("p_size") - 1).cast("int"), F.substring("p_brand", 7, 9).cast("int") - 1
    return table(spark, d, "part").groupBy(i.alias("i"), j.alias("j")).agg(F.avg(F.col("p_retailprice").cast("double")).alias("z"))


def point(spark, d) -> DataFrame:
    e = lambda k, s: F.col("embedding")[k].cast("double") * s
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("point_id"), e(0, 1000.0).alias("x"), e(1, 1000.0).alias("y"), e(2, 100.0).alias("z"))


def survey(spark, d) -> DataFrame:
    """One deviated bore per region."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    return table(spark, d, "nation").select(
        F.col("n_regionkey").cast("long").alias("bore_id"), (k * 100.0).alias("md"), F.least(F.lit(90.0), k * 9.0).alias("inc"), ((F.col("n_nationkey") * 37) % 360).cast("double").alias("azi")
    )


def picks(spark, d) -> DataFrame:
    md = F.min(F.datediff("o_orderdate", F.lit("1992-01-01"))).cast("double")
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("well"), F.col("o_orderpriority").alias("name")).agg(md.alias("md"))


SQL = {
    "curve": "curve AS (SELECT user_id AS bore_id, event_type AS mnemonic, round((epoch_us(ts) - 1704067200000000) / 3.6e9::DOUBLE, 6) AS md, value::DOUBLE AS value, event_id AS seq FROM events)",
    "tops": """tops AS (SELECT bore_id, name, ord, (CASE name WHEN 'A' THEN 0 WHEN 'B' THEN 150 + bore_id % 50 WHEN 'C' THEN 300 + (bore_id % 3) * 60 ELSE 420 END)::DOUBLE AS md
        FROM (SELECT DISTINCT user_id AS bore_id FROM events), (VALUES ('A',0),('B',1),('C',2),('D',3)) t(name, ord))""",
    "zones": """td AS (SELECT bore_id, max(md) AS td FROM curve GROUP BY 1),
        zones AS (SELECT bore_id, name AS zone, ord AS zone_ord, md AS top_md, coalesce(lead(md) OVER (PARTITION BY bore_id ORDER BY md, ord), td) AS base_md FROM tops LEFT JOIN td USING (bore_id))""",
    "node": "node AS (SELECT (p_size - 1)::INT AS i, substr(p_brand, 7)::INT - 1 AS j, avg(p_retailprice::DOUBLE) AS z FROM part GROUP BY 1, 2)",
    "point": "point AS (SELECT vec_id AS point_id, embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y, embedding[3]::DOUBLE * 100 AS z FROM embeddings)",
    "survey": """survey AS (SELECT n_regionkey::BIGINT AS bore_id, 100.0::DOUBLE * (row_number() OVER w - 1) AS md, least(90.0, 9.0::DOUBLE * (row_number() OVER w - 1))::DOUBLE AS inc, ((n_nationkey * 37) % 360)::DOUBLE AS azi
        FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey))""",
    "picks": "picks AS (SELECT o_custkey AS well, o_orderpriority AS name, min(date_diff('day', DATE '1992-01-01', o_orderdate::DATE))::DOUBLE AS md FROM orders GROUP BY 1, 2)",
}


def log_sql(name: str, mnemonic: str) -> str:
    return f"{name} AS (SELECT bore_id, md, arg_min(value, seq) AS value FROM curve WHERE mnemonic = '{mnemonic}' GROUP BY 1, 2)"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(SQL.get(p, p) for p in parts)
