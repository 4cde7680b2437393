"""Windows, sessions, deduplication and last values over a stream of samples; each also runs on a static table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def tumbling(samples: DataFrame, size: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Count and sum by event type and window, tumbling or sliding."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = samples.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(samples: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of a user: bounds and number of samples."""
    out = samples.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(samples: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """One sample per key within the watermark."""
    marked = samples.withWatermark("ts", late)
    return marked.dropDuplicatesWithinWatermark(keys) if samples.isStreaming else samples.dropDuplicates(keys)


def last_values(samples: DataFrame) -> DataFrame:
    """The newest value of each user and type (complete or update output)."""
    return samples.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "value")).alias("m")).select("user_id", "event_type", F.col("m.ts").alias("ts"), F.col("m.value").alias("value"))


def paired(left: DataFrame, right: DataFrame, within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Samples of one user in two streams at most ``within`` after each other."""
    a = left.withWatermark("ts", late).select(F.col("user_id").alias("u"), F.col("ts").alias("t1"), F.col("value").alias("v1"))
    b = right.withWatermark("ts", late).select("user_id", F.col("ts").alias("t2"), F.col("value").alias("v2"))
    return a.join(b, F.expr(f"u = user_id AND t2 >= t1 AND t2 <= t1 + INTERVAL {within}")).select("user_id", "t1", "t2", "v1", "v2")
