"""Sharding by jump consistent hashing: key and shard count decide; appending a shard moves rows only into it.

The published recurrence runs as a built-in fold over the shard numbers, with the 64-bit product in 32-bit halves
(ANSI arithmetic does not wrap). Slots are numbered without one task per shard: rows are dealt into a fixed number of
sub-ranges, each sub-range is numbered on its own, and a table of at most shards x sub-ranges counts gives the offsets.
Equal rows (key, size and CRC) are counted before they are shuffled and get slots one after another, so that a key that
many rows have is one row there. A null key shares the key 0's place; keys that are no integers are hashed by their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Up to this many rows (24 bytes each) the table of offsets is broadcast; it has at most shards x sub-ranges.
BROADCAST_ROWS = 1_000_000
#: Equal rows that one step yields at most.
COPIES = 10_000
#: Sub-ranges per shard.
SUB_RANGES = 4096
_MASK = 0xFFFFFFFF
#: Fixed value: the multiplier of the published generator.
_MULTIPLIER = 2862933555777941757


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """``state * multiplier + 1`` modulo 2**64 on two 32-bit halves."""
    mh, ml = _MULTIPLIER >> 32, _MULTIPLIER & _MASK
    m1, m0 = ml >> 16, ml & 0xFFFF
    h1, h0 = mh >> 16, mh & 0xFFFF

    def wrapped(x: Column, top: int, bottom: int) -> Column:
        return x * bottom + F.shiftleft((x * top).bitwiseAND(0xFFFF), 16)

    low_sum = low * m0 + F.shiftleft((low * m1).bitwiseAND(0xFFFF), 16) + 1
    carry = F.shiftright(low_sum, 32) + F.shiftright(low * m1, 16)
    new_high = (carry + wrapped(low, h1, h0) + wrapped(high, m1, m0)).bitwiseAND(_MASK)
    return new_high, low_sum.bitwiseAND(_MASK)


def jump(key: Column, shards: int) -> Column:
    """The shard of each 64-bit key that is not null, 0 to ``shards - 1``."""
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(_MASK).alias("lo"),
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
    )

    def step(s: Column, _: Column) -> Column:
        hi, lo = _next(s["hi"], s["lo"])
        to = F.floor((s["j"] + 1) * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + 1)))
        return F.when(s["j"] >= shards, s).otherwise(
            F.struct(hi.alias("hi"), lo.alias("lo"), s["j"].alias("b"), to.alias("j"))
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"]).cast("int")


def number_of(key: str, df: DataFrame) -> Column:
    """The key as a 64-bit number: integers as they are, others hashed by their text; null is 0."""
    if isinstance(df.schema[key].dataType, IntegralType):
        return F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long"))
    return F.when(F.col(key).isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.col(key).cast("string")))


def shard(df: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", sub_ranges: int = SUB_RANGES) -> DataFrame:
    """``key``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` for every row of ``df``.

    Other columns of ``df`` do not matter, whatever their names; an empty table gives an empty one.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        number_of(key, df).alias("_number"), F.col(key).alias("_key"),
        (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
    )
    # all that is returned follows from these columns, so equal rows are one group with a count
    same = rows.groupBy("_number", "_key", "size", "text_crc32").agg(F.count("*").alias("n"))
    # never null, so that the join puts no filter into one of its sides and both read one exchange
    sure = lambda c: F.coalesce(c, F.lit(0))
    groups = same.withColumns({
        "shard": sure(jump(F.col("_number"), shards)), "grown_shard": jump(F.col("_number"), shards + 1),
        "part": sure(F.pmod(F.xxhash64("_number", "size", "text_crc32"), F.lit(sub_ranges))),
    })
    counts = groups.groupBy("shard", "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("shard", "part").orderBy("_key", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("at", F.coalesce(F.sum("n").over(own), F.lit(0)))
    placed = placed.join(F.broadcast(offsets) if shards * sub_ranges <= BROADCAST_ROWS else offsets, ["shard", "part"])
    # by blocks, so that no array has all copies of a row
    placed = placed.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
    placed = placed.withColumn("_copy", F.explode(F.sequence(F.col("_block"), F.least(F.col("_block") + COPIES, "n") - 1)))
    return placed.select(
        F.col("_key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("offset") + F.col("at") + F.col("_copy")).alias("slot"), "grown_shard",
    )


def query(spark, sf_dir: str) -> DataFrame:
    """All documents in 8 shards."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
