"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of all bytes over its own bytes. A document's count inverts the
Poisson distribution of that mean at a uniform number hashed from seed and key, so it depends on nothing else and is
the same after a lost executor. Documents are exploded by their count and dealt and ordered by a hash of seed, key and
copy: a global shuffle. A null source is a source of its own; a null key is hashed as an empty string; a null text has
no bytes; a source without bytes repeats once. Equal keys get equal counts; texts of any length
are only measured and copied; an empty table gives an empty one.

Small mean rates are looked up in a table of the distribution. Larger ones, whose exp(-rate) underflows at last, are
inverted at the same number by summing probabilities from 12 deviations below the mean, the first one from its
logarithm. The steps are fewer than the copies that they yield.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 17
#: Target shares are the sources' bytes to this power where no weights are given.
ALPHA = 0.5
#: Up to this many sources (about 1 kB each) the table of rates is broadcast; beyond it both sides shuffle.
BROADCAST_SOURCES = 10_000
#: Mean rates above this have no table.
MOST = 500.0
#: Copies that one step of the explosion yields at most.
COPIES = 10_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def inverse(u: Column, rate: Column) -> Column:
    """The smallest count with a Poisson distribution function above ``u``, for rates above ``MOST``.

    The start is 200 at least there, where Stirling's series for log(k!) is exact to rounding.
    """
    k = F.floor(rate - 12 * F.sqrt(rate) - 30).cast("double")
    d = (rate - k) / k
    first = F.exp(k * (F.log1p(d) - d) - F.log(2 * math.pi * k) / 2 - 1 / (12 * k) + 1 / (360 * k * k * k))
    start = F.struct(first.alias("p"), first.alias("sum"), F.when(u >= first, k + 1).otherwise(k).alias("n"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * rate / (k + i)
        total = s["sum"] + p
        return F.struct(p.alias("p"), total.alias("sum"), F.when(u >= total, k + i + 1).otherwise(s["n"]).alias("n"))

    steps = F.sequence(F.lit(1), F.ceil(24 * F.sqrt(rate) + 60).cast("int"))
    return F.aggregate(steps, start, step, lambda s: s["n"]).cast("long")


def rates(docs: DataFrame, source: str = "source", text: str = "text", weights: dict[str, float] | None = None, alpha: float = ALPHA) -> DataFrame:
    """``source``, ``bytes``, ``rate`` and the Poisson distribution function ``cdf`` (null for rates above ``MOST``) of each source.

    ``weights`` names the sources that take part ("" is the null source); others have rate 0 and leave the mix.
    """
    if weights is not None and (min(weights.values(), default=0) < 0 or not any(weights.values())):
        raise ValueError("weights must not be negative, and one must be positive")
    sizes = docs.groupBy(F.col(source).cast("string").alias("source")).agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes"))
    if weights is None:
        weight = F.pow(F.col("bytes").cast("double"), F.lit(alpha))
    else:
        given = F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))))
        weight = F.coalesce(F.try_element_at(given, F.coalesce("source", F.lit(""))), F.lit(0.0))
    sizes = sizes.withColumn("weight", weight)
    total = sizes.agg(F.sum("bytes").cast("double").alias("all_bytes"), F.sum("weight").alias("all_weights"))
    sizes = sizes.crossJoin(F.broadcast(total))  # one row
    share = F.coalesce(F.try_divide("weight", "all_weights"), F.lit(0.0))
    empty = F.lit(1.0) if weights is None else (F.col("weight") > 0).cast("double")
    rate = F.when(F.col("bytes") == 0, empty).otherwise(share * F.col("all_bytes") / F.col("bytes"))
    sizes = sizes.withColumn("rate", rate)
    steps = F.sequence(F.lit(1), F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int"))
    first = F.exp(-F.col("rate"))
    start = F.struct(first.alias("p"), first.alias("sum"), F.array(first).alias("cdf"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * F.col("rate") / k
        return F.struct(p.alias("p"), (s["sum"] + p).alias("sum"), F.concat(s["cdf"], F.array(s["sum"] + p)).alias("cdf"))

    table = F.when(F.col("rate") <= MOST, F.aggregate(steps, start, step, lambda s: s["cdf"]))
    return sizes.withColumn("cdf", table).select("source", "bytes", "rate", "cdf")


def mix(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: dict[str, float] | None = None, seed: int = SEED,
    names: tuple[str, str, str] | None = ("n_copies", "copy", "mix_key"),
) -> DataFrame:
    """``docs`` replicated and globally shuffled, with the number of copies, the copy (from 0) and its place's key as ``names``.

    Columns of ``docs`` are never overwritten: a name that it has is refused. Without ``names`` only its columns come back.
    """
    if clash := {c.lower() for c in docs.columns} & {c.lower() for c in names or ()}:
        raise ValueError(f"the table has the columns {sorted(clash)} already: give others by names")
    table = rates(docs, source, text, weights).select(F.col("source").alias("_mix_source"), F.col("rate").alias("_mix_rate"), F.col("cdf").alias("_mix_cdf"))
    few = table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    # a hot source is a third of the rows at most times: broadcast where small, else adaptive execution splits it
    out = docs.join(F.broadcast(table) if few else table, F.col(source).cast("string").eqNullSafe(F.col("_mix_source")))
    out = out.withColumn("_mix_u", uniform(F.lit(str(seed)), name))
    looked_up = F.size(F.filter("_mix_cdf", lambda c: F.col("_mix_u") >= c)).cast("long")
    copies = F.when(F.col("_mix_rate") <= MOST, looked_up).otherwise(inverse(F.col("_mix_u"), F.col("_mix_rate")))
    out = out.withColumn("_mix_n", copies).where("_mix_n > 0")
    # by blocks, so that no array has all copies of a document
    out = out.withColumn("_mix_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_mix_n") - 1, F.lit(COPIES).cast("long"))))
    out = out.withColumn("_mix_copy", F.explode(F.sequence(F.col("_mix_block"), F.least(F.col("_mix_block") + COPIES, "_mix_n") - 1)))
    order = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), name, F.col("_mix_copy").cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")
    out = out.withColumn("_mix_key", order).drop("_mix_source", "_mix_rate", "_mix_cdf", "_mix_u", "_mix_block")
    out = out.repartition("_mix_key").sortWithinPartitions("_mix_key")
    own = [F.col(f"`{c}`") for c in docs.columns]
    return out.select(*own, *(F.col(c).alias(n) for c, n in zip(("_mix_n", "_mix_copy", "_mix_key"), names or (), strict=False)))


def query(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed to the square root of their sources' bytes."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "source", "n_chars", "n_copies", "copy", "mix_key")


#: DuckDB: `mixed` over `mixin(doc_id, text, source, n_chars)`.
MIXED_SQL = """
x_size AS (SELECT source, coalesce(sum(strlen(text)), 0)::DOUBLE AS bytes FROM mixin GROUP BY source),
x_rate AS (SELECT source, CASE WHEN bytes = 0 THEN 1.0 ELSE sqrt(bytes) / (SELECT sum(sqrt(bytes)) FROM x_size) * (SELECT sum(bytes) FROM x_size) / bytes END AS rate FROM x_size),
x_term AS (SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM x_rate, (SELECT unnest(range(0, 700)) AS k) WHERE k <= rate + 12 * sqrt(rate) + 30),
x_cdf AS (SELECT source, list(c) AS cdf FROM (SELECT source, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM x_term) GROUP BY source),
x_u AS (SELECT m.*, ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM mixin m),
x_n AS (SELECT x_u.*, len(list_filter(cdf, lambda c: u >= c))::BIGINT AS n_copies FROM x_u JOIN x_cdf ON x_u.source IS NOT DISTINCT FROM x_cdf.source),
x_c AS (SELECT x_n.*, unnest(range(0, n_copies))::BIGINT AS copy FROM x_n),
mixed AS (SELECT x_c.*, ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '') || '|' || copy), 1, 15))::BIGINT AS mix_key FROM x_c)"""
SQL = f"WITH mixin AS (SELECT * FROM documents), {MIXED_SQL} SELECT doc_id, source, n_chars, n_copies, copy, mix_key FROM mixed"
