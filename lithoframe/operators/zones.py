"""Zones between tops: half-open intervals that tile a bore, so clipping is one ordered window, not a range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import bundle, geomean, spread, weighted
from . import graph
from .series import at_md, dz_weights


def zones_from_tops(tops: DataFrame, td: DataFrame, bore: str = "bore_id", name: str = "name", md: str = "md", rank: str = "ord") -> DataFrame:
    """``bore, name, zone_ord, top_md, base_md``: the base is the next top, or the bore's total depth, or undefined.

    Tops at one depth stand in stratigraphic order (absent ranks last); the last of them owns the interval.
    """
    line = Window.partitionBy(bore).orderBy(md, F.coalesce(F.col(rank), F.lit(2**31 - 1)), name)
    out = tops.join(td.select(bore, F.col("td").alias("_td")), bore, "left")
    return out.select(
        bore, F.col(name).alias("name"), F.coalesce(F.col(rank), F.lit(2**31 - 1)).cast("int").alias("zone_ord"), F.col(md).alias("top_md"),
        F.coalesce(F.lead(md).over(line), F.col("_td")).alias("base_md"),
    )


def clip(samples: DataFrame, zones: DataFrame, bore: str = "bore_id", md: str = "md") -> DataFrame:
    """Samples with the zone whose ``[top_md, base_md)`` holds them; zones of no thickness hold none."""
    mark = zones.where("top_md < base_md").select(F.col(bore), F.col("top_md").alias("_md"), F.lit(0).alias("_s"), F.struct("name", "zone_ord", "top_md", "base_md").alias("_z"))
    rows = samples.select(F.col(bore), F.col(md).alias("_md"), F.lit(1).alias("_s"), F.struct(*(c for c in samples.columns)).alias("_r"))
    line = Window.partitionBy(bore).orderBy("_md", "_s").rowsBetween(Window.unboundedPreceding, 0)
    both = mark.unionByName(rows, allowMissingColumns=True).withColumn("_z", F.last("_z", ignorenulls=True).over(line))
    inside = both.where((F.col("_s") == 1) & (F.col("_md") < F.col("_z.base_md")))
    return inside.select("_r.*", F.col("_z.name").alias("zone"), F.col("_z.zone_ord").alias("zone_ord"), F.col("_z.top_md").alias("top_md"), F.col("_z.base_md").alias("base_md"))


def top(zones: DataFrame, name: str, bore: str = "bore_id") -> DataFrame:
    """The interval of the top of that name (whatever its case) in each bore that has it: of several the uppermost."""
    line = Window.partitionBy(bore).orderBy("top_md", "zone_ord", "name")
    own = zones.where(F.lower("name") == name.lower()).withColumn("_n", F.row_number().over(line)).where("_n = 1").drop("_n")
    return own.withColumn("thickness_md", F.col("base_md") - F.col("top_md"))


def interval_log(samples: DataFrame, zones: DataFrame, name: str, bore: str = "bore_id", md: str = "md") -> DataFrame:
    """Samples within the interval of a top, ``[top_md, base_md)``; none where its base is undefined.

    A bore has one such interval, so this is an equi-join on bores.
    """
    own = top(zones, name, bore).select(bore, "top_md", "base_md")
    return samples.join(own, bore).where((F.col(md) >= F.col("top_md")) & (F.col(md) < F.col("base_md"))).drop("top_md", "base_md")


def picks(zones: DataFrame, names: list[str] | None = None, tvd: str = "top_tvd", bore: str = "bore_id") -> DataFrame:
    """``bore, seq, name, tvd`` of zones from top to down, all or those named (whatever their case and outer blanks).

    Depths must grow strictly from pick to pick of a bore, else it raises; a zone that a bore does not have is no pick.
    """
    own = zones if names is None else zones.where(F.lower(F.trim("name")).isin([n.strip().lower() for n in names]))
    line = Window.partitionBy(bore).orderBy("zone_ord", "top_md", "name")
    before = F.lag(tvd).over(line)
    sure = F.when(before.isNull() | (F.col(tvd) > before), F.col(tvd)).otherwise(F.raise_error(F.concat(F.lit("picks are not in order of depth at "), F.col("name"))).cast("double"))
    return own.select(bore, (F.row_number().over(line) - 1).alias("seq"), "name", sure.alias("tvd"))


def zone_stats(samples: DataFrame, zones: DataFrame, value: str = "value", bore: str = "bore_id") -> DataFrame:
    """One row per bore and zone with the bundle; zones without samples have count 0."""
    got = clip(samples, zones, bore).groupBy(bore, "zone").agg(*bundle(F.col(value)))
    every = zones.select(bore, F.col("name").alias("zone"), "zone_ord")
    out = every.join(got, [bore, "zone"], "left")
    return out.withColumns({"count": F.coalesce("count", F.lit(0).cast("long")), "sum": F.coalesce("sum", F.lit(0.0))})


def net_samples(value: DataFrame, phi: DataFrame, sw: DataFrame, flag, bore: str = "bore_id", vsh: DataFrame | None = None) -> DataFrame:
    """Samples of ``value`` that are net by ``flag(phi, sw)``, or ``flag(phi, sw, vsh)``, all read at the value's depths."""
    at = value.withColumnRenamed("value", "_v")
    for name, log in (("phi_at", phi), ("sw_at", sw), *((("vsh_at", vsh),) if vsh is not None else ())):
        at = at_md(log, at, [bore], out=name)
    inputs = [F.col("phi_at"), F.col("sw_at"), *((F.col("vsh_at"),) if vsh is not None else ())]
    return at.withColumnRenamed("_v", "value").where(flag(*inputs))


def net_zone_stats(net: DataFrame, zones: DataFrame, value: str = "value", bore: str = "bore_id", mean: str = "arithmetic") -> DataFrame:
    """One row per bore and zone with the bundle of its net samples; ``mean`` may be ``geometric`` (of positive values)."""
    if mean not in ("arithmetic", "geometric"):
        raise ValueError(f"unknown mean: {mean}")
    out = zone_stats(net, zones, value, bore) if mean == "arithmetic" else None
    if out is not None:
        return out
    got = clip(net, zones, bore).groupBy(bore, "zone").agg(geomean(F.col(value)).alias("mean"), F.count(F.when(F.col(value) > 0, 1)).alias("count"))
    every = zones.select(bore, F.col("name").alias("zone"), "zone_ord")
    return every.join(got, [bore, "zone"], "left").withColumn("count", F.coalesce("count", F.lit(0).cast("long")))


def _weighed(samples: DataFrame, zones: DataFrame, bore: str, weigh: bool = True) -> DataFrame:
    inside = clip(samples, zones, bore).withColumn("_gross", F.col("base_md") - F.col("top_md"))
    return dz_weights(inside, [bore, "zone"], out="w") if weigh else inside.withColumn("w", F.lit(1.0))


def zone_table(samples: DataFrame, zones: DataFrame, value: str = "value", bore: str = "bore_id", weigh: bool = True) -> DataFrame:
    """Zone by bore with weighted statistics, thickness ``gross`` and sample count; empty cells are left out.

    Weights are the midpoint steps of the samples given, per bore and zone, before anything is pooled.
    """
    inside = _weighed(samples, zones, bore, weigh)
    return weighted(inside, [bore, "zone", "zone_ord"], value, "w", (F.first("_gross").alias("gross"), F.count("*").alias("samples")))


def pooled_zone_table(samples: DataFrame, zones: DataFrame, value: str = "value", bore: str = "bore_id") -> DataFrame:
    """One row per zone over all bores: raw samples pooled with their bores' weights, gross averaged over bores.

    Clipped samples are stored once, as zones are few and any size: no task has a whole zone.
    """
    each = Window.partitionBy(bore, "zone")
    inside = _weighed(samples, zones, bore).withColumn("_share", 1 / F.count("*").over(each))
    inside = graph.cut(inside.select("zone", value, "w", "_gross", "_share"))
    gross = F.sum(F.col("_gross") * F.col("_share")) / F.sum("_share")
    return spread(inside, ["zone"], value, "w", (gross.alias("gross"), F.count("*").alias("samples")))


def zone_table_all(samples: DataFrame, zones: DataFrame, value: str = "value", bore: str = "bore_id", label: str = "all") -> DataFrame:
    """The zone table of every bore, and a row per zone over all of them whose bore is ``label``."""
    own = zone_table(samples, zones, value, bore).withColumn(bore, F.col(bore).cast("string"))
    pooled = pooled_zone_table(samples, zones, value, bore)
    rank = zones.groupBy(F.col("name").alias("zone")).agg(F.min("zone_ord").alias("zone_ord"))
    return own.unionByName(pooled.join(rank, "zone").withColumn(bore, F.lit(label)))


def zone_geomean(samples: DataFrame, zones: DataFrame, value: str = "value", bore: str = "bore_id") -> DataFrame:
    return clip(samples, zones, bore).groupBy(bore, "zone").agg(geomean(F.col(value)).alias("geomean"), F.count(value).alias("count"))


def pivot(table: DataFrame, column: str, bores: list, bore: str = "bore_id", decimals: int = 3) -> DataFrame:
    """Wide form: a row per zone, a column per given bore."""
    return table.groupBy("zone").pivot(bore, bores).agg(F.round(F.first(column), decimals))


