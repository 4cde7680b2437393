"""Net pay, curve picks, tops routing and model inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import METRES, canonical_mnemonic, id_key, net_flag
from ..functions.stats import characterise
from .series import representative_thickness


def pick_curve(curves: DataFrame, family: str, bore: str = "bore_id", load: str = "load_seq", aliases: dict[str, str] | None = None) -> DataFrame:
    """Samples of the first log of each bore, in load order, whose family is ``family``."""
    own = curves.where(canonical_mnemonic(F.col("mnemonic"), aliases) == family)
    first = own.groupBy(bore).agg(F.min(F.struct(load, "mnemonic")).alias("_f")).select(bore, F.col(f"_f.{load}").alias(load), F.col("_f.mnemonic").alias("mnemonic"))
    return own.join(first, [bore, load, "mnemonic"], "left_semi")


def paired(phi: DataFrame, sw: DataFrame, bore: str = "bore_id") -> DataFrame:
    """Porosity and saturation of each bore paired by position, as long as both last."""
    line = Window.partitionBy(bore).orderBy("md")
    a = phi.select(bore, "md", F.col("value").alias("phi"), F.row_number().over(line).alias("_k"))
    b = sw.select(bore, F.col("value").alias("sw"), F.row_number().over(line).alias("_k"))
    return a.join(b, [bore, "_k"]).drop("_k")


def net_pay(samples: DataFrame, bore: str = "bore_id", depth: str = "md", **cuts: float) -> DataFrame:
    """``net_pay`` and ``ntg`` per bore from ``phi`` and ``sw``."""
    h = representative_thickness(samples, [bore], depth).withColumn("_net", net_flag(F.col("phi"), F.col("sw"), **cuts))
    pay, span = F.coalesce(F.sum(F.when(F.col("_net"), F.col("h"))), F.lit(0.0)), F.max(depth) - F.min(depth)
    ntg = F.when((F.count("*") < 2) | (span <= 0), F.lit(0.0)).otherwise(F.try_divide(pay, span))
    return h.groupBy(bore).agg(pay.alias("net_pay"), ntg.alias("ntg"))


def model_inputs(samples: DataFrame, unit: str = "m", bore: str = "bore_id", kind: str = "normal", **cuts: float) -> DataFrame:
    """``input, value, dist, p1, p2, p3``: net pay (metres) and net-to-gross over bores, net porosity and saturation over all bores."""
    per_bore = net_pay(samples, bore, **cuts)
    net = samples.where(net_flag(F.col("phi"), F.col("sw"), **cuts))
    long = (
        per_bore.select(F.lit("net_pay").alias("input"), (F.col("net_pay") * METRES[unit]).alias("v"))
        .union(per_bore.select(F.lit("net_to_gross"), F.col("ntg")))
        .union(net.select(F.lit("porosity"), F.col("phi")))
        .union(net.select(F.lit("water_saturation"), F.col("sw")))
    )
    return long.groupBy("input").agg(*characterise(F.col("v"), kind))


def route_tops(records: DataFrame, wells: DataFrame, bores: DataFrame | None = None) -> DataFrame:
    """Records (``rec, well``) with the loaded well (``id, load_seq``) that their name means and the rest as bore.

    A name means a well if it equals its id or continues it after an underscore, in normal form; the well that was
    loaded first wins. Names meet only their own prefixes, so this is an equi-join. With ``bores`` (``id, bore``) a bore
    that its well does not have is the main one, ''.
    """
    r = records.withColumn("_key", id_key(F.col("well")))
    parts = F.split("_key", "_")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "_"))
    w = wells.select(F.col("id"), "load_seq", id_key(F.col("id")).alias("_prefix"))
    met = r.select("*", F.explode(prefixes).alias("_prefix")).join(w, "_prefix")
    best = met.groupBy("rec").agg(F.min(F.struct("load_seq", "id", "well")).alias("b"))
    rest = F.trim(F.substring(F.col("b.well"), F.char_length("b.id") + 2, F.char_length("b.well")))
    out = best.select("rec", F.col("b.id").alias("id"), rest.alias("bore"))
    if bores is None:
        return out
    known = bores.select("id", "bore", F.lit(True).alias("_known")).distinct()
    return out.join(known, ["id", "bore"], "left").select("rec", "id", F.when(F.col("_known"), F.col("bore")).otherwise("").alias("bore"))


def reservoir_area(rings: DataFrame, unit: str = "m", poly: str = "poly_id") -> DataFrame:
    """``input, area``: the area within the outline in square metres; undefined where there is no outline."""
    from ..functions.scalars import area_m2
    from .spatial import edges

    own = edges(rings, poly).groupBy(poly).agg((F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1"))) / 2).alias("a"))
    return own.agg(area_m2(F.sum("a"), unit).alias("area")).select(F.lit("area").alias("input"), "area")
