"""Wells with several bores: which bore a well's logs and tops go through, and which path a bore follows.

Bores are rows ``well, bore, has_path`` where the main bore's label is empty; paths are rows of stations with ``path_id``
and ``load_seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAIN = ""


def bore_id(well: Column, bore: Column) -> Column:
    """The well's id for its main bore, else the id and the bore's label."""
    label = F.coalesce(bore, F.lit(MAIN))
    return F.when(label == MAIN, well).otherwise(F.concat(well, F.lit(" "), label))


def multibore(bores: DataFrame) -> DataFrame:
    """Wells of which more than one bore has a path, with their number."""
    return bores.where("has_path").groupBy("well").agg(F.countDistinct("bore").alias("paths")).where("paths > 1")


def resolve(bores: DataFrame, defaults: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """``well, bore, how``: the default bore if the well has it, else the only one with a path, else the main bore.

    ``strict`` raises for a well with several paths and no default, where a caller must choose.
    """
    one = bores.groupBy("well").agg(
        F.count_distinct(F.when(F.col("has_path"), F.col("bore"))).alias("_n"), F.min(F.when(F.col("has_path"), F.col("bore"))).alias("_only"), F.collect_set("bore").alias("_all")
    )
    if defaults is None:
        one = one.withColumn("_default", F.lit(None).cast("string"))
    else:
        one = one.join(defaults.select("well", F.col("bore").alias("_default")).dropDuplicates(["well"]), "well", "left")
    chosen = F.coalesce(F.array_contains("_all", F.col("_default")), F.lit(False))
    how = F.when(chosen, F.lit("default")).when(F.col("_n") == 1, F.lit("only path"))
    if strict:
        how = how.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("choose a bore of "), F.col("well").cast("string"))).cast("string"))
    how = how.otherwise(F.lit("main"))
    bore = F.when(chosen, F.col("_default")).when(F.col("_n") == 1, F.col("_only")).otherwise(F.lit(MAIN))
    return one.select("well", bore.alias("bore"), how.alias("how"))


def view_bore(bores: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """``well, bore``: the bore whose logs a view shows: the default one, else the only one with logs (``has_logs``), else the main bore.

    A default that the well does not have raises, as do several bores with logs and no default.
    """
    fail = lambda text: F.raise_error(F.concat(F.lit(text), F.col("well").cast("string"))).cast("string")
    with_logs = F.when(F.col("has_logs"), F.col("bore"))
    one = bores.groupBy("well").agg(F.count_distinct(with_logs).alias("_n"), F.min(with_logs).alias("_only"), F.collect_set("bore").alias("_all"))
    own = defaults.select("well", F.col("bore").alias("_default")).dropDuplicates(["well"]) if defaults is not None else None
    one = one.join(own, "well", "left") if own is not None else one.withColumn("_default", F.lit(None).cast("string"))
    bore = F.when(F.col("_default").isNotNull() & ~F.array_contains("_all", F.col("_default")), fail("no such default bore of ")).when(F.col("_default").isNotNull(), F.col("_default"))
    bore = bore.when(F.col("_n") > 1, fail("choose a bore of ")).when(F.col("_n") == 1, F.col("_only")).otherwise(F.lit(MAIN))
    return one.select("well", bore.alias("bore"))


def active(paths: DataFrame, chosen: DataFrame | None = None, bore: str = "bore_id") -> DataFrame:
    """Stations of each bore's active path: the chosen one if the bore has it, else the one that was added last."""
    known = paths.groupBy(bore, "path_id").agg(F.max("load_seq").alias("load_seq"))
    if chosen is not None:
        known = known.join(chosen.select(bore, "path_id", F.lit(True).alias("_chosen")).distinct(), [bore, "path_id"], "left")
    else:
        known = known.withColumn("_chosen", F.lit(None).cast("boolean"))
    best = known.groupBy(bore).agg(F.max(F.struct(F.coalesce("_chosen", F.lit(False)).alias("c"), "load_seq", "path_id")).alias("b"))
    return paths.join(best.select(bore, F.col("b.path_id").alias("path_id")), [bore, "path_id"], "left_semi")


def order_to_bores(tops: DataFrame, order: list[str], bore: str = "bore_id") -> DataFrame:
    """Tops with their place in a stratigraphic order as ``ord``; names outside it have none."""
    if not order:
        return tops.withColumn("ord", F.lit(None).cast("int"))
    places = tops.sparkSession.createDataFrame(list(enumerate(order)), "ord int, name string")
    return tops.drop("ord").join(F.broadcast(places) if len(order) <= 100_000 else places, "name", "left")
