"""Depth-ordered series: as-of interpolation, resampling, stencils. One shuffle on the series key, no range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _bracket(series: DataFrame, targets: DataFrame, keys: list[str], md: str, value: str, wide: bool = False) -> DataFrame:
    """Targets with the sources around them: ``p`` strictly before, ``q`` at or after (and their neighbours ``pp``, ``qq``)."""
    own = Window.partitionBy(*keys)
    point = F.struct(F.col(md).alias("md"), F.col(value).alias("v"))
    src = series.select(*keys, F.col(md).alias("_md"), F.lit(1).alias("_src"), point.alias("_at"))
    order = own.orderBy("_md")
    if wide:
        src = src.withColumns({"_before": F.lag("_at").over(order), "_after": F.lead("_at").over(order)})
    first, second = F.row_number().over(order), F.count("*").over(own)
    src = src.withColumns({"_k": first, "_n": second})
    extra = [c for c in targets.columns if c not in (*keys, md)]
    to = targets.select(*keys, F.col(md).alias("_md"), F.lit(0).alias("_src"), F.struct(F.lit(1).alias("_"), *extra).alias("_t"))
    both = src.unionByName(to, allowMissingColumns=True)
    line = own.orderBy("_md", "_src")
    past, coming = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(1, Window.unboundedFollowing)
    cols = {"p": F.last("_at", ignorenulls=True).over(past), "q": F.first("_at", ignorenulls=True).over(coming), "k": F.first("_k", ignorenulls=True).over(coming), "n": F.first("_n", ignorenulls=True).over(coming)}
    if wide:
        cols |= {"pp": F.last(F.when(F.col("_at").isNotNull(), F.struct("_before")), ignorenulls=True).over(past)["_before"], "qq": F.first(F.when(F.col("_at").isNotNull(), F.struct("_after")), ignorenulls=True).over(coming)["_after"]}
    # the source after the first, for a target on the first source itself
    cols["second"] = F.first(F.when(F.col("_k") == 2, F.col("_at")), ignorenulls=True).over(coming)
    out = both.withColumns(cols).where("_src = 0")
    return out.select(*keys, F.col("_md").alias(md), *(F.col(f"_t.{c}").alias(c) for c in extra), *cols)


def at_md(series: DataFrame, targets: DataFrame, keys: list[str], md: str = "md", value: str = "value", out: str = "value") -> DataFrame:
    """Linear value at each target depth; undefined outside the span, and where either end of the bracket is.

    The bracket ends at the first source at or below the target, so an exact hit still reads the source before it; on the
    first source the bracket is the first two. Equal depths give the earlier value.
    """
    b = _bracket(series, targets, keys, md, value)
    p = F.when(F.col("p").isNull() & (F.col("q.md") == F.col(md)), F.col("q")).otherwise(F.col("p"))
    q = F.when(F.col("p").isNull() & (F.col("q.md") == F.col(md)), F.coalesce("second", "q")).otherwise(F.col("q"))
    b = b.withColumns({"_p": p, "_q": q})
    span = F.col("_q.md") - F.col("_p.md")
    lerp = F.when(span <= 0, F.col("_p.v")).otherwise(F.col("_p.v") + (F.col("_q.v") - F.col("_p.v")) * F.try_divide(F.col(md) - F.col("_p.md"), span))
    return b.withColumn(out, lerp).drop("p", "q", "k", "n", "second", "_p", "_q")


def interpolate(series: DataFrame, targets: DataFrame, keys: list[str], method: str, md: str = "md", value: str = "value", out: str = "value") -> DataFrame:
    """``nearest`` (ties to the lower), ``previous``, ``next``, ``linear`` or ``spline``; exact hits are verbatim."""
    b = _bracket(series, targets, keys, md, value, wide=method == "spline")
    x, p, q = F.col(md), F.col("p"), F.col("q")
    hit = q["md"] == x
    inside = p.isNotNull() & q.isNotNull()
    span = q["md"] - p["md"]
    t = F.try_divide(x - p["md"], span)
    line = F.when(span <= 0, p["v"]).otherwise(p["v"] + (q["v"] - p["v"]) * t)
    if method == "nearest":
        got = F.when(x - p["md"] <= q["md"] - x, p["v"]).otherwise(q["v"])
    elif method == "previous":
        got = p["v"]
    elif method == "next":
        got = q["v"]
    elif method == "linear":
        got = line
    elif method == "spline":
        a, d = F.col("pp"), F.col("qq")
        m0, m1 = F.try_divide(q["v"] - a["v"], q["md"] - a["md"]), F.try_divide(d["v"] - p["v"], d["md"] - p["md"])
        t2, t3 = t * t, t * t * t
        curve = (2 * t3 - 3 * t2 + 1) * p["v"] + (t3 - 2 * t2 + t) * span * m0 + (3 * t2 - 2 * t3) * q["v"] + (t3 - t2) * span * m1
        got = F.when(a.isNull() | d.isNull(), line).otherwise(curve)
    else:
        raise ValueError(method)
    names = ["p", "q", "k", "n", "second"] + (["pp", "qq"] if method == "spline" else [])
    return b.withColumn(out, F.when(hit, q["v"]).when(inside, got)).drop(*names)


def regular_depths(series: DataFrame, keys: list[str], step: float, md: str = "md") -> DataFrame:
    """``lo + k * step`` over each series' span; none if the step is not positive."""
    if step <= 0:
        return series.select(*keys, md).limit(0)
    span = series.groupBy(*keys).agg(F.min(md).alias("lo"), F.max(md).alias("hi"))
    k = F.sequence(F.lit(0), F.floor((F.col("hi") - F.col("lo")) / step).cast("int"))
    return span.select(*keys, "lo", F.explode(k).alias("k")).select(*keys, (F.col("lo") + F.col("k") * F.lit(float(step))).alias(md))


def resample(series: DataFrame, keys: list[str], step: float, md: str = "md", value: str = "value") -> DataFrame:
    return at_md(series, regular_depths(series, keys, step, md), keys, md, value)


def master_grid(curves: DataFrame, bore: str = "bore_id", md: str = "md") -> DataFrame:
    """The sorted union of all depths of a bore."""
    return curves.select(bore, md).distinct()


def dz_weights(df: DataFrame, keys: list[str], md: str = "md", out: str = "w", order: tuple = ()) -> DataFrame:
    """Midpoint steps with full steps at the ends; a single sample weighs 1."""
    own = Window.partitionBy(*keys)
    line = own.orderBy(md, *order)
    before, after, n = F.lag(md).over(line), F.lead(md).over(line), F.count("*").over(own)
    w = F.when(n == 1, F.lit(1.0)).when(before.isNull(), after - F.col(md)).when(after.isNull(), F.col(md) - before).otherwise((after - before) / 2)
    return df.withColumn(out, w)


def representative_thickness(df: DataFrame, keys: list[str], depth: str = "md", out: str = "h", order: tuple = ()) -> DataFrame:
    """Midpoint steps with half steps at the ends; a single sample has none."""
    line = Window.partitionBy(*keys).orderBy(depth, *order)
    d = F.col(depth)
    return df.withColumn(out, (F.coalesce(F.lead(depth).over(line), d) - F.coalesce(F.lag(depth).over(line), d)) / 2)


def increasing(df: DataFrame, keys: list[str], md: str = "md", order: str = "seq") -> DataFrame:
    """Series whose depths do not strictly increase in reading order, with the first offending row's order."""
    line = Window.partitionBy(*keys).orderBy(order)
    bad = df.withColumn("_before", F.lag(md).over(line)).where(F.col(md) <= F.col("_before"))
    return bad.groupBy(*keys).agg(F.min(order).alias("at"))


