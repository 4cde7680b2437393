"""Well paths by minimum curvature: a lag, an increment and a running sum per bore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tangent(inc: Column, azi: Column) -> tuple[Column, Column, Column]:
    """North, east and down components."""
    i, a = F.radians(inc), F.radians(azi)
    return F.sin(i) * F.cos(a), F.sin(i) * F.sin(a), F.cos(i)


def dogleg(a: tuple, b: tuple) -> Column:
    dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    return F.acos(F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0)))


def ratio_factor(beta: Column) -> Column:
    return F.when(beta < 1e-4, 1 + beta * beta / 12).otherwise(2 / beta * F.tan(beta / 2))


def positions(survey: DataFrame, x: float = 0.0, y: float = 0.0, kb: float = 0.0, bore: str = "bore_id") -> DataFrame:
    """``bore, md, x, y, z, tn, te, td``: z is elevation (negative down), the first station lies at its depth below kb."""
    own = Window.partitionBy(bore).orderBy("md")
    t = tangent(F.col("inc"), F.col("azi"))
    s = survey.withColumns(dict(zip(("tn", "te", "td"), t, strict=True)))
    s = s.withColumns({f"_{c}": F.lag(c).over(own) for c in ("md", "tn", "te", "td")})
    before, now = tuple(F.col(f"_{c}") for c in ("tn", "te", "td")), tuple(F.col(c) for c in ("tn", "te", "td"))
    half = (F.col("md") - F.col("_md")) / 2 * ratio_factor(dogleg(before, now))
    run = own.rowsBetween(Window.unboundedPreceding, 0)
    moved = [F.coalesce(F.sum(half * (p + q)).over(run), F.lit(0.0)) for p, q in zip(before, now, strict=True)]
    first = F.first("md").over(run)
    return s.select(bore, "md", (x + moved[1]).alias("x"), (y + moved[0]).alias("y"), (-(first - kb) - moved[2]).alias("z"), "tn", "te", "td")


def position_at(path: DataFrame, targets: DataFrame, bore: str = "bore_id") -> DataFrame:
    """Position on the arc (or chord, without tangents) at each target depth; undefined outside the path."""
    station = F.struct("md", "x", "y", "z", "tn", "te", "td")
    src = path.select(bore, F.col("md").alias("_md"), F.lit(0).alias("_s"), station.alias("_p"))
    to = targets.select(bore, F.col("md").alias("_md"), F.lit(1).alias("_s"))
    own = Window.partitionBy(bore).orderBy("_md", "_s")
    both = src.unionByName(to, allowMissingColumns=True)
    both = both.withColumns({
        "p": F.last("_p", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)),
        "q": F.first("_p", ignorenulls=True).over(own.rowsBetween(1, Window.unboundedFollowing)),
    }).where("_s = 1")
    p, q, md = F.col("p"), F.col("q"), F.col("_md")
    span = q["md"] - p["md"]
    f = F.try_divide(md - p["md"], span)
    a, b = (tuple(s[c] for c in ("tn", "te", "td")) for s in (p, q))
    beta = dogleg(a, b)
    small = beta < 1e-4
    wa, wb = F.when(small, 1 - f).otherwise(F.sin((1 - f) * beta) / F.sin(beta)), F.when(small, f).otherwise(F.sin(f * beta) / F.sin(beta))
    at = [wa * s + wb * t for s, t in zip(a, b, strict=True)]
    half = (md - p["md"]) / 2 * ratio_factor(beta * f)
    arc = [p["x"] + half * (a[1] + at[1]), p["y"] + half * (a[0] + at[0]), p["z"] - half * (a[2] + at[2])]
    chord = [p[c] + (q[c] - p[c]) * f for c in "xyz"]
    curved = p["tn"].isNotNull() & q["tn"].isNotNull()
    on = p["md"] == md
    return both.select(bore, md.alias("md"), *(F.when(on, p[c]).when(curved, u).otherwise(v).alias(c) for c, u, v in zip("xyz", arc, chord, strict=True)))


def tvd_at(path: DataFrame, targets: DataFrame, bore: str = "bore_id") -> DataFrame:
    return position_at(path, targets, bore).select(bore, "md", (-F.col("z")).alias("tvd"))


def md_at_tvd(path: DataFrame, targets: DataFrame, bore: str = "bore_id") -> DataFrame:
    """The shallowest measured depth at which each target ``tvd`` is crossed, linear in z."""
    own = Window.partitionBy(bore).orderBy("md")
    seg = path.select(bore, F.col("md").alias("m0"), (-F.col("z")).alias("t0"), F.lead("md").over(own).alias("m1"), (-F.lead("z").over(own)).alias("t1")).where("m1 IS NOT NULL")
    met = targets.join(seg, bore).where((F.col("tvd") >= F.least("t0", "t1")) & (F.col("tvd") <= F.greatest("t0", "t1")))
    md = F.when(F.col("t1") == F.col("t0"), F.col("m0")).otherwise(F.col("m0") + (F.col("m1") - F.col("m0")) * F.try_divide(F.col("tvd") - F.col("t0"), F.col("t1") - F.col("t0")))
    return met.groupBy(bore, "tvd").agg(F.min(md).alias("md"))


def chord_md(nodes: DataFrame, bore: str = "bore_id", order: str = "seq") -> DataFrame:
    """Cumulative straight-line distance along nodes with x, y and z."""
    own = Window.partitionBy(bore).orderBy(order)
    step = F.sqrt(sum((F.col(c) - F.lag(c).over(own)) * (F.col(c) - F.lag(c).over(own)) for c in "xyz"))
    s = nodes.withColumn("_step", F.coalesce(step, F.lit(0.0)))
    return s.withColumn("md", F.sum("_step").over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def steer(plan: DataFrame, step: float = 30.0, bore: str = "bore_id") -> DataFrame:
    """Stations every ``step`` from ``md, inc, azi, length, build, turn`` (rates per 100)."""
    k = F.sequence(F.lit(0), F.ceil(F.col("length") / step).cast("int"))
    s = plan.withColumn("_d", F.explode(k)).withColumn("_d", F.least(F.col("_d") * step, F.col("length")))
    return s.select(bore, (F.col("md") + F.col("_d")).alias("md"), (F.col("inc") + F.col("build") * F.col("_d") / 100).alias("inc"), (F.col("azi") + F.col("turn") * F.col("_d") / 100).alias("azi"))


def md_range(path: DataFrame, bore: str = "bore_id") -> DataFrame:
    """The measured depths between which each bore's path is known."""
    return path.groupBy(bore).agg(F.min("md").alias("md_min"), F.max("md").alias("md_max"))


def _increasing(df: DataFrame, bore: str) -> DataFrame:
    before = F.lag("md").over(Window.partitionBy(bore).orderBy("seq"))
    bad = F.when(F.col("md") <= before, F.raise_error(F.lit("measured depth must increase strictly")).cast("double"))
    return df.withColumn("md", F.coalesce(bad, F.col("md")))


def from_input(kind: str, rows: DataFrame, x: float = 0.0, y: float = 0.0, kb: float = 0.0, bore: str = "bore_id", step: float = 30.0) -> DataFrame:
    """``bore, md, x, y, z, tn, te, td`` from any of the inputs that a path may have; depths must increase in order of ``seq``.

    ``stations`` (seq, md, inc, azi) and ``hold`` or ``steer`` plans (md, inc, azi, length, build, turn; one row a bore) start at the
    wellhead and follow minimum curvature; ``positioned`` rows (seq, md, x, y, z, inc, azi) are taken as they are;
    ``xyz`` rows (seq, x, y, z) are chords, whose depth is their length.
    """
    if kind == "xyz":
        nothing = {c: F.lit(None).cast("double") for c in ("tn", "te", "td")}
        return chord_md(rows, bore).withColumns(nothing).select(bore, "md", "x", "y", "z", "tn", "te", "td")
    if kind == "positioned":
        t = tangent(F.col("inc"), F.col("azi"))
        return _increasing(rows, bore).select(bore, "md", "x", "y", "z", *(c.alias(n) for c, n in zip(t, ("tn", "te", "td"), strict=True)))
    if kind in ("hold", "steer"):
        plan = rows if kind == "steer" else rows.withColumns({"build": F.lit(0.0), "turn": F.lit(0.0)})
        return positions(steer(plan, step if kind == "steer" else 1e308, bore), x, y, kb, bore)
    if kind != "stations":
        raise ValueError(f"unknown kind of path: {kind}")
    return positions(_increasing(rows, bore), x, y, kb, bore)


def positioned_log(curve: DataFrame, path: DataFrame, bore: str = "bore_id") -> DataFrame:
    """Samples of a log with their position on the bore's path; undefined outside of it."""
    at = position_at(path, curve.select(bore, "md").distinct(), bore)
    return curve.join(at, [bore, "md"], "left")
