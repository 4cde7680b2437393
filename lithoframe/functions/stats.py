"""The fixed bundle of statistics, plain and weighted, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAMES = ("count", "mean", "min", "max", "std", "sum", "p10", "p50", "p90")


def bundle(v: Column) -> list[Column]:
    """Count, mean, extremes, population deviation, sum (0 if empty) and exact linear percentiles of defined values."""
    return [
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"),
        F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"),
        F.percentile(v, 0.1).alias("p10"), F.percentile(v, 0.5).alias("p50"), F.percentile(v, 0.9).alias("p90"),
    ]


def geomean(v: Column) -> Column:
    """Geometric mean of positive values."""
    return F.exp(F.avg(F.when(v > 0, F.ln(v))))


def weighted(df: DataFrame, keys: list[str], value: str, weight: str, also: tuple[Column, ...] = ()) -> DataFrame:
    """The bundle with weights: pairs that are undefined or not positive do not count; percentiles are nearest-rank.

    One shuffle on ``keys``; the running weight and the mean are windows over the same partitioning. ``also`` has further
    aggregates over all rows of a group; groups without a pair are left out.
    """
    ok = F.col(value).isNotNull() & (F.col(weight) > 0)
    own = Window.partitionBy(*keys)
    run = own.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    used = df.withColumns({"_v": F.when(ok, F.col(value).cast("double")), "_w": F.when(ok, F.col(weight).cast("double"))})
    used = used.withColumns({"_total": F.sum("_w").over(own), "_mean": F.sum(F.col("_v") * F.col("_w")).over(own) / F.sum("_w").over(own), "_run": F.sum("_w").over(run)})
    at = lambda p: F.min(F.when(F.col("_run") >= p * F.col("_total") - 1e-12 * F.col("_total"), F.col("_v")))
    v, w = F.col("_v"), F.col("_w")
    out = used.groupBy(*keys).agg(
        F.count("_v").alias("count"), F.max("_mean").alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.sqrt(F.sum(w * (v - F.col("_mean")) * (v - F.col("_mean"))) / F.max("_total")).alias("std"),
        F.sum(w * v).alias("sum"), at(0.1).alias("p10"), at(0.5).alias("p50"), at(0.9).alias("p90"), *also,
    )
    return out.where(F.col("count") > 0)


#: Tables of up to so many rows are aggregated in one pass; in larger ones a percentile is narrowed down until its range
#: has so many rows. Ranges of a narrowing step, and the most groups whose ranges are broadcast (0.5 KB each).
MOST_ROWS, RANGES, BROADCAST_GROUPS = 1_000_000, 64, 10_000
PERCENTILES = {"p10": 0.1, "p50": 0.5, "p90": 0.9}


def _near(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else table


def _settle(rows: DataFrame, targets: DataFrame, parts: int, most: int) -> DataFrame:
    """``_k, _name, _at``: the least ``_v`` of group ``_k`` up to which the weights ``_w`` reach ``_t``, for each target.

    Approximate quantiles cut a group into ranges, the weights of the ranges tell which of them a target lies in, and
    only that range goes on: as it is if it has one value, ranked by distinct values if it has at most ``most`` rows, else
    cut again. Every round is a pass over what is left and is stored, so that no task holds or sorts more than ``most``
    rows of a target, however large or uneven the groups are. Groups without rows have no result.
    """
    from ..operators.graph import cut

    out, first, v, w = [], True, F.col("_v"), F.col("_w")
    targets = targets.select("_k", "_name", "_t", F.lit(0.0).alias("_before"))
    while True:
        cuts = cut(rows.groupBy("_k").agg(F.percentile_approx(v, [k / parts for k in range(1, parts)], max(8 * parts, 1000)).alias("_cuts")))
        # a value that is a cut is a range of its own, so that every round leaves something behind
        place = 2 * F.size(F.filter("_cuts", lambda c: c < v)) + F.array_contains("_cuts", v).cast("int")
        dealt = rows.join(_near(cuts), "_k").select("_k", "_v", "_w", place.alias("_b"))
        ranges = dealt.groupBy("_k", "_b").agg(F.sum(w).alias("_w"), F.count("*").alias("_n"), F.min(v).alias("_low"), F.max(v).alias("_high"))
        line = Window.partitionBy("_k").orderBy("_b")
        runs = ranges.withColumn("_run", F.sum("_w").over(line)).withColumn("_last", F.row_number().over(Window.partitionBy("_k").orderBy(F.desc("_b"))) == 1)
        met = runs.join(targets, "_k").withColumn("_run", F.col("_before") + F.col("_run"))
        # sums in another order may differ in the last bit, so the last range takes what no range reaches
        hits = met.where((F.col("_run") >= F.col("_t")) | F.col("_last")).groupBy("_k", "_name", "_t").agg(
            F.min(F.struct("_b", "_run", "_w", "_n", "_low", "_high")).alias("_h")
        )
        hits = cut(hits.select("_k", "_name", "_t", F.col("_h._b").alias("_b"), (F.col("_h._run") - F.col("_h._w")).alias("_before"), F.col("_h._n").alias("_n"), F.col("_h._low").alias("_low"), F.col("_h._high").alias("_high")))
        own = F.struct("_k", "_name").alias("_k") if first else F.col("_k")
        out.append(hits.where("_low = _high").select(own, F.col("_low").alias("_at")))
        going = hits.where("_low < _high")
        left = going.agg(F.max("_n")).head()[0]
        if left is None:
            break
        rows = dealt.join(_near(going.select("_k", "_b", "_name")), ["_k", "_b"]).select(own, "_v", "_w")
        targets = going.select(own, "_name", "_t", "_before")
        first = False
        if left <= most:
            each = rows.groupBy("_k", "_v").agg(F.sum("_w").alias("_w")).join(_near(targets), "_k")
            run = F.col("_before") + F.sum("_w").over(Window.partitionBy("_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
            out.append(each.withColumn("_run", run).groupBy("_k").agg(F.coalesce(F.min(F.when(F.col("_run") >= F.col("_t"), v)), F.max(v)).alias("_at")))
            break
        rows = cut(rows)
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every.select("_k._k", "_k._name", "_at")


def _rows(df: DataFrame, keys: list[str], value: str, weight: str | None) -> DataFrame:
    ok = F.col(value).isNotNull() if weight is None else F.col(value).isNotNull() & (F.col(weight) > 0)
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    return df.withColumns({"_k": group, "_v": F.when(ok, F.col(value).cast("double")), "_w": F.when(ok, F.lit(1.0) if weight is None else F.col(weight).cast("double"))})


def _located(rows: DataFrame, totals: DataFrame, wanted: dict[str, float], linear: bool, parts: int, most: int) -> DataFrame:
    """``_k`` and a column for each wanted percentile; ``totals`` has ``_k`` and ``_total``."""
    total = F.col("_total")
    if linear:
        place = {n: p * (total - 1) for n, p in wanted.items()}
        targets = {f"{n}{side}": round_(at) + 1 for n, at in place.items() for side, round_ in (("a", F.floor), ("b", F.ceil))}
    else:
        targets = {n: p * total - 1e-12 * total for n, p in wanted.items()}
    each = totals.where("_total > 0").select("_k", F.inline(F.array(*(F.struct(F.lit(n).alias("_name"), t.cast("double").alias("_t")) for n, t in targets.items()))))
    found = _settle(rows.where("_v IS NOT NULL").select("_k", "_v", "_w"), each, parts, most)
    found = found.groupBy("_k").agg(*(F.max(F.when(F.col("_name") == n, F.col("_at"))).alias(f"_{n}") for n in targets)).join(totals.select("_k", "_total"), "_k")
    if linear:
        return found.select("_k", *((F.col(f"_{n}a") + (F.col(f"_{n}b") - F.col(f"_{n}a")) * (at - F.floor(at))).alias(n) for n, at in place.items()))
    return found.select("_k", *(F.col(f"_{n}").alias(n) for n in targets))


def percentiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], weight: str | None = None, parts: int = RANGES, most: int = MOST_ROWS) -> DataFrame:
    """``keys`` and a column for each of ``wanted`` (name to fraction): exact percentiles of few groups of any size.

    Linear between neighbours without a weight, nearest-rank with one, as in :func:`bundle` and :func:`weighted`. Groups
    without a value (or a positive weight) are left out; a fraction outside 0 to 1 is refused.
    """
    from ..operators.graph import cut

    if not all(0 <= p <= 1 for p in wanted.values()):
        raise ValueError("percentiles are fractions from 0 to 1")
    n = df.limit(most + 1).count()
    rows = _rows(df, keys, value, weight)
    if n <= most and weight is None:
        return rows.where("_v IS NOT NULL").groupBy(*keys).agg(*(F.percentile("_v", p).alias(name) for name, p in wanted.items())).where(F.col(next(iter(wanted))).isNotNull())
    rows = cut(rows.select("_k", "_v", "_w"))
    totals = cut(rows.groupBy("_k").agg(F.sum("_w").alias("_total")))
    return _located(rows, totals, wanted, weight is None, parts, most).select(*(F.col("_k")[k].alias(k) for k in keys), *wanted)


def spread(df: DataFrame, keys: list[str], value: str, weight: str | None = None, also: tuple[Column, ...] = (), parts: int = RANGES, most: int = MOST_ROWS) -> DataFrame:
    """:func:`bundle`, or :func:`weighted` with ``weight``, for few groups of any size.

    Up to ``most`` rows are aggregated in one pass. More are read once for the aggregates, which are mergeable, and stored
    narrow; their percentiles are narrowed down (:func:`_settle`), so that no task holds more than ``most`` rows of a group.
    """
    from ..operators.graph import cut

    if df.limit(most + 1).count() <= most:
        if weight is not None:
            return weighted(df, keys, value, weight, also)
        return df.groupBy(*keys).agg(*bundle(F.col(value).cast("double")), *also)
    rows = _rows(df, keys, value, weight)
    v, w = F.col("_v"), F.col("_w")
    facts = cut(rows.groupBy("_k").agg(F.count(v).alias("count"), F.sum(w).alias("_total"), F.sum(v * w).alias("_sum"), F.min(v).alias("min"), F.max(v).alias("max"), *also).withColumn("mean", F.try_divide("_sum", "_total")))
    narrow = cut(rows.where(v.isNotNull()).select("_k", "_v", "_w"))
    square = narrow.join(_near(facts.select("_k", "mean")), "_k").groupBy("_k").agg(F.sum(w * (v - F.col("mean")) * (v - F.col("mean"))).alias("_sq"))
    found = _located(narrow, facts, PERCENTILES, weight is None, parts, most)
    out = facts.join(square, "_k", "left").join(found, "_k", "left").withColumn("std", F.sqrt(F.try_divide("_sq", "_total")))
    out = out.withColumn("_sum", F.coalesce("_sum", F.lit(0.0))) if weight is None else out.where("count > 0")
    more = [c for c in facts.columns if c not in ("_k", "_total", "_sum", "count", "mean", "min", "max")]
    return out.select(*(F.col("_k")[k].alias(k) for k in keys), "count", "mean", "min", "max", "std", F.col("_sum").alias("sum"), *PERCENTILES, *more)


def characterise(v: Column, kind: str = "normal") -> list[Column]:
    """Parameters of a distribution; fewer than two values are deterministic."""
    n = F.count(v)
    if kind == "triangular":
        p = [F.percentile(v, x) for x in (0.1, 0.5, 0.9)]
    elif kind == "lognormal":
        log = F.when(v > 0, F.ln(v))
        n = F.count(log)
        p = [F.avg(log), F.stddev_pop(log), F.lit(None).cast("double")]
    else:
        p = [F.avg(v), F.stddev_pop(v), F.lit(None).cast("double")]
    name = F.when((n < 2) | (F.stddev_pop(v) == 0), F.lit("deterministic")).otherwise(F.lit(kind))
    return [F.avg(v).alias("value"), name.alias("dist"), *(x.alias(f"p{i}") for i, x in enumerate(p, 1))]
