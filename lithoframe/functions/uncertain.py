"""Values with a distribution and a provenance, as structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _value(value: Column, dist: str, p1=None, p2=None, p3=None, provenance: str = "measured") -> Column:
    p = [F.lit(None).cast("double") if x is None else x.cast("double") for x in (p1, p2, p3)]
    return F.struct(value.cast("double").alias("value"), F.lit(dist).alias("dist"), *(x.alias(f"p{i}") for i, x in enumerate(p, 1)), F.lit(provenance).alias("provenance"))


def hard(x: Column) -> Column:
    return _value(x, "deterministic")


def defaulted(x: Column) -> Column:
    return _value(x, "deterministic", provenance="default")


def assumed(x: Column) -> Column:
    return _value(x, "deterministic", provenance="assumed")


def uniform(low: Column, high: Column) -> Column:
    return _value((low + high) / 2, "uniform", low, high)


def triangular(low: Column, mode: Column, high: Column) -> Column:
    return _value(mode, "triangular", low, mode, high)


def normal(mean: Column, std: Column) -> Column:
    return _value(mean, "normal", mean, std)


def lognormal(mu: Column, sigma: Column) -> Column:
    return _value(F.exp(mu), "lognormal", mu, sigma)


def with_provenance(u: Column, provenance: str) -> Column:
    return u.withField("provenance", F.lit(provenance))
