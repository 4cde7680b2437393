"""Columns of points, polygons, logs and grids: filters by any predicate, arithmetic, assignment, promotion.

Undefined is NULL and propagates; NaN and infinite results are undefined.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import divided

#: Columns that place a point or name it; they are no attributes.
PLACES = ("x", "y", "i", "j")


def attribute_name(name: str) -> str:
    """A name as attributes have it: trimmed, in lower case, with ``_`` for blanks and dashes."""
    made = name.strip().lower().replace(" ", "_").replace("-", "_")
    if not made:
        raise ValueError("an attribute needs a name")
    return made


def condition(df: DataFrame, predicate: Column | str | Callable) -> Column:
    """A predicate as a column: a column or SQL text as it is, which Spark optimises and pushes down.

    A function that takes columns of ``df`` by the names of its parameters becomes a pandas UDF over just these, a batch
    at a time; what it says of a row must be true for the row to pass.
    """
    if isinstance(predicate, str):
        return F.expr(predicate)
    if isinstance(predicate, Column):
        return predicate
    names = list(inspect.signature(predicate).parameters)
    if not names or set(names) - set(df.columns):
        raise ValueError(f"a predicate's parameters are columns; there are {', '.join(df.columns)}")

    @F.pandas_udf("boolean")
    def says(*parts: pd.Series) -> pd.Series:
        return pd.Series(predicate(**dict(zip(names, parts, strict=True)))).astype("boolean").fillna(False).astype(bool)

    return says(*(F.col(f"`{n}`") for n in names))


def where(df: DataFrame, predicate: Column | str | Callable) -> DataFrame:
    """Rows for which the predicate is true, with all their columns."""
    return df.where(condition(df, predicate))


def defined(value: Column) -> Column:
    """A number, or NULL where it is none."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def combined(left: Column, op: str, right: Column | float) -> Column:
    """``left`` and ``right`` by ``+ - * / **``; a division by zero and a power without a value are undefined."""
    a, b = left.cast("double"), (right if isinstance(right, Column) else F.lit(float(right))).cast("double")
    made = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: divided(a, b), "**": lambda: F.pow(a, b)}
    if op not in made:
        raise ValueError(f"unknown operation: {op}")
    return defined(made[op]())


def assign(df: DataFrame, name: str, value: Column | float | DataFrame, key: str = "point_id") -> DataFrame:
    """``df`` with an attribute, replaced if it is there: a number for all rows, a column, or a table of ``key`` and ``value``.

    Rows that such a table does not have get an undefined value; a key that it has twice raises. Coordinates are not
    attributes, but z may be assigned.
    """
    name = attribute_name(name)
    if name in PLACES or name == key:
        raise ValueError(f"{name} is not an attribute")
    if isinstance(value, DataFrame):
        once = value.groupBy(key).agg(F.count("*").alias("_n"), F.first("value").alias("_v"))
        sure = F.when(F.col("_n") == 1, F.col("_v")).when(F.col("_n") > 1, F.raise_error(F.lit("a key has two values")).cast("double"))
        return df.drop(name).join(once, key, "left").withColumn(name, defined(sure.cast("double"))).drop("_n", "_v")
    made = value if isinstance(value, Column) else F.lit(float(value))
    return df.withColumn(name, defined(made.cast("double")))


def promote(grid: DataFrame, lane: str, was: str = "primary") -> DataFrame:
    """A grid whose lane ``lane`` is its value z; the value that was there becomes the lane ``was``."""
    lane, was = attribute_name(lane), attribute_name(was)
    if lane not in grid.columns or lane in (*PLACES, "z"):
        raise ValueError(f"no lane {lane}")
    if was in grid.columns and was != lane:
        raise ValueError(f"there is a lane {was} already")
    rest = [c for c in grid.columns if c not in (lane, "z")]
    return grid.select(*rest, F.col("z").alias(was), F.col(lane).alias("z"))
