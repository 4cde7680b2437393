"""Logs of a bore side by side: which are wanted, which are flags, all on one depth grid, and lanes as a viewer reads them."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.scalars import canonical_mnemonic
from . import path as paths
from .series import at_md, master_grid

#: Names and endings of curves that are flags.
FLAG_NAMES, FLAG_ENDS = ("FACIES", "LITH", "LITHOLOGY", "NETFLAG"), ("FLAG", "FACIES")


def _among(mnemonic: Column, names: list[str], aliases: dict[str, str] | None) -> Column:
    known = [n.strip().upper() for n in names]
    return F.upper(mnemonic).isin(known) | F.upper(canonical_mnemonic(mnemonic, aliases)).isin(known)


def wanted(mnemonic: Column, names: list[str] | None = None, aliases: dict[str, str] | None = None) -> Column:
    """Whether a curve is one of ``names``, by its own name or its family's, in any case; None wants all."""
    return F.lit(True) if names is None else _among(mnemonic, names, aliases)


def is_flag(mnemonic: Column, flags: list[str] | None = None, aliases: dict[str, str] | None = None) -> Column:
    """Whether a curve holds codes: by its family's name, or because ``flags`` lists it."""
    family = F.upper(canonical_mnemonic(mnemonic, aliases))
    by_name = family.isin(*FLAG_NAMES)
    for end in FLAG_ENDS:
        by_name = by_name | family.endswith(end)
    return by_name | _among(mnemonic, flags, aliases) if flags else by_name


def flag_codes(curves: DataFrame, bore: str = "bore_id") -> DataFrame:
    """``bore, mnemonic, codes``: the whole numbers that each curve's values round to, in order (half to even)."""
    each = curves.where("value IS NOT NULL AND abs(value) < double('Infinity')").select(bore, "mnemonic", F.rint("value").cast("long").alias("code")).distinct()
    return each.groupBy(bore, "mnemonic").agg(F.sort_array(F.collect_list("code")).alias("codes"))


def gather(curves: DataFrame, kb: DataFrame, path: DataFrame | None = None, names: list[str] | None = None, bore: str = "bore_id") -> DataFrame:
    """``bore, mnemonic, md, tvd, value``: every wanted log at every depth of its bore's wanted logs.

    Values are linear within a log and undefined outside; ``tvd`` is that of the bore's path, or the depth below the
    datum of ``kb`` (``bore, kb``) where there is none. A log needs one sample a depth.
    """
    own = curves.where(wanted(F.col("mnemonic"), names)).select(bore, "mnemonic", "md", "value")
    depths = master_grid(own, bore)
    down = F.col("md") - F.coalesce("kb", F.lit(0.0))
    if path is not None:
        depths = depths.join(paths.tvd_at(path, depths, bore), [bore, "md"], "left")
        down = F.coalesce("tvd", down)
    depths = depths.join(kb.select(bore, "kb"), bore, "left").select(bore, "md", down.alias("tvd"))
    targets = own.select(bore, "mnemonic").distinct().join(depths, bore)
    return at_md(own, targets, [bore, "mnemonic"]).select(bore, "mnemonic", "md", "tvd", "value")


@F.pandas_udf(StringType())
def lane(values: pd.Series) -> pd.Series:
    """Numbers as base64 of little-endian 32-bit floats; undefined ones are the quiet NaN."""

    def one(v) -> str | None:
        if v is None:
            return None
        x = np.array([np.nan if e is None else e for e in v], dtype="<f4")
        x[np.isnan(x)] = np.nan  # one pattern of bits for all
        return base64.b64encode(x.tobytes()).decode()

    return values.map(one)


def lanes(gathered: DataFrame, bore: str = "bore_id") -> DataFrame:
    """``bore, mnemonic, n, low, high, md, tvd, value``: the lanes of each log of :func:`gather`, in order of depth.

    ``low`` and ``high`` are the range of its values, 0 and 1 where it has none.
    """
    rows = F.array_sort(F.collect_list(F.struct("md", "tvd", "value")))
    good = F.when(F.abs("value") < float("inf"), F.col("value"))
    each = gathered.groupBy(bore, "mnemonic").agg(rows.alias("r"), F.coalesce(F.min(good), F.lit(0.0)).alias("low"), F.coalesce(F.max(good), F.lit(1.0)).alias("high"))
    return each.select(bore, "mnemonic", F.size("r").alias("n"), "low", "high", *(lane(F.col(f"r.{c}")).alias(c) for c in ("md", "tvd", "value")))


def names(curves: DataFrame, name: str = "mnemonic") -> DataFrame:
    """``seq, name``: the different names of logs in order without regard to case, equal ones by their own letters."""
    found = curves.select(F.col(name).alias("name")).where("name IS NOT NULL").distinct()
    return found.select((F.row_number().over(Window.orderBy(F.lower("name"), "name")) - 1).alias("seq"), "name")  # names of logs, a few
