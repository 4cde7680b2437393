"""Scalar expressions of the domain. Undefined values are NULL; every result that would be NaN is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres per unit.
METRES = {"m": 1.0, "ft": 0.3048}
#: Spellings of length units.
LENGTH_UNITS = {"m": "m", "metre": "m", "metres": "m", "meter": "m", "meters": "m", "ft": "ft", "feet": "ft", "foot": "ft", "f": "ft"}
#: Spellings of per cent.
PERCENT_UNITS = ("%", "percent", "pct", "p.u.", "pu")
#: Aliases of curve families.
FAMILIES = {
    "PHIE": ("PHIE", "PHI", "PHI_E", "EFFPHI", "PHIEF"),
    "PHIT": ("PHIT", "PHI_T", "TOTPHI"),
    "NPHI": ("NPHI", "TNPH", "NEU", "CNL"),
    "SW": ("SW", "SWE", "SUWI", "SW_E"),
    "SWT": ("SWT", "SW_T", "SWTOT"),
    "GR": ("GR", "GRC", "SGR", "CGR", "GAMMA"),
    "VSH": ("VSH", "VCL", "VSHALE", "VCLAY", "VSHGR"),
    "PERM": ("PERM", "K", "KLOGH", "KH", "PERMH"),
    "RHOB": ("RHOB", "DEN", "DENS", "ZDEN"),
    "DT": ("DT", "AC", "SONIC", "DTCO"),
    "RT": ("RT", "RES", "ILD", "LLD", "RDEP"),
    "NTG": ("NTG", "NET_GROSS", "N_G"),
}
#: Ranges of valid samples by family.
VALID = {
    **{x: (0.0, 1.0) for x in ("PHIE", "PHIT", "NPHI", "SW", "VSH", "NTG")},
    "GR": (0.0, 250.0), "RHOB": (1.0, 3.5), "DT": (40.0, 200.0), "PERM": (0.0, 1e6), "RT": (0.0, 1e6),
}


def defined(x: Column) -> Column:
    """NaN becomes NULL."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def ln(x: Column) -> Column:
    return F.ln(x)


def log10(x: Column) -> Column:
    return F.log10(x)


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def power(x: Column, n: float) -> Column:
    return defined(F.pow(x, F.lit(float(n))))


def clamp_min(x: Column, low: float) -> Column:
    """Undefined stays undefined (``greatest`` alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(float(low))))


def clamp(x: Column, low: float, high: float) -> Column:
    if low > high:
        raise ValueError(f"clamp: {low} > {high}")
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def divided(a: Column, b: Column) -> Column:
    """Division; by zero is undefined."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def sentinel(z: Column, declared: float | None = None) -> Column:
    """NULL where a grid file marks a node as undefined: at least 1e29, or the declared value to 1e-9."""
    bad = F.abs(z) >= 1e29
    if declared is not None:
        bad = bad | (F.abs(z - declared) <= 1e-9 * max(abs(declared), 1.0))
    return F.when(~bad, z)


def length_unit(unit: Column) -> Column:
    """``m`` or ``ft``, NULL if unknown."""
    u = F.lower(F.trim(unit))
    out = F.lit(None).cast("string")
    for name in ("m", "ft"):
        out = F.when(u.isin(*(k for k, v in LENGTH_UNITS.items() if v == name)), F.lit(name)).otherwise(out)
    return out


def convert_length(x: Column, unit: str, to: str) -> Column:
    return x * (METRES[unit] / METRES[to])


def area_m2(x: Column, unit: str) -> Column:
    return x * (METRES[unit] ** 2)


def is_percent(unit: Column) -> Column:
    return F.lower(F.trim(unit)).isin(*PERCENT_UNITS)


def harmonise_fraction(x: Column, unit: Column) -> Column:
    return F.when(is_percent(unit), x / 100.0).otherwise(x)


def canonical_mnemonic(name: Column, user: dict[str, str] | None = None) -> Column:
    """The family of a curve name: user aliases on the raw name first, then built-in ones without a year suffix."""
    bare = F.regexp_replace(F.trim(name), "_[0-9]{4}$", "")
    family = F.lit(None).cast("string")
    for to, names in FAMILIES.items():
        family = F.when(F.upper(bare).isin(*names), F.lit(to)).otherwise(family)
    out = F.coalesce(family, bare)
    for raw, to in (user or {}).items():
        out = F.when(F.lower(F.trim(name)) == raw.strip().lower(), F.lit(to)).otherwise(out)
    return out


def _within(family: Column, x: Column, otherwise: Column) -> Column:
    ok = otherwise
    for to, (low, high) in VALID.items():
        ok = F.when(F.upper(F.trim(family)) == to, x.between(low, high)).otherwise(ok)
    return ok


def in_range(family: Column, x: Column) -> Column:
    """Undefined is never in range; families without a range take any finite value."""
    finite = ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(_within(family, x, finite) & ~F.isnan(x), F.lit(False))


def out_of_range(family: Column, x: Column) -> Column:
    """Whether masking rejects a value: undefined ones, and families without a range, are never rejected."""
    return F.coalesce(~_within(family, defined(x), F.lit(True)), F.lit(False))


def mask_out_of_range(family: Column, x: Column) -> Column:
    return F.when(~out_of_range(family, x), x)


def net_flag(phi: Column, sw: Column, vsh: Column | None = None, phi_min: float = 0.08, sw_max: float = 0.5, vsh_max: float = 0.5) -> Column:
    """Two-valued: any undefined input is not net."""
    ok = (phi >= phi_min) & (sw <= sw_max)
    if vsh is not None:
        ok = ok & (vsh <= vsh_max)
    return F.coalesce(ok, F.lit(False))


def leverett_j(pc: Column, ift: Column, k: Column, phi: Column) -> Column:
    return F.when(phi > 0, divided(pc, ift) * sqrt(divided(k, phi)))


def id_key(x: Column) -> Column:
    """Lower case; slashes, hyphens and spaces are underscores."""
    return F.regexp_replace(F.lower(F.trim(x)), r"[/\- ]", "_")


def node_xy(i: Column, j: Column, g: dict) -> tuple[Column, Column]:
    """Map position of a grid node; ``g``: xori, yori, xinc, yinc, rotation_deg, yflip."""
    from math import cos, radians, sin

    c, s = cos(radians(g["rotation_deg"])), sin(radians(g["rotation_deg"]))
    di, dj = i * float(g["xinc"]), j * float(g["yinc"]) * (-1.0 if g.get("yflip") else 1.0)
    return g["xori"] + di * c - dj * s, g["yori"] + di * s + dj * c


def xy_to_ij(x: Column, y: Column, g: dict) -> tuple[Column, Column]:
    """Fractional node indices, unclamped; undefined if an increment is zero."""
    from math import cos, radians, sin

    if not g["xinc"] or not g["yinc"]:
        return F.lit(None).cast("double"), F.lit(None).cast("double")
    c, s = cos(radians(g["rotation_deg"])), sin(radians(g["rotation_deg"]))
    dx, dy = x - float(g["xori"]), y - float(g["yori"])
    return (dx * c + dy * s) / float(g["xinc"]), (dy * c - dx * s) * (-1.0 if g.get("yflip") else 1.0) / float(g["yinc"])
