"""Settings as frozen values: cut-offs of net rock, what loading makes of names, what a log view shows and how."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

from .functions.scalars import METRES
from .operators.sets import parse_hint


class _Spec:
    def to_dict(self) -> dict:
        """The fields and the name of the spec, ready for JSON."""
        return {"spec": type(self).__name__, **asdict(self)}

    @classmethod
    def from_dict(cls, given: dict):
        """The spec that :meth:`to_dict` describes; fields that are absent have their defaults."""
        if given.get("spec", cls.__name__) != cls.__name__:
            raise ValueError(f"this is a {given['spec']}, not a {cls.__name__}")
        return cls(**{f.name: given[f.name] for f in fields(cls) if f.name in given})

    def replace(self, **changes):
        """A copy with other values; unknown names raise."""
        return replace(self, **changes)


def _held(names):
    return names if names is None or isinstance(names, bool) else tuple(names)


@dataclass(frozen=True)
class NetSettings(_Spec):
    phi_min: float = 0.08
    sw_max: float = 0.5
    vsh_max: float = 0.5


@dataclass(frozen=True)
class IngestSpec(_Spec):
    """``aliases`` of curve names (raw to family), ``strat_hints`` (pairs or texts such as ``A < B``), a length ``unit``."""

    aliases: dict | None = None
    strat_hints: tuple = ()
    unit: str | None = None

    def __post_init__(self):
        if self.unit is not None and self.unit not in METRES:
            raise ValueError(f"unknown unit {self.unit}")
        hints = tuple(parse_hint(h) if isinstance(h, str) else tuple(h) for h in self.strat_hints or ())
        if any(len(h) != 2 for h in hints):
            raise ValueError("a hint is a pair of names")
        object.__setattr__(self, "strat_hints", hints)
        object.__setattr__(self, "aliases", {k.strip().lower(): v for k, v in (self.aliases or {}).items()})

    def __hash__(self):
        return hash((tuple(sorted(self.aliases.items())), self.strat_hints, self.unit))


@dataclass(frozen=True)
class ViewSpec(_Spec):
    """``curves`` (None: all), ``tops`` (none, all or some), the pick to flatten on, extra ``flags``, the porosity ``cutoff``."""

    curves: tuple | None = None
    tops: bool | tuple | None = None
    flatten_default: str | None = None
    flags: tuple | None = None
    cutoff: NetSettings | float | None = 0.08

    def __post_init__(self):
        for name in ("curves", "tops", "flags"):
            object.__setattr__(self, name, _held(getattr(self, name)))
        if isinstance(self.cutoff, dict):
            object.__setattr__(self, "cutoff", NetSettings.from_dict(self.cutoff))

    def to_dict(self) -> dict:
        return super().to_dict() | ({"cutoff": self.cutoff.to_dict()} if isinstance(self.cutoff, NetSettings) else {})

    def porosity_cutoff(self) -> float | None:
        return self.cutoff.phi_min if isinstance(self.cutoff, NetSettings) else self.cutoff


@dataclass(frozen=True)
class ViewSettings(_Spec):
    serve: bool = True
    save: str | None = None
