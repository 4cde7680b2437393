"""Lazy log expressions: channels, comparisons and arithmetic that compile to one Column.

Comparisons are two-valued: an undefined operand makes them false, and ``~`` of that is true.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import FAMILIES, defined, divided
from ..operators.series import interpolate


@dataclass(frozen=True)
class Expr:
    """A node: ``op`` and its arguments (nodes or plain values)."""

    op: str
    args: tuple = ()

    def __add__(self, o: Any) -> Expr:
        return Expr("add", (self, o))

    def __radd__(self, o: Any) -> Expr:
        return Expr("add", (o, self))

    def __sub__(self, o: Any) -> Expr:
        return Expr("sub", (self, o))

    def __rsub__(self, o: Any) -> Expr:
        return Expr("sub", (o, self))

    def __mul__(self, o: Any) -> Expr:
        return Expr("mul", (self, o))

    __rmul__ = __mul__

    def __truediv__(self, o: Any) -> Expr:
        return Expr("div", (self, o))

    def __gt__(self, o: Any) -> Expr:
        return Expr("gt", (self, o))

    def __ge__(self, o: Any) -> Expr:
        return Expr("ge", (self, o))

    def __lt__(self, o: Any) -> Expr:
        return Expr("lt", (self, o))

    def __le__(self, o: Any) -> Expr:
        return Expr("le", (self, o))

    def equals(self, o: Any) -> Expr:
        return Expr("eq", (self, o))

    def differs(self, o: Any) -> Expr:
        return Expr("ne", (self, o))

    def __and__(self, o: Expr) -> Expr:
        return Expr("and", (self, o))

    def __or__(self, o: Expr) -> Expr:
        return Expr("or", (self, o))

    def __invert__(self) -> Expr:
        return Expr("not", (self,))

    def is_finite(self) -> Expr:
        return Expr("finite", (self,))

    def is_null(self) -> Expr:
        """The log is absent or the depth out of its span; an undefined sample is not null."""
        return Expr("null", (self,))

    def not_null(self) -> Expr:
        return ~self.is_null()


def channel(name: str) -> Expr:
    return Expr("channel", (name,))


def to_dict(e: Any) -> Any:
    return {"op": e.op, "args": [to_dict(a) for a in e.args]} if isinstance(e, Expr) else e


def from_dict(d: Any) -> Any:
    return Expr(d["op"], tuple(from_dict(a) for a in d["args"])) if isinstance(d, dict) else d


def channels(e: Any) -> set[str]:
    if not isinstance(e, Expr):
        return set()
    return {e.args[0]} if e.op == "channel" else set().union(*(channels(a) for a in e.args), set())


def resolve(name: str, known: list[str], aliases: dict[str, str] | None = None) -> str:
    """The log that ``name`` means: itself, by alias, or the only one of its family."""
    low = {k.lower(): k for k in known}
    if name.lower() in low:
        return low[name.lower()]
    to = {a.lower(): b for a, b in (aliases or {}).items()}.get(name.lower())
    if to and to.lower() in low:
        return low[to.lower()]
    family = next((f for f, names in FAMILIES.items() if name.upper() in names), None)
    same = [k for k in known if family and k.upper() in FAMILIES[family]]
    if len(same) == 1:
        return same[0]
    raise KeyError(f"{name}: {'ambiguous, ' + ', '.join(same) if same else 'unknown log'}")


_ARITHMETIC = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": divided}
_COMPARE = {"gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b}


def compile(e: Any, column: dict[str, Column], in_span: dict[str, Column]) -> Column:  # noqa: A001
    """The Column of an expression over aligned channels and their span flags."""
    if not isinstance(e, Expr):
        return F.lit(float(e))
    if e.op == "channel":
        return defined(column[e.args[0]])
    if e.op == "null":
        return ~F.coalesce(in_span[e.args[0].args[0]], F.lit(False))
    a = [compile(x, column, in_span) for x in e.args]
    if e.op in _ARITHMETIC:
        return _ARITHMETIC[e.op](*a)
    if e.op in _COMPARE:
        return F.coalesce(_COMPARE[e.op](*a), F.lit(False))
    if e.op == "finite":
        return a[0].isNotNull()
    return {"and": lambda: a[0] & a[1], "or": lambda: a[0] | a[1], "not": lambda: ~a[0]}[e.op]()


def _names(curves: DataFrame, wanted: set[str], aliases: dict[str, str] | None = None) -> list[str]:
    """The logs there are that any of the wanted names may mean; others are not looked at."""
    want = {n.lower() for n in wanted} | {b.lower() for a, b in (aliases or {}).items() if a.lower() in {n.lower() for n in wanted}}
    family = {m.lower() for names in FAMILIES.values() if want & {m.lower() for m in names} for m in names}
    return [r[0] for r in curves.select("mnemonic").where(F.lower("mnemonic").isin(*(want | family))).distinct().collect()]


def evaluate(curves: DataFrame, e: Expr, basis: str, method: str = "linear", bore: str = "bore_id") -> DataFrame:
    """``bore, md, value`` of an expression at the depths of the log ``basis``; other logs are read by ``method``."""
    known = _names(curves, {basis, *channels(e)})
    of = lambda name: curves.where(F.col("mnemonic") == name).groupBy(bore, "md").agg(F.min_by("value", "seq").alias("value"))
    base = resolve(basis, known)
    out = of(base).withColumnRenamed("value", "_c0")
    names = {n: resolve(n, known) for n in sorted(channels(e))}
    column, spans = {}, {}
    for k, (n, name) in enumerate(names.items(), 1):
        if name == base:
            column[n], spans[n] = F.col("_c0"), F.lit(True)
            continue
        one = of(name)
        span = one.groupBy(bore).agg(F.min("md").alias(f"_lo{k}"), F.max("md").alias(f"_hi{k}"))
        out = interpolate(one, out, [bore], method, out=f"_c{k}").join(span, bore, "left")
        column[n], spans[n] = F.col(f"_c{k}"), F.col("md").between(F.col(f"_lo{k}"), F.col(f"_hi{k}"))
    return out.select(bore, "md", compile(e, column, spans).alias("value"))


def assign(curves: DataFrame, name: str, e: Expr, basis: str, method: str = "linear", bore: str = "bore_id") -> tuple[DataFrame, DataFrame]:
    """``curves`` with the log ``name`` computed for every bore that has all logs it needs, in place of one of that name;
    and a report ``bore, status, samples``: created, or skipped for want of a log."""
    wanted = {basis, *channels(e)}
    known = _names(curves, wanted)
    need = sorted({resolve(n, known) for n in wanted})
    has = curves.groupBy(bore).agg(F.count_distinct(F.when(F.col("mnemonic").isin(need), F.col("mnemonic"))).alias("_n"))
    ready = has.where(F.col("_n") == len(need)).select(bore)
    got = evaluate(curves.join(ready, bore, "left_semi"), e, basis, method, bore).withColumn("mnemonic", F.lit(name))
    seq = F.row_number().over(Window.partitionBy(bore).orderBy("md")).cast("long")
    new = got.withColumn("seq", seq)
    kept = curves.join(ready.withColumn("mnemonic", F.lit(name)), [bore, "mnemonic"], "left_anti")
    made = new.groupBy(bore).agg(F.count("value").alias("samples"))
    report = has.select(bore).join(made, bore, "left").select(bore, F.when(F.col("samples").isNull(), "skipped").otherwise("created").alias("status"), F.coalesce("samples", F.lit(0).cast("long")).alias("samples"))
    return kept.unionByName(new, allowMissingColumns=True), report


def where(curves: DataFrame, name: str, predicate: Expr, bore: str = "bore_id") -> DataFrame:
    """Samples of one log at whose depth a predicate holds."""
    keep = evaluate(curves, predicate, name, bore=bore).where("value").select(bore, "md")
    known = _names(curves, {name})
    log = curves.where(F.col("mnemonic") == resolve(name, known)).groupBy(bore, "md").agg(F.min_by("value", "seq").alias("value"))
    return log.join(keep, [bore, "md"], "left_semi")
