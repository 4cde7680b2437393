"""A project: element tables by kind, each row tagged with its element's name, and a little metadata on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.sets import merge as merge_rows
from .sources import sinks

KINDS = ("surfaces", "points", "polygons", "curves", "tops", "contacts", "paths")


@dataclass
class Project:
    """``elements[kind]`` has a ``name`` column; names keep the order in which they came."""

    spark: SparkSession
    unit: str = "m"
    owner: str = ""
    elements: dict[str, DataFrame] = field(default_factory=dict)
    names: dict[str, list[str]] = field(default_factory=dict)
    tags: dict[str, list[str]] = field(default_factory=dict)
    history: list[str] = field(default_factory=list)

    def add(self, kind: str, name: str, df: DataFrame) -> Project:
        """Adds an element; a name that is there keeps its first element."""
        if kind not in KINDS:
            raise KeyError(f"unknown kind {kind}")
        if name in self.names.get(kind, []):
            return self
        row = df.withColumn("name", F.lit(name))
        self.elements[kind] = self.elements[kind].unionByName(row, allowMissingColumns=True) if kind in self.elements else row
        self.names.setdefault(kind, []).append(name)
        self.history.append(f"add {kind} {name}")
        return self

    def get(self, kind: str, name: str) -> DataFrame:
        """By full name, or by last path part if only one element has it."""
        known = self.names.get(kind, [])
        found = [n for n in known if n == name] or [n for n in known if n.rsplit("/", 1)[-1] == name]
        if len(found) != 1:
            raise KeyError(f"{kind} {name}: {'ambiguous' if found else 'not found'}")
        return self.elements[kind].where(F.col("name") == found[0])

    def folder(self, kind: str, path: str = "") -> list[str]:
        """Names directly under a folder; deeper ones show as ``part/``."""
        lead = f"{path.rstrip('/')}/" if path else ""
        rest = [n[len(lead) :] for n in self.names.get(kind, []) if n.startswith(lead)]
        return list(dict.fromkeys(r.split("/", 1)[0] + "/" * ("/" in r) for r in rest))

    def rename(self, kind: str, old: str, new: str) -> Project:
        known = self.names.get(kind, [])
        if old not in known:
            raise KeyError(f"{kind} {old}: not found")
        if new in known:
            raise ValueError(f"{kind} {new}: exists")
        self.elements[kind] = self.elements[kind].withColumn("name", F.when(F.col("name") == old, new).otherwise(F.col("name")))
        known[known.index(old)] = new
        self.history.append(f"rename {kind} {old} to {new}")
        return self

    def delete(self, kind: str, name: str) -> Project:
        if name not in self.names.get(kind, []):
            raise KeyError(f"{kind} {name}: not found")
        self.elements[kind] = self.elements[kind].where(F.col("name") != name)
        self.names[kind].remove(name)
        self.history.append(f"delete {kind} {name}")
        return self

    def inventory(self) -> dict[str, int]:
        return {k: len(self.names.get(k, [])) for k in KINDS if self.names.get(k)}

    def split(self, wanted: list[str]) -> Project:
        """The elements with these names."""
        out = Project(self.spark, self.unit, self.owner, tags={n: t for n, t in self.tags.items() if n in wanted})
        for kind, df in self.elements.items():
            if keep := [n for n in self.names[kind] if n in wanted]:
                out.elements[kind], out.names[kind] = df.where(F.col("name").isin(keep)), keep
        return out

    def export(self, tags: list[str]) -> Project:
        """The elements with any of these tags."""
        return self.split([n for n, t in self.tags.items() if set(t) & set(tags)])

    def merge(self, other: Project) -> Project:
        """The union; of two elements of one kind and name that of ``other`` stays."""
        out = Project(self.spark, self.unit, self.owner, tags={**self.tags, **other.tags}, history=[*self.history, *other.history])
        for kind in KINDS:
            a, b = self.elements.get(kind), other.elements.get(kind)
            if a is None and b is None:
                continue
            if a is not None and b is not None:
                out.elements[kind] = a.where(~F.col("name").isin(other.names[kind])).unionByName(b, allowMissingColumns=True)
            else:
                out.elements[kind] = a if b is None else b
            out.names[kind] = list(dict.fromkeys([*self.names.get(kind, []), *other.names.get(kind, [])]))
        return out

    def save(self, path: str) -> None:
        sinks.save_project(self.spark, self.elements, path, {"unit": self.unit, "owner": self.owner, "names": self.names, "tags": self.tags, "history": self.history})

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Project:
        meta = sinks.inspect(spark, path)["meta"]
        return cls(spark, meta["unit"], meta["owner"], sinks.open_project(spark, path, set(KINDS)), meta["names"], meta["tags"], meta["history"])


def overwrite_log(curves: DataFrame, new: DataFrame) -> DataFrame:
    """Curves with those of ``new`` in place of the ones of the same bore and mnemonic."""
    keyed = lambda df: df.withColumn("_m", F.lower("mnemonic"))
    return merge_rows(keyed(curves), keyed(new).select(*curves.columns, "_m"), ["bore_id", "_m"]).select(*curves.columns)


def log_bundle(curves: DataFrame, tops: DataFrame | None = None) -> DataFrame:
    """``bore_id, bundle``: a JSON document per bore with every log's range and its samples on the bore's depths.

    A bore's samples come together in one row, as the viewer needs them; a fleet of bores spreads over tasks.
    """
    stats = curves.groupBy("bore_id", "mnemonic").agg(
        F.min("value").alias("min"), F.max("value").alias("max"), F.array_sort(F.collect_list(F.struct("md", "value"))).alias("samples")
    )
    logs = stats.groupBy("bore_id").agg(F.array_sort(F.collect_list(F.struct("mnemonic", "min", "max", "samples"))).alias("logs"))
    if tops is not None:
        marks = tops.groupBy("bore_id").agg(F.array_sort(F.collect_list(F.struct("md", "name"))).alias("tops"))
        logs = logs.join(marks, "bore_id", "left")
    body = F.struct(F.lit("wells_logs").alias("kind"), F.lit(4).alias("schema"), *(c for c in logs.columns))
    return logs.select("bore_id", F.to_json(body).alias("bundle"))
