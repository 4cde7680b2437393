"""Streams with state of their own: last values that expire, and zone statistics of a curve that only grows.

Last values are a stateful operator with timers (RocksDB state store, ``spark.sql.streaming.stateStore.providerClass``).
Zone statistics keep a table of partial states, one part a batch, which replace each other by batch id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import zones as zoned

#: Fixed value: the state store that stateful processors need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Newest(StatefulProcessor):
    """The newest sample of a key; a key without samples for ``hold`` milliseconds of event time is given up."""

    def __init__(self, hold: int):
        self.hold = hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("newest", "ts long, value double")

    def _row(self, key, ts: int, value, expired: bool) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [key[0]], "event_type": [key[1]], "ts": [pd.Timestamp(ts, unit="us")], "value": [value], "expired": [expired]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.state.get() if self.state.exists() else None
        ts, value = old if old is not None else (None, None)
        for part in rows:
            at = part["ts"].astype("datetime64[us]").astype("int64")
            order = pd.DataFrame({"ts": at, "value": part["value"]}).sort_values(["ts", "value"], na_position="first")
            newest = order.iloc[-1]
            found = (int(newest["ts"]), None if pd.isna(newest["value"]) else float(newest["value"]))
            if ts is None or (found[0], found[1] is not None, found[1] or 0.0) > (ts, value is not None, value or 0.0):
                ts, value = found
        if old is not None and (ts, value) == tuple(old):
            return
        self.state.update((ts, value))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(ts // 1000 + self.hold)
        yield self._row(key, ts, value, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            ts, value = self.state.get()
            self.state.clear()
            yield self._row(key, ts, value, True)

    def close(self) -> None:
        pass


def newest_values(samples: DataFrame, late: str = "1 hour", hold_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """``user_id, event_type, ts, value, expired`` of a stream: the newest value whenever it changes, and once when it expires.

    A value expires when the watermark (``late`` behind the newest sample of all) is ``hold_ms`` past it; its key begins
    anew after that. Samples behind the watermark are left out. Of several samples at one time the largest value counts,
    an undefined one last. Output mode is ``update`` or ``append``.
    """
    keyed = samples.select("user_id", "event_type", "ts", F.col("value").cast("double").alias("value")).withWatermark("ts", late).groupBy("user_id", "event_type")
    kinds = dict(samples.dtypes)
    schema = f"user_id {kinds['user_id']}, event_type {kinds['event_type']}, ts timestamp, value double, expired boolean"
    return keyed.transformWithStateInPandas(statefulProcessor=_Newest(hold_ms), outputStructType=schema, outputMode="Update", timeMode="EventTime")


class ZoneStates:
    """Statistics of zones over a curve that comes in batches, under ``path`` in a folder that all executors share.

    The state of a batch counts the distinct values of each bore and zone, which merges exactly, percentiles included. A
    batch is one part of the table, written under its id: written again, it replaces itself. :meth:`compact` merges all
    parts up to an id into one, and what comes again with such an id is ignored. Zones must not change; a sample that no
    zone holds and an undefined value do not count.
    """

    def __init__(self, spark: SparkSession, path: str, zones: DataFrame, value: str = "value", bore: str = "bore_id", md: str = "md"):
        self.spark, self.path, self.zones, self.value, self.bore, self.md = spark, path.rstrip("/"), zones, value, bore, md
        self.key = [bore, "zone"]

    def _parts(self) -> tuple[int, list[int]]:
        """The id up to which parts are merged (-1 if none is), and ids of further batches; complete parts only."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = {"upto": [-1], "batch": []}
        if fs.exists(at):
            for status in fs.listStatus(at):
                name = re.fullmatch(r"(upto|batch)-(\d+)", status.getPath().getName())
                if name and fs.exists(jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                    found[name[1]].append(int(name[2]))
        merged = max(found["upto"])
        return merged, sorted(b for b in found["batch"] if b > merged)

    def add(self, samples: DataFrame, batch_id: int) -> None:
        """Adds a batch; also what ``foreachBatch`` of a stream takes."""
        if batch_id <= self._parts()[0]:
            return
        inside = zoned.clip(samples, self.zones, self.bore, self.md).where(F.col(self.value).isNotNull())
        counts = inside.groupBy(*self.key, F.col(self.value).cast("double").alias("value")).agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{self.path}/batch-{batch_id}")

    def _counts(self) -> DataFrame | None:
        merged, batches = self._parts()
        paths = ([f"{self.path}/upto-{merged}"] if merged >= 0 else []) + [f"{self.path}/batch-{b}" for b in batches]
        if not paths:
            return None
        return self.spark.read.parquet(*paths).groupBy(*self.key, "value").agg(F.sum("n").alias("n"))

    def compact(self) -> None:
        """Merges all parts into one; the old ones stay until they are removed by hand, and are not read again."""
        merged, batches = self._parts()
        if batches:
            self._counts().write.mode("overwrite").parquet(f"{self.path}/upto-{batches[-1]}")

    def current(self) -> DataFrame:
        """What :func:`zones.zone_stats` gives of all samples so far."""
        every = self.zones.select(self.bore, F.col("name").alias("zone"), "zone_ord")
        counts = self._counts()
        if counts is None:
            return zoned.zone_stats(every.select(self.bore, F.lit(None).cast("double").alias(self.md), F.lit(None).cast("double").alias("value")).limit(0), self.zones, "value", self.bore)
        own = Window.partitionBy(*self.key)
        v, n = F.col("value"), F.col("n")
        total = F.sum(n).over(own)
        rows = counts.withColumn("_mean", F.sum(v * n).over(own) / total)
        at = lambda p: F.call_function("percentile", v, F.lit(p), n)
        got = rows.groupBy(*self.key).agg(
            F.sum(n).alias("count"), F.max("_mean").alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
            F.sqrt(F.sum(n * (v - F.col("_mean")) * (v - F.col("_mean"))) / F.sum(n)).alias("std"), F.sum(v * n).alias("sum"), at(0.1).alias("p10"), at(0.5).alias("p50"), at(0.9).alias("p90"),
        )
        out = every.join(got, self.key, "left")
        return out.withColumns({"count": F.coalesce("count", F.lit(0).cast("long")), "sum": F.coalesce("sum", F.lit(0.0))})
