"""Streams with state: last values with late and expired keys, zone statistics that merge by batch."""

import random

import pytest
from pyspark.sql import functions as F

from lithoframe.operators import zones
from lithoframe.streaming import events, state

SCHEMA = "user_id long, event_type string, ts timestamp, value double"


def test_newest_values(spark, tmp_path):
    folder = str(tmp_path / "in")

    def put(*rows):
        made = spark.createDataFrame([(u, "a", f"2024-01-{ts}", v) for u, ts, v in rows], "user_id long, event_type string, ts string, value double")
        made.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.PROVIDER)
    try:
        put((1, "01 10:00:00", 1.0), (2, "01 10:00:00", 5.0), (1, "01 09:00:00", 9.0))
        out = state.newest_values(events.read(spark, folder, SCHEMA), "1 hour", 24 * 3600 * 1000)
        q = out.writeStream.outputMode("update").format("memory").queryName("newest").option("checkpointLocation", str(tmp_path / "at")).start()
        try:
            q.processAllAvailable()
            # in time but older than what is known; newer; then another key, so far on that what is late is left out
            for rows in ([(1, "01 09:30:00", 7.0)], [(1, "01 11:00:00", 2.0), (1, "01 11:00:00", None)], [(3, "04 00:00:00", 3.0)], [(2, "01 12:00:00", 8.0)], [(3, "04 01:00:00", 4.0)]):
                put(*rows)
                q.processAllAvailable()
        finally:
            q.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = [(r["user_id"], r["ts"].day, r["ts"].hour, r["value"], r["expired"]) for r in spark.table("newest").collect()]
    assert sorted(got) == sorted([(1, 1, 10, 1.0, False), (2, 1, 10, 5.0, False), (1, 1, 11, 2.0, False), (3, 4, 0, 3.0, False), (1, 1, 11, 2.0, True), (2, 1, 10, 5.0, True), (3, 4, 1, 4.0, False)])


@pytest.fixture(scope="module")
def curve(spark):
    rng = random.Random(8)
    rows = [(b, round(rng.uniform(-20, 320), 1), None if rng.random() < 0.1 else float(rng.randrange(40))) for b in range(4) for _ in range(150)]
    return spark.createDataFrame(rows, "bore_id long, md double, value double").cache()


@pytest.fixture(scope="module")
def tops(spark):
    rows = [(b, n, k, 100.0 * k, 100.0 * (k + 1)) for b in range(5) for k, n in enumerate("ABC")]
    return spark.createDataFrame(rows, "bore_id long, name string, zone_ord int, top_md double, base_md double").cache()


def rows(df):
    names = ("bore_id", "zone", "zone_ord", "count", "mean", "min", "max", "std", "sum", "p10", "p50", "p90")
    return {(r["bore_id"], r["zone"]): [round(r[n], 6) if r[n] is not None else None for n in names[2:]] for r in df.collect()}


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_zone_states(spark, curve, tops, tmp_path, parts):
    want = rows(zones.zone_stats(curve, tops))
    kept = state.ZoneStates(spark, str(tmp_path / "zones"), tops)
    assert {k[0]: 0 for k in rows(kept.current())} == {b: 0 for b in range(5)}
    batches = [curve.where(F.pmod(F.hash("md", "value"), F.lit(parts)) == k) for k in range(parts)]
    for k, batch in enumerate(batches):
        kept.add(batch, k)
        if k == 1:
            kept.compact()
    assert rows(kept.current()) == want
    for k, batch in enumerate(batches):  # again, merged or not: nothing changes
        kept.add(batch, k)
    assert rows(kept.current()) == want
    kept.compact()
    kept.add(batches[0], 0)
    assert rows(kept.current()) == want


def test_zone_states_of_a_stream(spark, curve, tops, tmp_path):
    for k in range(3):
        curve.where(F.pmod(F.hash("md"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    kept = state.ZoneStates(spark, str(tmp_path / "zones"), tops)
    q = events.read(spark, str(tmp_path / "in"), curve.schema).writeStream.foreachBatch(kept.add).option("checkpointLocation", str(tmp_path / "at")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert rows(kept.current()) == rows(zones.zone_stats(curve, tops))
