"""Statistics by ranges give what the aggregates and windows give."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lithoframe.functions import stats


def same(got, want):
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a, b = ({repr(r["g"]): [r[c] for c in cols] for r in df.collect()} for df in (got, want))
    assert a.keys() == b.keys() and a
    for g, row in b.items():
        assert all(x == y or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a[g], row, strict=True)), g


@pytest.fixture(scope="module")
def samples(spark):
    rnd = random.Random(11)
    rows = [(rnd.choice(["a", "b", None]), 7.0 if rnd.random() < 0.4 else rnd.gauss(0, 50), rnd.choice([0.5, 1.0, 3.0, 0.0])) for _ in range(3000)]
    rows += [("one", 5.0, 2.0), ("none", None, 1.0), ("light", 5.0, 0.0), ("two", 1.0, 1.0), ("two", 2.0, 1.0)]
    return spark.createDataFrame(rows, "g string, v double, w double")


@pytest.mark.parametrize(("parts", "most"), [(2, 5), (64, 5), (8, 300), (64, 1_000_000)])
def test_spread(spark, samples, parts, most):
    same(stats.spread(samples, ["g"], "v", parts=parts, most=most), samples.groupBy("g").agg(*stats.bundle(F.col("v"))))
    also = (F.count("*").alias("rows"),)
    same(stats.spread(samples, ["g"], "v", "w", also, parts, most), stats.weighted(samples, ["g"], "v", "w", also))


@pytest.mark.parametrize("most", [5, 1_000_000])
def test_percentiles(spark, samples, most):
    wanted = {"low": 0.0, "third": 1 / 3, "late": 0.975, "top": 1.0}
    got = stats.percentiles(samples, ["g"], "v", wanted, most=most)
    same(got, samples.where("v IS NOT NULL").groupBy("g").agg(*(F.percentile("v", p).alias(n) for n, p in wanted.items())))
    got = {r["g"]: r["p50"] for r in stats.percentiles(samples, ["g"], "v", {"p50": 0.5}, "w", most=most).collect()}
    assert got == {r["g"]: r["p50"] for r in stats.weighted(samples, ["g"], "v", "w").collect()}
    with pytest.raises(ValueError):
        stats.percentiles(samples, ["g"], "v", {"x": 1.5})
    assert stats.percentiles(samples.limit(0), ["g"], "v", wanted, most=most).count() == 0


def test_spread_without_groups(spark, samples):
    got, want = stats.spread(samples, [], "v", most=10).head(), samples.agg(*stats.bundle(F.col("v"))).head()
    assert [got[n] for n in stats.NAMES] == pytest.approx([want[n] for n in stats.NAMES])
    assert stats.spread(samples.limit(0), ["g"], "v").count() == 0


def test_spread_beyond_the_bound(spark, samples, monkeypatch):
    monkeypatch.setattr(stats, "BROADCAST_GROUPS", 1)
    same(stats.spread(samples, ["g"], "v", "w", most=10), stats.weighted(samples, ["g"], "v", "w"))
