"""Percentiles by histograms and by ranges against sorting."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.operators import selection

RNG = random.Random(31)
QS = [0.0, 0.1, 0.5, 0.77, 1.0]
SHAPES = {
    "normal": lambda: RNG.gauss(-20, 9),
    "ties": lambda: float(RNG.choice([-1, 0, 0, 0, 2])),
    "wide": lambda: RNG.choice([-1, 1]) * 10.0 ** RNG.uniform(-300, 300),
    "close": lambda: 1000 + RNG.random() * 1e-9,
    "one": lambda: 3.25,
    "tiny": lambda: RNG.choice([5e-324, -5e-324, 0.0, -0.0, 1e-310]),
}


def table(spark, n):
    rows = [(name, k, f()) for name, f in SHAPES.items() for k in range(n)]
    rows += [("single", 0, 7.0), ("none", 0, None), ("nan", 0, float("nan")), (None, 1, 1.0), (None, 2, 3.0), ("pair", 1, -1.0), ("pair", 1, None), ("pair", 1, 5.0)]
    return rows, spark.createDataFrame(rows, "g string, k int, x double")


@pytest.mark.parametrize("n, bins, few", [(500, 1024, 4096), (700, 4, 3), (300, 2, 1)])
def test_percentiles(spark, monkeypatch, n, bins, few):
    monkeypatch.setattr(selection, "BINS", bins)
    monkeypatch.setattr(selection, "FEW", few)
    rows, df = table(spark, n)
    groups = {}
    for g, _, x in rows:
        if x is not None and x == x:
            groups.setdefault(g, []).append(x)
    got = {(r.g, r.q): r.x for r in selection.percentiles(df, ["g"], "x", QS).collect()}
    assert set(got) == {(g, q) for g in groups for q in QS}
    for (g, q), x in got.items():
        v = sorted(groups[g])
        at = q * (len(v) - 1)
        lo, share = int(at), at - int(at)
        want = v[lo] if share == 0 else v[lo] * (1 - share) + v[lo + 1] * share
        assert x == want


def test_median_and_mad(spark):
    rows, df = table(spark, 301)
    got = {(r.g, r.k): (r.median, r.mad) for r in selection.median_and_mad(df.withColumn("k", F.col("k") % 2), ["g", "k"], "x").collect()}
    groups = {}
    for g, k, x in rows:
        if x is not None and x == x and g is not None:
            groups.setdefault((g, k % 2), []).append(x)
    for key, v in groups.items():
        m = statistics.median(v)
        assert got[key] == (pytest.approx(m, rel=1e-15), pytest.approx(statistics.median([abs(x - m) for x in v]), rel=1e-15))


def weighted(pairs, q):
    pairs = sorted(pairs)
    total, before, points = sum(w for _, w in pairs), 0.0, []
    for v, w in pairs:
        points.append((before + w / 2, v))
        before += w
    t = q * total
    if t <= points[0][0]:
        return points[0][1]
    for (p, v), (p2, v2) in zip(points, points[1:], strict=False):
        if p <= t < p2:
            return v + (v2 - v) * (t - p) / (p2 - p)
    return points[-1][1]


@pytest.mark.parametrize("range_rows", [3, 50, 500_000])
def test_weighted_percentiles(spark, range_rows):
    rows = [(g, RNG.choice([RNG.gauss(0, 1), 0.5]), RNG.choice([1.0, 0.25, 3.0])) for g, n in (("a", 300), ("b", 1), ("c", 2), ("d", 40), (None, 5)) for _ in range(n)]
    odd = [("a", None, 1.0), ("a", 1.0, None), ("a", float("nan"), 1.0), ("a", float("inf"), 2.0), ("a", 9.0, 0.0), ("a", 9.0, -1.0), ("e", 1.0, 0.0)]
    df = spark.createDataFrame(rows + odd, "g string, v double, w double")
    got = {(r.g, r.q): r.x for r in selection.weighted_percentiles(df, ["g"], "v", "w", QS, range_rows).collect()}
    groups = {g: [(v, w) for h, v, w in rows if h == g] for g in {r[0] for r in rows}}
    assert set(got) == {(g, q) for g in groups for q in QS}
    for (g, q), x in got.items():
        assert x == pytest.approx(weighted(groups[g], q), abs=1e-9)


def test_large_group_is_many_tasks(spark):
    """No window of the plan sees more than a range, and the result is numpy's."""
    df = spark.range(200_000).select(F.lit("g").alias("g"), F.rand(3).alias("x"))
    x = np.array([r.x for r in df.select("x").collect()])
    got = {r.q: r.x for r in selection.percentiles(df, ["g"], "x", [0.25, 0.5]).collect()}
    assert got == {q: pytest.approx(np.quantile(x, q), abs=1e-12) for q in (0.25, 0.5)}
    assert selection.percentiles(df.where("x > 2"), ["g"], "x", [0.5]).count() == 0
    assert selection.weighted_percentiles(df.where("x > 2"), ["g"], "x", "x").count() == 0
