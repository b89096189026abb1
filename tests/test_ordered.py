"""As-of and range joins against plain loops: nulls, ties, hot keys, empty sides, clashing names, and plans without products."""

import random
from collections import Counter

import pytest

from evalloom.operators import ordered

random.seed(6)


def plain_asof(left, right):
    out = Counter()
    for k, t, x in left:
        before = [(rt, tie, v) for rk, rt, tie, v in right if k is not None and t is not None and rk == k and rt is not None and rt <= t]
        best = max(before) if before else None
        out[(k, t, x, best and (best[0], best[2]))] += 1
    return out


@pytest.mark.parametrize("hot", [0, 3000])
def test_asof_is_the_last_at_or_before(spark, hot):
    left = [(random.choice([None, 1, 2, 3]), random.choice([None, *range(12)]), random.randrange(3)) for _ in range(200)] + [(2, i % 500, 0) for i in range(hot)] + [(9, 1, 1)]
    right = [(random.choice([None, 1, 2]), random.choice([None, *range(2, 12)]), i, f"v{i}") for i in range(60)] + [(2, 20 + i % 480, 1000 + i, f"h{i}") for i in range(hot // 3)] + [(7, 1, 1, "w")]
    a = spark.createDataFrame(left, "k int, t int, side int").repartition(5)
    b = spark.createDataFrame(right, "k int, rt int, tie int, v string").repartition(3)
    got = ordered.asof_join(a, b, "k", "t", "rt", ["v"], "tie")
    assert got.columns == ["k", "t", "side", "found"]
    assert Counter((r["k"], r["t"], r["side"], r["found"] and tuple(r["found"])) for r in got.collect()) == plain_asof(left, right)


def test_asof_without_rows(spark):
    a = spark.createDataFrame([(1, 5)], "k int, t int")
    b = spark.createDataFrame([(1, 3, 1)], "k int, rt int, v int")
    assert [tuple(r) for r in ordered.asof_join(a, b.where("false"), "k", "t", "rt", ["v"], "v").collect()] == [(1, 5, None)]
    assert ordered.asof_join(a.where("false"), b, "k", "t", "rt", ["v"], "v").count() == 0


def test_a_hot_key_goes_through_many_ranges(spark, monkeypatch):
    a = spark.range(40000).selectExpr("1 AS k", "id AS t")
    b = spark.range(0, 40000, 100).selectExpr("1 AS k", "id AS rt", "id AS v")
    seen, write = {}, ordered.written
    monkeypatch.setattr(ordered, "written", lambda df, name: seen.setdefault(name, write(df, name)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ordered.asof_join(a, b, "k", "t", "rt", ["v"], "v")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert out.where("found.v <> t - t % 100 OR found IS NULL").count() == 0 and out.count() == 40000
    sizes = [r["count"] for r in seen["asof-ranges"].groupBy("part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * 40400 / 4


def test_range_join_has_each_pair_once(spark):
    points = [(random.choice([None, 1, 2]), random.choice([None, *range(-50, 50)]), i) for i in range(150)] + [(1, 0, 1000)] * 3
    spans = []
    for i in range(80):
        low = random.randrange(-60, 60)
        spans.append((random.choice([None, 1, 2]), low, low + random.choice([-3, 0, 1, 2, 7, 40, 500, 100000]), i))
    spans += [(1, None, 3, 900), (2, 1, None, 901), (1, 0, 0, 902), (1, 0, 0, 902)]
    p = spark.createDataFrame(points, "k int, x int, i int").repartition(3)
    s = spark.createDataFrame(spans, "k int, low int, high int, j int").repartition(2)
    want = Counter((i, j) for k, x, i in points for sk, low, high, j in spans if k is not None and k == sk and None not in (x, low, high) and low <= x <= high)
    got = ordered.range_join(p, s, "x", "low", "high", ["k"])
    assert got.columns == ["k", "x", "i", "low", "high", "j"]
    assert Counter((r["i"], r["j"]) for r in got.collect()) == want
    loose = Counter((i, j) for _, x, i in points for _, low, high, j in spans if None not in (x, low, high) and low <= x <= high)
    for width in (None, 0.7, 1000.0):
        found = ordered.range_join(p.select("x", "i"), s.select("low", "high", "j"), "x", "low", "high", width=width)
        assert Counter((r["i"], r["j"]) for r in found.collect()) == loose
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
    assert ordered.range_join(p, s.where("false"), "x", "low", "high", ["k"]).count() == 0
    assert ordered.range_join(p.where("false"), s, "x", "low", "high", ["k"]).count() == 0


def test_a_long_interval_takes_two_bins(spark):
    s = spark.createDataFrame([(0.0, 1e9, 1), (0.1, 0.2, 2)], "low double, high double, j int")
    p = spark.createDataFrame([(0.15,), (5e8,), (1e9,), (1e9 + 1,)], "x double")
    out = ordered.range_join(p, s, "x", "low", "high", width=0.1)
    assert sorted((r["x"], r["j"]) for r in out.collect()) == [(0.15, 1), (0.15, 2), (5e8, 1), (1e9, 1)]
