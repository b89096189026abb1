"""Sketches against exact figures, days across changes of the clock, moving sums against brute force, exact money."""

import datetime as dt
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from evalloom.functions import money
from evalloom.operators import local_time, sketches

KIND = "g string, d int, u bigint, v double"


@pytest.fixture(scope="module")
def drawn(spark):
    """A third of the rows in one group, skewed users and values, a group without values, nulls in every column."""
    r = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"g{i % 4}", i % 10, int(r.paretovariate(0.6)) % 20_000, r.gauss(0, 5) if i % 9 else None) for i in range(60_000)]
    rows += [("bare", 1, None, None), ("bare", 2, 7, None), (None, None, 8, 1.0), (None, 1, None, 2.0)]
    return spark.createDataFrame(rows, KIND).repartition(6), rows


def test_sketches_rolled_up_are_within_their_errors(drawn):
    df, rows = drawn
    stored = sketches.summarised(df, ["g", "d"], "u", "v")
    direct = sketches.summarised(df, ["g"], "u", "v")
    read = lambda s: {r["g"]: r for r in s.select("g", "n", sketches.distinct_estimate().alias("u"), *[sketches.quantile_estimate(q).alias(f"q{i}") for i, q in enumerate((0.1, 0.5, 0.99))]).collect()}
    for found in (read(sketches.rolled_up(stored, ["g"])), read(direct)):
        assert set(found) == {"hot", "g0", "g1", "g2", "g3", "bare", None}
        for g, row in found.items():
            mine = [x for x in rows if x[0] == g]
            users, values = {x[2] for x in mine} - {None}, sorted(x[3] for x in mine if x[3] is not None)
            assert row["n"] == len(mine)
            assert abs(row["u"] - len(users)) <= sketches.DISTINCT_ERROR * len(users) + 0.5
            for i, q in enumerate((0.1, 0.5, 0.99)):
                if not values:
                    assert row[f"q{i}"] is None
                    continue
                low, up = sum(v < row[f"q{i}"] for v in values), sum(v <= row[f"q{i}"] for v in values)
                assert low <= (q + sketches.RANK_ERROR) * len(values) + 1 and up >= (q - sketches.RANK_ERROR) * len(values) - 1


def test_counts_by_count_min_merge_and_are_never_below(drawn):
    df, rows = drawn
    keyed = df.where("g IS NOT NULL")
    stored = sketches.count_min(keyed, ["g", "d"], "u")
    merged, direct = sketches.merged_counts(stored, ["g"]), sketches.count_min(keyed, ["g"], "u")
    assert merged.exceptAll(direct).count() == 0 and direct.exceptAll(merged).count() == 0
    assert merged.groupBy("g").count().agg(F.max("count")).first()[0] <= sketches.DEPTH * sketches.WIDTH
    exact = keyed.where("u IS NOT NULL").groupBy("g", "u").agg(F.count("*").alias("n"))
    found = sketches.estimated_counts(merged, exact.select("g", "u"), ["g"], "u").join(exact, ["g", "u"]).collect()
    assert all(r["estimate"] >= r["n"] for r in found)
    size = {g: sum(x[0] == g and x[2] is not None for x in rows) for g in {x[0] for x in rows}}
    beyond = sum(r["estimate"] - r["n"] > 2 * size[r["g"]] / sketches.WIDTH for r in found)
    assert beyond <= len(found) / 2**sketches.DEPTH
    unseen = df.sparkSession.createDataFrame([("bare", 99)], "g string, u bigint")
    assert sketches.estimated_counts(merged, unseen, ["g"], "u").first()["estimate"] == 0


def test_sketches_of_nothing(drawn):
    none = drawn[0].where("false")
    assert sketches.rolled_up(sketches.summarised(none, ["g", "d"], "u", "v"), ["g"]).count() == 0
    assert sketches.count_min(none, ["g"], "u").count() == 0


@pytest.mark.parametrize("session_zone", ["UTC", "America/Los_Angeles", "Pacific/Apia"])
def test_local_days_at_both_changes_of_the_clock(spark, session_zone):
    rows = [
        ("2024-03-30 22:59:59", "Europe/Berlin", "2024-03-30", 24.0), ("2024-03-30 23:00:00", "Europe/Berlin", "2024-03-31", 23.0),
        ("2024-03-31 21:59:59", "Europe/Berlin", "2024-03-31", 23.0), ("2024-03-31 22:00:00", "Europe/Berlin", "2024-04-01", 24.0),
        ("2024-10-26 22:00:00", "Europe/Berlin", "2024-10-27", 25.0), ("2024-10-27 22:59:59", "Europe/Berlin", "2024-10-27", 25.0),
        ("2024-11-03 06:30:00", "America/New_York", "2024-11-03", 25.0), ("2024-03-10 05:00:00", "America/New_York", "2024-03-10", 23.0),
        ("2024-02-28 15:00:00", "Asia/Tokyo", "2024-02-29", 24.0), (None, "Asia/Tokyo", None, None), ("2024-01-01 00:00:00", None, None, None),
    ]
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, z string, d string, h double")
        got = local_time.local_days(df.withColumn("at", F.col("t").cast("timestamp_ntz")), "at", "z").orderBy("i").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert [(r["local_day"] and str(r["local_day"]), r["day_hours"]) for r in got] == [(r[2], r[3]) for r in rows]


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_moving_sums_are_those_of_brute_force(spark, kind):
    r = random.Random(8)
    start = dt.datetime(1969, 12, 31, 23, 50)  # pieces on both sides of 1970
    rows = [(i, "hot" if i % 3 else f"k{i % 4}", start + dt.timedelta(microseconds=r.choice([1, 500_000, 1_000_000]) * r.randrange(0, 2400)), r.randrange(-5, 9) if i % 7 else None) for i in range(700)]
    rows += [(1000, "hot", start, 1), (1001, "hot", start, 1), (1002, "hot", start + dt.timedelta(seconds=60), 1), (1003, None, start, 4), (1004, None, start, 5), (1005, "hot", None, 6)]
    df = spark.createDataFrame(rows, "i int, k string, t timestamp_ntz, v bigint").withColumn("t", F.col("t").cast(kind)).withColumn("piece", F.lit(1)).repartition(3)
    found = local_time.moving_sum(df, "k", "t", "v", 60)
    assert found.columns == ["i", "k", "t", "v", "piece", "moving"]
    got = {x["i"]: x["moving"] for x in found.collect()}
    assert len(got) == len(rows)
    for i, k, t, _ in rows:
        inside = [v for _, k2, t2, v in rows if t and t2 and k2 == k and t - dt.timedelta(seconds=60) <= t2 <= t and v is not None]
        assert got[i] == (sum(inside) if inside else None)


def test_moving_sums_split_a_hot_key(spark):
    df = spark.range(10).selectExpr("id", "'hot' AS k", "timestamp_ntz'2024-01-01 00:00:00' AS t", "1L AS v")
    plan = local_time.moving_sum(df, "k", "t", "v", 60)._jdf.queryExecution().optimizedPlan().toString()
    assert "_piece" in plan.split("windowspecdefinition(")[1].split("ASC")[0]
    assert local_time.moving_sum(df.where("false"), "k", "t", "v", 60).count() == 0


def test_amounts_are_rounded_as_printed(spark):
    values = [0.145, 2.675, -2.675, 1.005, 0.0, None, 1e10, 123456789.125]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(money.amount("v")).collect()]
    assert got == [None if v is None else Decimal(repr(v)).quantize(Decimal("0.01"), ROUND_HALF_UP) for v in values]


def test_sums_and_shares_are_exact_whatever_the_partitions(spark):
    r = random.Random(5)
    cents = [r.randrange(-(10**9), 10**12) for _ in range(3000)] + [1, -1, 5]
    df = spark.createDataFrame([(Decimal(c) / 100,) for c in cents], "v decimal(18,2)")
    want = sum(cents)
    for parts in (1, 7):
        total, mean = df.repartition(parts).agg(money.exact_sum(F.col("v")), money.exact_ratio(F.sum("v"), F.count("v"), 4)).first()
        assert total == Decimal(want) / 100
        assert mean == (Decimal(want) / 100 / len(cents)).quantize(Decimal("0.0001"), ROUND_HALF_UP)
    pairs = [("1.00", "3.00"), ("2.00", "3.00"), ("-1.00", "8.00"), ("1.00", "-16.00"), ("0.01", "0.02"), ("1.00", "0.00"), (None, "1.00"), ("0.00", "5.00"), ("-0.05", "-100.00")]
    df = spark.createDataFrame([(i, a and Decimal(a), b and Decimal(b)) for i, (a, b) in enumerate(pairs)], "i int, a decimal(18,2), b decimal(18,2)")
    got = [x[0] for x in df.orderBy("i").select(money.exact_ratio(F.col("a"), F.col("b"), 3)).collect()]
    assert got == [None if a is None or not Decimal(b) else (Decimal(a) / Decimal(b)).quantize(Decimal("0.001"), ROUND_HALF_UP) for a, b in pairs]


def test_what_does_not_fit_is_an_error(spark):
    big = Decimal("9" * 26 + ".99")
    df = spark.createDataFrame([(big,), (big,)], "v decimal(28,2)")
    with pytest.raises(Exception, match="more digits"):
        df.agg(money.exact_sum(F.col("v"))).collect()
    assert df.where("false").agg(money.exact_sum(F.col("v"))).first()[0] is None
