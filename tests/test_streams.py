"""Streams: batches, restarts and repeated batches give what the whole table gives, and state stays bounded."""

import datetime as dt
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evalloom.streaming import attempts, windows

random.seed(4)
START = dt.datetime(2024, 3, 1)
SCHEMA = "n int, ts timestamp, arrival timestamp, kind string"
HOUR = dt.timedelta(hours=1)


def events(n=600):
    """A third of all rows are of one kind; one in ten is late by days, and times come in disorder within an hour."""
    out = []
    for i in range(n):
        ts = START + dt.timedelta(minutes=7 * i + random.randrange(30))
        lag = dt.timedelta(days=3) if i % 10 == 9 else dt.timedelta(minutes=random.randrange(60))
        out.append((i, ts, ts + lag, "hot" if i % 3 == 0 else f"k{i % 7}"))
    return out


def hours(rows):
    mark = max(ts for _, ts, _, _ in rows) - dt.timedelta(minutes=120)
    found = Counter((ts.replace(minute=0, second=0), k) for _, ts, _, k in rows)
    return {w: n for w, n in found.items() if w[0] + HOUR <= mark}


@pytest.mark.parametrize("slices", [1, 6])
def test_windows_dont_hang_on_batches(spark, slices):
    rows = events()
    df = spark.createDataFrame(random.sample(rows, len(rows)), SCHEMA).repartition(3)
    path, files = windows.land(df, "arrival", slices)
    stream = windows.landed_stream(spark, path, files, df.schema)
    timely = windows.on_time(stream, "ts", "arrival", 120)
    found, query = windows.to_table(windows.tumbling(timely, "ts", "1 hour", ["kind"], F.count("*").alias("n")), "tumbling")
    want = hours([r for r in rows if r[2] - r[1] <= dt.timedelta(minutes=120)])
    assert {(r["window"]["start"], r["kind"]): r["n"] for r in found.collect()} == want
    # the watermark has let go of all but the last windows
    states = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert states[-1]["numRowsTotal"] <= 3 * 7 + 7 and sum(s["numRowsDroppedByWatermark"] for s in states) == 0
    batches = len([p for p in query.recentProgress if p["numInputRows"]])
    assert batches == slices
    apart, _ = windows.to_table(stream.where(windows.late("ts", "arrival", 120)), "late")
    assert sorted(r["n"] for r in apart.collect()) == list(range(9, 600, 10))


def test_rows_without_a_time_are_late(spark):
    df = spark.createDataFrame([(1, None, START, "a"), (2, START, None, "a"), (3, START, START, "a")], SCHEMA)
    assert [r["n"] for r in df.where(windows.late("ts", "arrival", 5)).orderBy("n").collect()] == [1, 2]


def test_sessions_and_sliding_windows(spark):
    rows = [(i, START + dt.timedelta(minutes=m), START + dt.timedelta(minutes=m), k) for i, (m, k) in enumerate([(0, "a"), (20, "a"), (49, "a"), (120, "a"), (5, "b"), (600, "z")])]
    df = spark.createDataFrame(rows, SCHEMA)
    path, files = windows.land(df, "arrival", 3)
    stream = windows.on_time(windows.landed_stream(spark, path, files, df.schema), "ts", "arrival", 60)
    found, _ = windows.to_table(windows.sessions(stream, "ts", "30 minutes", ["kind"], F.count("*").alias("n")), "sessions")
    at = lambda m: START + dt.timedelta(minutes=m)
    assert sorted((r["kind"], r["window"]["start"], r["window"]["end"], r["n"]) for r in found.collect()) == [("a", at(0), at(79), 3), ("a", at(120), at(150), 1), ("b", at(5), at(35), 1)]
    found, _ = windows.to_table(windows.sliding(stream, "ts", "60 minutes", "30 minutes", ["kind"], F.count("*").alias("n")), "sliding")
    assert {(r["kind"], r["window"]["start"]): r["n"] for r in found.collect() if r["kind"] == "b"} == {("b", at(-30)): 1, ("b", at(0)): 1}


def plain_outcomes(rows, tries, patience, last_of_all):
    """(outcome, attempts, answer) by id, from all attempts in order."""
    out = {}
    for key in {r[0] for r in rows if r[0] is not None}:
        n, last, done = 0, None, None
        for _, at, seq, ok, answer in sorted({r for r in rows if r[0] == key}, key=lambda r: (r[1], r[2])):
            if done:
                break
            if last is not None and at > last + patience:
                done = ("given up", n, None)
                break
            n, last = n + 1, at
            done = ("answered", n, answer) if ok else ("failed", n, None) if n == tries else None
        if not done and last + patience <= last_of_all:
            done = ("given up", n, None)
        if done:
            out[key] = done
    return out


ATTEMPTS = "id string, at timestamp, seq bigint, ok boolean, answer string"


@pytest.fixture(scope="module")
def calls():
    rows = []
    for i in range(40):
        day = random.randrange(20)
        for s in range(random.randrange(1, 6)):
            day += random.choice([0, 1, 3, 30])
            rows.append((f"q{i}", START + dt.timedelta(days=day), s, random.random() < 0.25, f"a{s}"))
    rows.sort(key=lambda r: r[1])
    return rows


def run(stream, table, checkpoint):
    found, query = attempts.with_rocks(windows.to_table)(attempts.outcomes(stream, 3, 10), "outcomes", checkpoint, table)
    return [(r["id"], (r["outcome"], r["attempts"], r["answer"])) for r in found.collect()], query


def test_attempts_survive_restarts_and_repeated_batches(spark, calls, tmp_path):
    """Three starts on one checkpoint, each finding more files and some of the old rows again; then the last batch's commit is
    taken away, as if it had been lost on the way, and the batch is done again: each id is there once."""
    folder, table, checkpoint = f"{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/ck"
    os.mkdir(folder)
    stream = lambda: spark.readStream.schema(ATTEMPTS).parquet(f"file://{folder}/*")
    cuts = [0, len(calls) // 3, 2 * len(calls) // 3, len(calls)]
    for k in range(3):
        part = calls[cuts[k] : cuts[k + 1]] + (calls[: cuts[k] : 3] if k else [(None, START, 1, True, "x"), ("n", None, 1, True, "x")])
        spark.createDataFrame(part, ATTEMPTS).coalesce(2).write.parquet(f"file://{folder}/{k}")
        found, query = run(stream(), table, checkpoint)
    want = plain_outcomes(calls, 3, dt.timedelta(days=10), max(r[1] for r in calls))
    assert len(found) == len(dict(found)) and dict(found) == want
    commits = sorted((f for f in os.listdir(f"{tmp_path}/ck/commits") if f.isdigit()), key=int)
    os.remove(f"{tmp_path}/ck/commits/{commits[-1]}")
    crc = f"{tmp_path}/ck/commits/.{commits[-1]}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    again, _ = run(stream(), table, checkpoint)
    assert sorted(again, key=str) == sorted(found, key=str)
    assert {k: v for k, v in [*want.items()]} == dict(again)


def test_ids_are_forgotten_after_their_time(spark, tmp_path):
    rows = [("a", START, 1, True, "x"), ("b", START + dt.timedelta(days=50), 1, True, "y"), ("a", START + dt.timedelta(days=60), 2, True, "z")]
    os.mkdir(f"{tmp_path}/in")
    for k, r in enumerate(rows):
        spark.createDataFrame([r], ATTEMPTS).write.parquet(f"file://{tmp_path}/in/{k}")
        stream = spark.readStream.schema(ATTEMPTS).parquet(f"file://{tmp_path}/in/*")
        found, query = attempts.with_rocks(windows.to_table)(attempts.outcomes(stream, 3, 10, keep_days=20), "outcomes", f"file://{tmp_path}/ck", f"file://{tmp_path}/out")
    assert sorted((r["id"], r["answer"]) for r in found.collect()) == [("a", "x"), ("a", "z"), ("b", "y")]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != attempts.ROCKS


def test_batches_may_part_attempts_of_one_instant(spark, tmp_path):
    """Both batches hold attempts of the latest instant; what was last tried exactly the patience before it is given up."""
    late = START + dt.timedelta(days=10)
    rows = [("a", late, 1, False, "x"), ("b", START, 1, False, "x"), ("c", late, 1, True, "y")], [("a", late, 2, True, "z"), ("d", late, 1, True, "w"), ("c", late, 1, True, "y")]
    os.mkdir(f"{tmp_path}/in")
    for k, part in enumerate(rows):
        spark.createDataFrame(part, ATTEMPTS).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
        found, _ = run(spark.readStream.schema(ATTEMPTS).parquet(f"file://{tmp_path}/in/*"), f"file://{tmp_path}/out", f"file://{tmp_path}/ck")
    want = plain_outcomes(rows[0] + rows[1], 3, dt.timedelta(days=10), late)
    assert len(found) == 4 and dict(found) == want == {"a": ("answered", 2, "z"), "b": ("given up", 1, None), "c": ("answered", 1, "y"), "d": ("answered", 1, "w")}


def test_an_id_that_may_still_be_tried_has_no_record(spark):
    """Two failures and the stream ends within the patience: no one has given up yet, a further attempt would count."""
    rows = [("a", START, 1, False, "x"), ("a", START + dt.timedelta(days=3), 2, False, "x"), ("b", START + dt.timedelta(days=5), 1, True, "y")]
    df = spark.createDataFrame(rows, ATTEMPTS).withColumn("arrival", F.col("at"))
    stream = windows.landed_stream(spark, *windows.land(df, "arrival", 2), df.schema).drop("arrival")
    found, _ = attempts.with_rocks(windows.to_table)(attempts.outcomes(stream, 3, 10), "outcomes")
    assert [tuple(r) for r in found.collect()] == [("b", "answered", 1, "y")]


def test_ids_of_a_bucket_share_a_state_and_a_timer(spark):
    """Three hundred ids in four buckets over three batches, some with many attempts and repeated deliveries in one: the state has a
    row a bucket, not a row an id, and each id ends by its own time."""
    rows = []
    for i in range(300):
        at = START + dt.timedelta(days=random.randrange(40))
        for s in range(random.choice([1, 1, 2, 3, 12])):
            rows.append((f"q{i}", at, s, random.random() < 0.2, f"a{s}"))
            at += dt.timedelta(hours=random.choice([0, 1, 30, 300]))
    rows.append(("open", max(r[1] for r in rows), 1, False, "x"))
    df = spark.createDataFrame(rows + rows[::5], ATTEMPTS).withColumn("arrival", F.col("at")).repartition(3)
    stream = windows.landed_stream(spark, *windows.land(df, "arrival", 3), df.schema).drop("arrival")
    found, query = attempts.with_rocks(windows.to_table)(attempts.outcomes(stream, 3, 10, keep_days=10**5, buckets=4), "outcomes")
    got = [(r["id"], (r["outcome"], r["attempts"], r["answer"])) for r in found.collect()]
    want = plain_outcomes(rows, 3, dt.timedelta(days=10), max(r[1] for r in rows))
    assert len(got) == len(want) and dict(got) == want and len({o for o, _, _ in want.values()}) == 3 and "open" not in want
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(states) > 3 and max(states) == 4


def test_a_batch_parts_no_slice_of_few_rows(spark):
    """Slices of twenty attempts under 24 partitions, so fewer rows than a batch takes files, and an id's attempts an hour apart:
    each slice is a batch, and no attempt comes before an earlier one of its id."""
    rows = [(f"q{i}", START + dt.timedelta(days=5 * (i // 5), hours=s), s, s == i % 5, f"a{s}") for i in range(20) for s in range(4)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        df = spark.createDataFrame(rows, ATTEMPTS).withColumn("arrival", F.col("at")).repartition(3)
        stream = windows.landed_stream(spark, *windows.land(df, "arrival", 4), df.schema).drop("arrival")
        found, query = attempts.with_rocks(windows.to_table)(attempts.outcomes(stream, 3, 10), "outcomes")
        got = {r["id"]: (r["outcome"], r["attempts"], r["answer"]) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == plain_outcomes(rows, 3, dt.timedelta(days=10), max(r[1] for r in rows))
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 4
