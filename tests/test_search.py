"""Searches against brute force: texts exactly, vectors by recall; copies, nulls, hot terms and small tables."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from evalloom.operators import search, vectors

random.seed(12)
VOCABULARY = [f"w{i}" for i in range(60)]


def plain_best(docs, questions, k):
    split = lambda t: [w for w in (t or "").lower().replace("\n", " ").split(" ") if w]
    held = {}
    for d, t in docs:
        if d is not None:
            held[d] = held.get(d, []) + split(t)
    n, mean = len(held), sum(map(len, held.values())) / len(held)
    df = Counter(w for ws in held.values() for w in set(ws))
    asked = {}
    for q, t in questions:
        if q is not None:
            asked[q] = asked.get(q, set()) | set(split(t))
    out = {}
    for q, terms in asked.items():
        scores = {}
        for d, ws in held.items():
            tf = Counter(ws)
            parts = [math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in terms if tf[w]]
            if parts:
                scores[d] = sum(round(p * 1e6) for p in parts)
        out[q] = sorted(((-s, d) for d, s in scores.items()))[:k]
    return {(q, d): (-s, i + 1) for q, found in out.items() for i, (s, d) in enumerate(found)}


@pytest.mark.parametrize("block", [7, 20_000])
@pytest.mark.parametrize("k", [1, 3])
def test_the_best_documents_are_those_of_brute_force(spark, monkeypatch, block, k):
    """Words of all frequencies: one is in every document, and a third of the documents are copies, so there are ties."""
    monkeypatch.setattr(search, "BLOCK", block)
    say = lambda n: " ".join(["the", *(VOCABULARY[int(59 * random.random() ** 3)] for _ in range(n))])
    copy = say(9)
    docs = [(i, copy if i % 3 == 0 else say(random.randrange(0, 30))) for i in range(200)] + [(900, None), (901, ""), (902, "the " * 500), (None, say(5)), (5, "w3 W3\nw58"), (903, "rare THE")]
    questions = [(i, say(random.randrange(1, 8))) for i in range(12)] + [(50, "the"), (51, "rare the w0"), (52, "unknown"), (53, None), (54, copy), (None, "the"), (50, "w1")]
    d = spark.createDataFrame([(a, b, 1) for a, b in docs], "id bigint, t string, tf int").repartition(3)
    q = spark.createDataFrame([(a, b, 2) for a, b in questions], "q bigint, t string, df int").repartition(2)
    want = plain_best(docs, questions, k)
    for asked in (None, q.select("t")):
        found = search.best(search.build_index(d, "id", "t", asked), q.withColumnRenamed("q", "ask"), "ask", "t", k)
        assert found.columns == ["ask", "doc", "score", "place"]
        assert {(r["ask"], r["doc"]): (r["score"], r["place"]) for r in found.collect()} == want


def test_an_index_of_nothing(spark):
    d = spark.createDataFrame([(1, "a b")], "id bigint, t string")
    assert search.best(search.build_index(d.where("false"), "id", "t"), d, "id", "t").count() == 0
    assert search.best(search.build_index(d, "id", "t"), d.where("false"), "id", "t").count() == 0


def test_a_hot_term_is_cut_into_blocks_and_nothing_is_crossed(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 100)
    d = spark.range(1000).selectExpr("id", "concat('the w', id % 50) AS t")
    index = search.build_index(d, "id", "t")
    sizes = [r["n"] for r in index.blocks.where("term = 'the'").collect()]
    assert len(sizes) == 11 and sum(sizes) == 1000 and max(sizes) < 200
    found = search.best(index, spark.createDataFrame([(1, "the w7")], "q bigint, t string"), "q", "t", 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan
    assert [r["doc"] for r in found.orderBy("place").collect()] == [7, 57, 107, 157, 207]


def recall(rows, found, asked, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    hits = total = 0
    for q in asked:
        s = np.round(x @ x[np.flatnonzero(ids == q)[0]], 9)
        s[ids == q] = -9
        best = set(ids[np.lexsort((ids, -s))[: min(k, len(ids) - 1)]].tolist())
        hits += len(best & {r["id"] for r in found if r["query"] == q})
        total += len(best)
    return hits / total


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(z) for z in v]) for i, v in rows], "id bigint, v array<double>").repartition(3)


@pytest.mark.parametrize("kind", ["random", "clusters", "copies"])
def test_recall_of_near_vectors(spark, monkeypatch, kind):
    monkeypatch.setattr(vectors, "BLOCK", 128)
    monkeypatch.setattr(vectors, "QUERIES", 8)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24))
    if kind == "clusters":
        x = rng.normal(size=(30, 24))[rng.integers(0, 30, 1500)] * 3 + x
    if kind == "copies":  # a third of all rows are one vector
        x[rng.random(1500) < 0.34] = x[0]
    rows = [(int(i), x[i]) for i in range(1500)]
    df = table(spark, rows)
    found = vectors.nearest(df, df.where("id % 50 = 0"), "id", "v").collect()
    assert recall(rows, found, range(0, 1500, 50), 10) >= 0.9
    assert sorted(r["place"] for r in found if r["query"] == 0) == list(range(1, 11)) and all(r["query"] != r["id"] for r in found)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert all(abs(r["similarity"] - unit[r["query"]] @ unit[r["id"]]) < 1e-6 for r in found)


def sent_to_driver(spark, run):
    """Bytes of results that tasks send to the driver while this runs, and what it gives."""
    sc = spark.sparkContext._jsc.sc()
    before = set(stages(sc))
    out = run()
    sc.listenerBus().waitUntilEmpty()
    return sum(size for i, size in stages(sc).items() if i not in before), out


def stages(sc):
    store, kept = sc.statusStore(), {}
    jobs = store.jobsList(None)
    for i in range(jobs.size()):
        ids = jobs.apply(i).stageIds()
        for k in range(ids.size()):
            try:
                kept[ids.apply(k)] = store.lastStageAttempt(ids.apply(k)).resultSize()
            except Py4JJavaError:  # an older stage that the store has let go
                continue
    return kept


def test_no_partition_sends_a_sample_of_its_own(spark):
    """2,000 vectors of 64 numbers, 50 in each of 40 partitions, of which 50 are the sample."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 64))
    df = table(spark, [(i, x[i]) for i in range(2000)]).repartition(40).localCheckpoint()
    want = [r["v"] for r in df.orderBy(F.xxhash64("id"), "id").limit(50).collect()]
    size, cells = sent_to_driver(spark, lambda: vectors.fit(df, 2000, 10, 50))
    # 50 vectors are 25 KB; those of all partitions would be 1 MB
    assert size < 300_000 and len(cells.centres) == 44
    assert [r["v"] for r in vectors.sampled(df, 50).collect()] == want
    # one id on all rows: none can be told from another by its hash
    hot = df.withColumn("id", F.lit(7).cast("bigint"))
    size, cells = sent_to_driver(spark, lambda: vectors.fit(hot, 2000, 10, 50))
    assert size < 300_000 and len(cells.centres) == 44
    assert vectors.sampled(df.where("id < 20"), 50).count() == 20


def test_lists_of_queries_are_not_broadcast(spark):
    """A thousand queries that look into many cells: their vectors go to the cells by shuffle, and not by the driver."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1000, 24))
    df = table(spark, [(i, x[i]) for i in range(1000)])
    size, found = sent_to_driver(spark, lambda: vectors.nearest(df, df, "id", "v").agg(F.count("*")).first()[0])
    # 1,000 vectors of 24 numbers are 0.2 MB, and so much once for each cell that is looked into
    assert found == 10_000 and size < 1_000_000


def test_odd_vectors(spark):
    rows = [(1, [1, 0]), (2, [2, 0]), (3, [0, 0]), (4, None), (5, []), (6, [1, 2, 3]), (7, [float("nan"), 1]), (8, [float("inf"), 1]), (None, [1, 1]), (9, [0, 1])]
    df = table(spark, rows)
    found = {(r["query"], r["id"]): r["similarity"] for r in vectors.nearest(df, df, "id", "v").collect()}
    assert found == pytest.approx({(a, b): float(a + b == 3) for a in (1, 2, 3, 9) for b in (1, 2, 3, 9) if a != b})
    assert vectors.nearest(df.where("false"), df, "id", "v").count() == 0
    assert vectors.nearest(df.where("id = 1"), df.where("id = 2"), "id", "v").count() == 1
