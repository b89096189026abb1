"""Sharding, conversation repair and periodic runs against plain versions, with odd rows and hot groups."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalloom.llm import feistel, periodic, queries, turns

random.seed(11)

# -- sharding -----------------------------------------------------------------------------------------------------------


def plain_place(x, rows, shards, seed):
    side = feistel.side_of(rows)

    def once(v):
        left, right = divmod(v, side)
        for i in range(feistel.ROUNDS):
            left, right = right, (left + int(hashlib.sha256(f"{seed}:{i}:{right}".encode()).hexdigest()[:13], 16) % side) % side
        return left * side + right

    x = once(x)
    while x >= rows:
        x = once(x)
    return x % shards, x // shards


@pytest.mark.parametrize("rows", [1, 2, 3, 7, 16, 17, 300])
def test_places_are_a_permutation_and_computable(spark, rows):
    shard, slot = feistel.place(F.col("id"), rows, 5, "s")
    found = spark.range(rows).select("id", shard.alias("shard"), slot.alias("slot")).withColumn("back", feistel.number_at(F.col("shard"), F.col("slot"), rows, 5, "s")).collect()
    assert [(r["shard"], r["slot"]) for r in sorted(found)] == [plain_place(i, rows, 5, "s") for i in range(rows)]
    assert all(r["back"] == r["id"] for r in found)
    assert sorted(r["slot"] * 5 + r["shard"] for r in found) == list(range(rows))


def test_slots_beyond_a_shard_have_no_row(spark):
    rows = spark.createDataFrame([(4, 2), (0, 3), (-1, 0), (9, 0), (0, -1)], "a int, b bigint").select(feistel.number_at(F.col("a"), F.col("b"), 14, 5, "s").alias("n")).collect()
    assert all(r["n"] is None for r in rows)
    assert spark.range(1).select(feistel.number_at(F.lit(0), F.lit(0), 0).alias("n")).first()["n"] is None


DOCS = [(i, random.choice(["", "a", "äöü", "same text", None, "x" * 5000])) for i in range(40)] + [(None, "n"), (None, None), (3, "again"), (3, "again")] + [(7, "hot")] * 30


def test_shards_are_the_plain_ones_and_dont_hang_on_the_tables_files(spark):
    size = lambda t: len((t or "").encode()) + 16
    crc = lambda t: zlib.crc32((t or "").encode())
    ranked = sorted(((i is not None, i or 0), crc(t), size(t), i, t) for i, t in DOCS)
    want = Counter((i, size(t), crc(t), "rows", *plain_place(n, len(DOCS), 40, feistel.SEED), None) for n, (_, _, _, i, t) in enumerate(ranked))
    df = spark.createDataFrame([(i, t, "q", 1, 2) for i, t in DOCS], "doc_id bigint, text string, shard string, _place int, _number int")
    for parts in (1, 7):
        rows = feistel.shuffled(df.repartition(parts)).collect()
        assert Counter(map(tuple, rows)) == want
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts[s] for s in range(40)) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    assert feistel.shuffled(df.where("false")).count() == 0
    other = feistel.shuffled(df, seed="18").collect()
    assert Counter(map(tuple, other)) != want


def test_a_hot_key_is_spread_over_ranges(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("k"))
    found, n = feistel.numbered(df, ["k"])
    assert n == 20000 and sorted(r["row_number"] for r in found.collect()) == list(range(20000))
    ranked = [r["k"] for r in sorted(found.collect(), key=lambda r: r["row_number"])]
    assert ranked == sorted(ranked)


def test_written_shards_hold_all_rows_in_the_order_of_slots(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}", f"k{i % 3}", i % 2) for i in range(200)], "doc_id bigint, text string, lang string, _part int").repartition(4)
    feistel.write_shards(df, f"file://{tmp_path}/out", shards=7)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted(map(tuple, back.select("doc_id", "text", "lang", "_part").collect())) == sorted(map(tuple, df.collect()))
    for (folder,) in back.select(F.regexp_extract(F.input_file_name(), "shard=(\\d+)", 1)).distinct().collect():
        files = sorted(p for p in (tmp_path / "out" / f"shard={folder}").iterdir() if p.suffix == ".parquet")
        slots = [r["slot"] for p in files for r in spark.read.parquet(f"file://{p}").collect()]
        assert slots == list(range(len(slots)))


# -- conversations ------------------------------------------------------------------------------------------------------

SPACE = re.compile(r"[^\x20\x09-\x0D]")


def flagged(rows):
    """(role, text, fault, truncated) in order."""
    rows = sorted(((t is not None, t or 0, r, x) for t, r, x in rows))
    seen, out = set(), []
    for _, _, role, text in rows:
        solid = SPACE.findall(text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def all_repairs(rows):
    """Every way to edit, with up to two insertions at each place: (cost, audit, turns)."""
    legal = re.compile("(s?(ua)+)?")
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    found = [(0, "", ())]
    for role, text, fault in rows:
        found = [(c + 3 * len(i), a + "I" * len(i), t + tuple((r, "") for r in i)) for c, a, t in found for i in inserts]
        more = [(c + 4, a + "D", t) for c, a, t in found]
        if fault in ("", "truncated"):
            worse = 3 if fault else 0
            more += [(c + worse, a + "K", (*t, (role, text))) for c, a, t in found]
            more += [(c + worse + 3, a + "R", (*t, (r, text))) for c, a, t in found for r in ("user", "assistant")]
        found = more
    found = [(c + 3 * len(i), a + "I" * len(i), t + tuple((r, "") for r in i)) for c, a, t in found for i in inserts]
    return min((c, a, t) for c, a, t in found if legal.fullmatch("".join(r[:1] or "-" for r, _ in t)))


ROLES = ["user", "assistant", "system", "tool", ""]
SAID = ["Yes.", "No", "Well!", "Why?", "", " \t", "Hm . ", "No", "é"]


def plain_repair(rows):
    f = flagged([(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows])
    cost, audit, said = all_repairs(f)
    numbers = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for r, _, _ in f]
    return {
        "gaps": max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
        **{k: sum(x == k for _, _, x in f) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
        "cost": cost, "audit": audit, "turns": list(said),
    }


def convs(n, most=3):
    return {i: [(random.choice([None, 0, 1, 2, 5]), random.choice([*ROLES, "user", "assistant", None]), random.choice([*SAID, None])) for _ in range(random.randrange(1, most + 1))] for i in range(n)}


def check_repairs(spark, data, **how):
    rows = [(i, *t, "x", 3) for i, c in data.items() for t in c]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, cost string, pos int").repartition(3)
    out = turns.repaired(df, **how).collect()
    assert len(out) == len(data)
    for r in out:
        want = plain_repair(data[r["conv_id"]])
        got = r.asDict() | {"turns": [(t["role"], t["text"]) for t in r["turns"]]}
        assert {k: got[k] for k in want} == want, data[r["conv_id"]]


def test_repair_is_the_cheapest_of_all(spark):
    data = convs(150)
    data[None] = data.pop(0)
    check_repairs(spark, data)


def test_longer_repairs_of_clean_and_broken_roles(spark):
    data = {i: [(t, random.choice(["user", "assistant", "system"]), f"{t} {random.choice('.!ab')}") for t in range(4)] for i in range(3)}
    check_repairs(spark, data)


def test_blocks_of_a_long_conversation_give_the_same(spark, monkeypatch):
    data = convs(60, 3)
    many = {1: [(t, random.choice(ROLES), random.choice(SAID)) for t in range(1300)]}
    frame = lambda d: spark.createDataFrame([(i, *t) for i, c in d.items() for t in c], "conv_id bigint, turn bigint, role string, text string")
    whole = turns.repaired(frame(many)).collect()
    assert len(whole[0]["audit"].replace("I", "")) == 1300
    for size in (1, 2, 97, 5000):
        monkeypatch.setattr(turns, "BLOCK", size)
        assert turns.repaired(frame(many)).collect() == whole
    monkeypatch.setattr(turns, "BLOCK", 1)
    check_repairs(spark, data)


def test_damage(spark):
    rows = [(i % 50, i, random.choice(["user", "assistant", None]), random.choice(["A. b! c?", None, "x"])) for i in range(400)] + [(None, 1, "user", "Null id."), (900, None, "user", "Null turn.")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    want = Counter()
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want[(c, t, "user" if kind == 4 else role, text, kind != 0)] += 2 if kind == 3 else 1
    assert Counter(map(tuple, turns.damaged(df).select("conv_id", "turn", "role", "text", "present").collect())) == want


def test_conversations_of_which_nothing_is_left(spark):
    dropped = next((c, t) for c in range(100) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(*dropped, "user", "Hi.")], "conv_id bigint, turn bigint, role string, text string")
    (r,) = turns.repaired(turns.damaged(df), present="present").collect()
    assert r.asDict() == {"conv_id": dropped[0], "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "turns": []}
    assert turns.repaired(df.where("false")).count() == 0


def test_a_repair_shuffles_once(spark):
    df = spark.createDataFrame([(1, 1, "user", "Hi.")], "conv_id bigint, turn bigint, role string, text string")
    plan = turns.repaired(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and plan.count("Exchange") == 1


# -- runs ---------------------------------------------------------------------------------------------------------------


def plain_runs(ids):
    n, out = len(ids), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and ids[i] == ids[i + q]:
                i += 1
            if i > s and i + q - s >= max(6, 4 * q) and not any(all(ids[k] == ids[k + d] for k in range(s, i + q - d)) for d in range(1, q)):
                out.append((s, i + q - s, q))
            i += 1 if i == s else 0
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(0, 60), st.integers(1, 7), st.integers(0, 60))
def test_runs_are_those_of_brute_force(base, a, p, b):
    ids = [base[i] if i < a else base[a + (i - a) % p] if a + (i - a) % p < len(base) else 7 for i in range(len(base))]
    if b < len(ids):
        ids[b] = 9
    assert periodic.runs_of(np.array(ids, np.int32)) == plain_runs(ids)


def test_a_hash_that_lies_gives_no_wrong_run(monkeypatch):
    """All hashes are equal, so every extension goes too far; what comes out is compared word by word and right."""
    monkeypatch.setattr(periodic._Extensions, "_alike", lambda self, a, b, size: True)
    ids = np.array([*range(20), *[1, 2, 3] * 12, 50, 51, *range(10)], np.int32)
    assert periodic.runs_of(ids) == plain_runs(ids.tolist())


def test_long_runs_and_words_of_many_bytes(monkeypatch):
    monkeypatch.setattr(periodic, "PIECE", 1 << 14)
    block = [f"wörd{i}" for i in range(700)]
    words = ["x", *block * 9, *block[:50], "y"]
    raw = " \n".join(words).encode()
    ids, known = periodic.word_ids(raw)
    assert [known[i].decode() for i in ids] == words
    assert periodic.runs_of(ids) == [(1, 6350, 700)]
    ids, known = periodic.word_ids(b"ab " * (1 << 15) + b"c" * (1 << 18) + b"\x0bd")
    assert len(known) == 3 and periodic.runs_of(ids) == [(0, 1 << 15, 1)]


TEXTS = [None, "", " \t\n", "one", "a a a a a", "a a a a a a", "A a a a a a a b", "a b " * 4 + "a", "a b c " * 5, "v " + "x y z " * 30 + "w " + "x y " * 9, "a a a a a a", "a b c a b c a b c a b c d d d d d d d"]


def derived(key, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(key).encode()) if key is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    kept = [True] * n
    for s, size, q in runs:
        kept[s + q : s + size] = [False] * (size - q)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (key, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for x, k in zip(w, kept) if k)))


def test_run_query_is_the_plain_one(spark, tmp_path):
    tens = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 == 0][:60]
    rows = [(i, " ".join(random.choice("abcdefgh") for _ in range(random.randrange(0, 60)))) for i in tens]
    rows += [(i, t) for i, t in enumerate(TEXTS)] + [(None, t) for t in TEXTS] + [(1, "a a a a a a a")] * 2
    spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id bigint, text string, runs int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(map(tuple, queries.op13_runs(spark, str(tmp_path)).collect()))
    assert got == Counter(derived(i, t) for i, t in rows)
    out = periodic.periodic_runs(spark.read.parquet(f"{tmp_path}/documents.parquet").where("false"), keep=["doc_id", "runs"])
    assert out.columns == ["doc_id", "runs", "collapsed"] and out.count() == 0


def test_greatest_run_is_exact(spark):
    cases = [[(0, 9, 2), (3, 14, 3)], [(0, 9, 2), (20, 9, 2)], [(5, 8, 2), (5, 4, 1)], []]
    df = spark.createDataFrame([(i, [{"start": a, "length": b, "period": c} for a, b, c in x]) for i, x in enumerate(cases)], "i int, runs array<struct<start:bigint,length:bigint,period:bigint>>")
    got = [r["b"] and tuple(r["b"]) for r in df.orderBy("i").select(periodic.greatest(F.col("runs")).alias("b")).collect()]
    assert got == [(3, 14, 3), (0, 9, 2), (5, 8, 2), None]


