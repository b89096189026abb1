"""SimHash near-duplicates: fingerprints, deletion-variant signatures of their segments, links; groups of similar texts by these and by their shingles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, differences, discard, flat, hot_lookup, map_array, materialize, mix, pack, remove, shared_dir, slices, tidied, unpack, word_bounds, word_hashes, write_bytes
from .components import components

#: Texts of more bytes are hashed in blocks of so many words.
LONG_TEXT, BLOCK_WORDS = 4 << 20, 1 << 18
#: Index buckets up to this size are compared pair by pair; larger ones are refined until all members of a group agree.
SMALL_BUCKET = 32
#: byte -> its bits, one in each byte of a 64-bit integer
_SPREAD = sum(((np.arange(256, dtype=np.uint64) >> np.uint64(k)) & np.uint64(1)) << np.uint64(8 * k) for k in range(8))


def shingle_spans(starts: np.ndarray, ends: np.ndarray, first: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, last word) of each shingle, and the number of shingles of each text; shorter texts have one of all words."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
    to = np.concatenate([[0], np.cumsum(count)])
    a = np.repeat(first[:-1] - to[:-1], count) + np.arange(to[-1])
    return a, a + np.repeat(np.minimum(n, words) - 1, count), count


def majority(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each text the 64 bits that are set in over half of its hashes; zero for texts without any."""
    out = np.zeros(len(count), np.uint64)
    some = np.flatnonzero(count)
    if not len(some):
        return out
    c = count[some]
    # a byte-wide counter holds 255 at most, so texts are summed up in blocks
    blocks = -(-c // 255)
    first = np.concatenate([[0], np.cumsum(blocks)])[:-1]
    at = np.concatenate([[0], np.cumsum(c)])[:-1]
    begin = np.repeat(at, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(first, blocks))
    parts = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for j in range(8):
        sums = np.add.reduceat(_SPREAD[parts[:, j]], begin).astype("<u8").view(np.uint8).reshape(-1, 8)
        total = np.add.reduceat(sums.astype(np.int64), first, axis=0)
        bits = (2 * total > c[:, None]).astype(np.uint64)
        out[some] |= (bits << np.arange(8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) << np.uint64(8 * j)
    return out


def exact_fingerprints(texts: pa.Array, words: int, seed: int) -> np.ndarray:
    """SimHash over XXH64 of the space-joined shingles of lower-cased (A-Z) words, repeats included. A text over ``LONG_TEXT``
    bytes is taken in blocks of words, which add to its counts of bits."""
    out = [np.zeros(0, np.uint64)]
    for a, b in slices(texts):
        data, offsets = flat(texts.slice(a, b - a))
        starts, ends, first = word_bounds(data, offsets)
        if b - a == 1 and len(data) > LONG_TEXT and len(starts) >= words:
            ones, n = np.zeros(64, np.int64), len(starts) - words + 1
            for i in range(0, n, BLOCK_WORDS):
                j = min(i + BLOCK_WORDS, n) + words - 1
                hashes, _ = _hashed(data, starts[i:j], ends[i:j], np.array([0, j - i]), words, seed)
                ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out.append(np.packbits(2 * ones > n, bitorder="little").view("<u8").astype(np.uint64))
        else:
            out.append(majority(*_hashed(data, starts, ends, first, words, seed)))
    return np.concatenate(out)


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and how many each text has."""
    digest = xxhash.xxh64_intdigest
    size = ends - starts
    to = np.concatenate([[0], np.cumsum(size + 1)])
    joined = np.full(to[-1], 32, np.uint8)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    joined[np.repeat(to[:-1], size) + within] = _LOWER[data[np.repeat(starts, size) + within]]
    raw = joined.tobytes()
    lo, hi, count = shingle_spans(starts, ends, first, words)
    return np.array([digest(raw[i:j], seed) for i, j in zip(to[lo].tolist(), (to[hi] + size[hi]).tolist())], np.uint64), count


def fingerprints(df: DataFrame, words: int = 3, seed: int = 42, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, fp`` (a signed 64-bit integer) of every row; null, empty and blank texts have 0. One narrow pass, whole texts."""

    @tidied
    def run(batches):
        for batch in batches:
            fp = exact_fingerprints(batch.column(1), words, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], [key, "fp"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, fp bigint")


def _without(x: Column, *bits: Column | int) -> Column:
    for b in bits:
        x = x.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("bigint"), b if isinstance(b, Column) else F.lit(b))))
    return x


def links(fps: DataFrame) -> DataFrame:
    """``a, b``: links enough to connect all different ``fp`` (one column) that differ in at most two bits; each is such a pair.

    A fingerprint is cut into two halves, fewer than the three of which one would have to be equal: of two differing bits one
    half has at most one. Indexed are the 32 variants of the upper half with one bit deleted, and the lower half as it is
    (for pairs with both bits in the upper one). Fingerprints that share an entry are compared. Where more than
    ``SMALL_BUCKET`` share one, they are indexed anew under their variants with two bits deleted: each such group has four
    members at most, all within two bits, so no pairs within a large bucket are built and no link is lost.
    """
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(0xFFFFFFFF)
    entries = [F.lit(j << 32).cast("bigint").bitwiseOR(_without(high, j)) for j in range(32)] + [F.lit(32 << 32).cast("bigint").bitwiseOR(low)]
    index = fps.select("fp", F.explode(F.array(*entries)).alias("entry"))
    sizes = index.groupBy("entry").agg(F.count("*").alias("n_rows")).where("n_rows > 1")
    sizes = materialize(sizes.withColumn("n", F.col("n_rows")), "buckets")
    rows = sizes.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    members = materialize(hot_lookup(index, sizes, "entry", rows, "inner"), "members")

    bit = F.shiftrightunsigned("entry", 32)
    small = members.where(F.col("n") <= SMALL_BUCKET).groupBy("entry").agg(F.collect_list("fp").alias("m"))
    left = small.select("entry", "m", F.explode("m").alias("a"))
    pairs = left.select("entry", "a", F.explode(F.filter("m", lambda x: x > F.col("a"))).alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    # pairs with equal upper halves share all its variants; the first one is enough
    wanted = (bit == 0) | (bit == 32) | (F.shiftrightunsigned(differ, 32) != 0)
    near = pairs.where(wanted & (F.bit_count(differ) <= 2)).select("a", "b")

    large = members.where(F.col("n") > SMALL_BUCKET).withColumn("bit", bit.cast("int"))
    wild = F.expr("flatten(transform(sequence(1, 31), i -> transform(sequence(0, i - 1), j -> array(i, j))))")
    same_high = large.where("bit = 0").select("fp", F.explode(wild).alias("w"))
    same_low = large.where("bit = 32").select("fp", F.explode(wild).alias("w")).withColumn("w", F.transform("w", lambda x: x + 32))
    mixed = large.where("bit < 32").select("fp", "bit", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i")).select("fp", F.array(F.col("bit") + 32, "i").alias("w"))
    refined = same_high.unionByName(same_low).unionByName(mixed).select("fp", "w", _without(F.col("fp"), F.col("w")[0], F.col("w")[1]).alias("rest"))
    group = refined.groupBy("w", "rest").agg(F.collect_set("fp").alias("m")).where(F.size("m") > 1)
    star = group.select(F.array_min("m").alias("a"), F.explode("m").alias("b")).where("a <> b")
    return near.unionByName(star).distinct()


def near_duplicates(df: DataFrame, words: int = 3, seed: int = 42, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, fp, component_id`` of every row: rows whose fingerprints differ in two bits at most are linked.

    ``component_id`` is the least non-null key that a row reaches, itself included; null if it reaches none. Texts without
    words have fingerprint zero and are linked like others; repeated rows and equal keys keep their number. Work is done on
    different fingerprints, so a group of copies of any size is one of them; the way back is a join that knows its hot keys.
    """
    found = materialize(fingerprints(df, words, seed, text, key), "fingerprints")
    each = materialize(found.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n_rows")), "distinct")
    rows = each.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    groups = materialize(components(links(each.select("fp"))), "groups")
    named = each.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = materialize(named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n_rows")), "ids")
    table = materialize(hot_lookup(named.select("fp", "root", F.col("n_rows").alias("n")), ids, "root", max(rows, 1), "inner").select("fp", "component_id", F.col("n").alias("n_rows")), "components")
    return hot_lookup(found, table, "fp", rows, "inner").select(key, "fp", "component_id")


# -- groups of similar texts ------------------------------------------------------------------------------------------

#: Bits of a shingle's hash; the eight above them hold its rank in the order of the index.
HASH = 56
#: Shingles are counted in this many slots (as a power of two), cut into parts of which each is one file.
SLOTS, PARTS = 23, 16
#: Upper bits of a node in the table of nodes that have a pair.
NODES = 26
#: Bits of an entry of the index; what is above them chooses its shard.
ENTRY = 40
#: Index entries that so many texts share at most are compared pair by pair at once.
SMALL_ENTRY = 8


def text_hash(text: str) -> Column:
    """64 bits of the SHA-256 of a text; null is as empty."""
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 16), 16, -10).cast("bigint")


def shingle_hashes(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all shingles of lower-cased words, repeats included; a text without words has one shingle of its own kind."""
    data, offsets = flat(texts)
    starts, ends, first = word_bounds(data, offsets)
    w = word_hashes(data, starts, ends)
    lo, hi, count = shingle_spans(starts, ends, first, words)
    h = np.zeros(len(lo), np.uint64)
    for k in range(words):
        at = lo + k
        h = np.where(at <= hi, mix(h * np.uint64(0x9E3779B97F4A7C15) + w[np.minimum(at, len(w) - 1)]), h) if len(lo) else h
    none = np.flatnonzero(count == 0)
    row = np.concatenate([np.repeat(np.arange(len(count)), count), none])
    return row, np.concatenate([h, np.zeros(len(none), np.uint64)]) >> np.uint64(64 - HASH)


def shingle_sets(texts: pa.Array, words: int, ranks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, hashes, sizes): the different shingles of each text one after the other, by rank and hash, and how many each has."""
    row, h = shingle_hashes(texts, words)
    key = h if ranks is None else (ranks[(h >> np.uint64(HASH - SLOTS)).astype(np.int64)].astype(np.uint64) << np.uint64(HASH)) | h
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    row, key = row[fresh], key[fresh]
    return row, key, np.bincount(row, minlength=len(texts))


def _overlap(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Shingles that two sets of these sizes must share to be similar."""
    return np.ceil(similarity / (1 + similarity) * (n + m) - 1e-6).astype(np.int64)


_ENTRY = np.dtype([("entry", "<u8"), ("id", "<i8"), ("at", "<i4"), ("n", "<i4")])


def _possible(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether two texts can be similar if this entry is the first that they share. Holds for each similar pair at its first
    common entry, so no pair is lost."""
    n, m = x["n"].astype(np.int64), y["n"].astype(np.int64)
    return 1 + np.minimum(n - x["at"] - 1, m - y["at"] - 1) >= np.maximum(_overlap(n, m, similarity), np.ceil(similarity * np.maximum(n, m) - 1e-6))


def _unique_pairs(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    a, b = np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])
    return np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)


def _first_pairs(rows: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, rows left over) of rows sorted by entry and place: all possible pairs of small entries. In large ones each row goes
    with the first and the one before; those rows are left over for ``_last_pairs``."""
    if not len(rows):
        return np.zeros((0, 2), np.int64), rows
    fresh = np.concatenate([[True], rows["entry"][1:] != rows["entry"][:-1]])
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), 0))
    size = np.diff(np.append(np.flatnonzero(fresh), len(rows)))
    large = np.repeat(size > SMALL_ENTRY, size)
    at, a, b = np.arange(len(rows)), [], []
    others = [(np.where(large, first, -1)), *(np.where((large & (d > 1)) | (at - d < first), -1, at - d) for d in range(1, SMALL_ENTRY))]
    for other in others:
        i = np.flatnonzero((other >= 0) & (other < at))
        j = other[i]
        ok = _possible(rows[i], rows[j], similarity)
        a.append(rows["id"][i[ok]])
        b.append(rows["id"][j[ok]])
    return _unique_pairs(a, b), rows[large]


def _last_pairs(rows: np.ndarray, root: np.ndarray, similarity: float) -> np.ndarray:
    """All possible pairs within each entry whose texts are not yet in one group. Those in the entry's largest group need
    no comparison with each other, so a crowd of copies costs nothing."""
    cut = np.flatnonzero(np.concatenate([[True], rows["entry"][1:] != rows["entry"][:-1]])) if len(rows) else np.zeros(0, np.int64)
    a, b = [], []
    for i, j in zip(cut.tolist(), np.append(cut[1:], len(rows)).tolist()):
        part, group = rows[i:j], root[i:j]
        names, inverse, count = np.unique(group, return_inverse=True, return_counts=True)
        if len(names) == 1:
            continue
        inside = inverse == count.argmax()
        for k in np.flatnonzero(~inside).tolist():
            ok = (group != group[k]) & (inside | (np.arange(j - i) < k))
            other = part[ok]
            other = other[_possible(other, np.broadcast_to(part[k], len(other)), similarity)]
            a.append(np.full(len(other), part["id"][k]))
            b.append(other["id"])
    return _unique_pairs(a, b)


def _pack_rows(rows: np.ndarray) -> bytes:
    return pack(differences(rows["entry"]), *(rows[k].copy() for k in ("id", "at", "n")))


def _unpack_rows(blobs: list[bytes]) -> np.ndarray:
    parts = [unpack(b) for b in blobs]
    rows = np.empty(sum(len(p[0]) for p in parts), _ENTRY)
    at = 0
    for entry, *rest in parts:
        end = at + len(entry)
        rows["entry"][at:end] = np.cumsum(entry, dtype=np.uint64)
        for k, v in zip(("id", "at", "n"), rest):
            rows[k][at:end] = v
        at = end
    return rows


def shingle_ranks(rows: DataFrame, words: int) -> str:
    """Folder of ``PARTS`` files: the rank of each slot of shingle hashes, eight times the logarithm of how many shingles fall into it.

    The ranks only order the index, rare shingles first; whatever they are, no pair is lost by them. Their size is fixed.
    """
    folder = shared_dir(rows.sparkSession, "ranks")
    width = 1 << (SLOTS - PARTS.bit_length() + 1)

    @tidied
    def count(batches):
        # a task adds up its own counts first: what it ships is a slot's share of a byte, whatever the number of its texts
        total = np.zeros(1 << SLOTS, np.int32)
        for batch in (whole.slice(a, b - a) for whole in batches for a, b in slices(whole.column(1))):
            _, h, _ = shingle_sets(batch.column(1), words)
            slot, n = np.unique((h >> np.uint64(HASH - SLOTS)).astype(np.uint32), return_counts=True)
            total[slot] += n.astype(np.int32)
        slot = np.flatnonzero(total).astype(np.uint32)
        cut = np.searchsorted(slot, np.arange(PARTS + 1) * width)
        parts = [p for p in range(PARTS) if cut[p] < cut[p + 1]]
        blobs = [pack(differences(slot[cut[p] : cut[p + 1]] - np.uint32(p * width)), total[slot[cut[p] : cut[p + 1]]].astype(np.uint32)) for p in parts]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(blobs, pa.binary())], ["part", "counts"])

    def rank(table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for slot, n in map(unpack, table.column("counts").drop_null().to_pylist()):
            total[np.cumsum(slot, dtype=np.uint32)] += n
        part = table.column("part")[0].as_py()
        write_bytes(f"{folder}/{part}", np.minimum(255, np.round(8 * np.log2(np.maximum(total, 1)))).astype(np.uint8).tobytes())
        return pa.table({"part": pa.array([part], pa.int64())})

    # a file for each part, also where no shingle falls into it
    every = rows.sparkSession.range(PARTS).select(F.col("id").alias("part"), F.lit(None).cast("binary").alias("counts"))
    made = rows.select("_node", "_text").mapInArrow(count, "part bigint, counts binary").unionByName(every)
    made.groupBy("part").applyInArrow(rank, "part bigint").count()
    return folder


def met_nodes(pairs: DataFrame) -> str:
    """Folder of ``PARTS`` files, a bit for each of the 2^``NODES`` values of a node's upper bits: whether any pair has one.

    Of fixed size: it spares texts without a pair the shuffle; the more nodes are met, the more others it lets through.
    """
    folder = shared_dir(pairs.sparkSession, "nodes")
    width = (1 << NODES) // PARTS

    def bits(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        out = np.zeros(width, np.uint8)
        out[table.column("slot").drop_null().to_numpy() - part * width] = 1
        write_bytes(f"{folder}/{part}", np.packbits(out, bitorder="little").tobytes())
        return pa.table({"part": pa.array([part], pa.int64())})

    slots = pairs.select(F.explode(F.array("a", "b")).alias("node")).select(F.shiftrightunsigned("node", 64 - NODES).alias("slot")).distinct()
    every = pairs.sparkSession.range(PARTS).select(F.col("id").alias("part"), F.lit(None).cast("bigint").alias("slot"))
    slots.select(F.shiftright("slot", NODES - PARTS.bit_length() + 1).alias("part"), "slot").unionByName(every).groupBy("part").applyInArrow(bits, "part bigint").count()
    return folder


def similar_pairs(pairs: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the pairs ``a, b`` of nodes whose sets of shingles have this Jaccard similarity or more, counted in full.

    No text is shuffled: a task makes the sets of its texts that have a pair, one a node, and these are brought to the pairs.
    """
    folder = met_nodes(pairs)

    @tidied
    def sets(batches):
        met, seen = np.concatenate([map_array(f"{folder}/{p}", np.uint8) for p in range(PARTS)]), np.zeros(0, np.int64)
        for whole in batches:
            node = np.asarray(whole.column(0))
            slot = (node.view(np.uint64) >> np.uint64(64 - NODES)).astype(np.int64)
            once = np.zeros(len(node), bool)
            once[np.unique(node, return_index=True)[1]] = True
            whole = whole.take(pa.array(np.flatnonzero(once & (met[slot >> 3] >> (slot & 7) & 1).astype(bool) & ~np.isin(node, seen))))
            seen = np.union1d(seen, np.asarray(whole.column(0)))
            for batch in (whole.slice(a, b - a) for a, b in slices(whole.column(1))):
                _, h, size = shingle_sets(batch.column(1), words)
                ends = np.cumsum(size)
                blobs = [pack(differences(h[e - n : e])) for e, n in zip(ends.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["node", "set"])

    @tidied
    def verify(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.cumsum(unpack(v.as_py())[0], dtype=np.uint64) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append(common >= similarity * (len(x) + len(y) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    known = materialize(rows.select("_node", "_text").mapInArrow(sets, "node bigint, set binary").dropDuplicates(["node"]), "sets")
    side = lambda x: known.select(F.col("node").alias(x), F.col("set").alias(f"s_{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "s_a", "s_b")
    out = materialize(joined.mapInArrow(verify, "a bigint, b bigint"), "similar")
    discard(known)
    remove(rows.sparkSession, folder)
    return out


def fingerprint_pairs(rows: DataFrame) -> DataFrame:
    """``a, b``: pairs of nodes (different texts) whose fingerprints differ in two bits at most.

    They are enough to connect all such nodes: of those with one fingerprint each goes with the least, and by ``links`` the
    least ones of near fingerprints go together.
    """
    known = materialize(fingerprints(rows, text="_text", key="_node").distinct(), "fingerprints")
    each = materialize(known.groupBy("fp").agg(F.min("_node").alias("least"), F.count("*").alias("n_rows")), "distinct")
    nodes = each.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    same = hot_lookup(known, each, "fp", nodes, "inner").select(F.col("_node").alias("x"), F.col("least").alias("y"))
    side = lambda c, x: each.select(F.col("fp").alias(c), F.col("least").alias(x))
    near = links(each.select("fp")).join(side("a", "x"), "a").join(side("b", "y"), "b").select("x", "y")
    out = materialize(same.unionByName(near).where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "pairs")
    discard(known, each)
    return out


def similar_groups(df: DataFrame, words: int = 5, similarity: float = 0.8, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, root, text_hash, component`` of every row: rows whose sets of shingles have this Jaccard similarity or more are
    linked, and linked rows are one ``component``. ``root`` is its least key.

    Nodes are different texts, by hash, so equal texts are one and rows that share a key without being similar stay apart.
    Texts whose SimHash fingerprints differ in two bits at most (``links``) are compared by their whole sets first. What 64 bits
    don't show, an index finds, in which texts that are in one group by then need no comparison: of the shingles of a text, ordered from rare to frequent, as many go into the index as one must be shared by any
    similar text (a fifth of them, at 0.8). Texts that meet there and can be similar by their sizes and places are compared by
    their whole sets: no similar pair is lost and no other is linked. Passages that many texts share are frequent, come last
    and fill no entry. Null, empty and blank texts are equal to each other; null keys are put in no group and get a null root.

    An entry that many texts share never becomes all its pairs: its texts are first compared with the one that has the fewest
    rarer shingles (as the original of edited copies) and with the one before; then only texts that are not yet in one group.
    """
    kind = df.schema[key].dataType.simpleString()
    rows_in = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_id"), text_hash(text).alias("_node"), F.col(text).alias("_text"))
    found = materialize(rows_in.select("_id", "_node", F.length("_text").alias("_size")), "texts")
    rows, size = found.agg(F.count("*"), F.coalesce(F.sum("_size"), F.lit(0))).first()
    ranks = shingle_ranks(rows_in, words)
    # a word has about six letters, a fifth of the shingles are indexed: about a million entries a shard
    shards = max(12, size // 30_000_000)

    @tidied
    def entries(batches):
        order = np.concatenate([map_array(f"{ranks}/{p}", np.uint8) for p in range(PARTS)])
        for batch in (whole.slice(a, b - a) for whole in batches for a, b in slices(whole.column(1), 4 << 20)):
            node, once = np.unique(np.asarray(batch.column(0)), return_index=True)
            row, h, n = shingle_sets(batch.column(1).take(pa.array(once)), words, order)
            at = np.arange(len(row)) - (np.cumsum(n) - n)[row]
            keep = at <= n[row] - np.ceil(similarity * n[row] - 1e-6)
            row, h, at = row[keep], h[keep] & np.uint64((1 << HASH) - 1), at[keep]
            shard = ((mix(h) >> np.uint64(ENTRY)) % np.uint64(shards)).astype(np.int64)
            out = np.empty(len(row), _ENTRY)
            out["entry"], out["id"], out["at"], out["n"] = mix(h) & np.uint64((1 << ENTRY) - 1), node[row], at, n[row]
            sort = np.lexsort((out["entry"], shard))
            out, shard = out[sort], shard[sort]
            cut = np.searchsorted(shard, np.arange(shards + 1))
            full = [s for s in range(shards) if cut[s] < cut[s + 1]]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([_pack_rows(out[cut[s] : cut[s + 1]]) for s in full], pa.binary())], ["shard", "rows"])

    def match(table: pa.Table) -> pa.Table:
        row = _unpack_rows(table.column("rows").to_pylist())
        row = row[np.lexsort((row["id"], row["at"], row["entry"]))]
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row["entry"][1:] != row["entry"][:-1]) | (row["id"][1:] != row["id"][:-1])
        pair, left = _first_pairs(row[fresh], similarity)
        shard = table.column("shard")[0].as_py()
        a = pa.array([*pair[:, 0].tolist(), None], pa.int64())
        b = pa.array([*pair[:, 1].tolist(), None], pa.int64())
        return pa.table({"shard": pa.array(np.full(len(a), shard), pa.int64()), "a": a, "b": b, "rest": pa.array([None] * len(pair) + [_pack_rows(left) if len(left) else None], pa.binary())})

    @tidied
    def spread(batches):
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                r = _unpack_rows([blob])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), shard), pa.int64()), pa.array(r["entry"].astype(np.int64)), *(pa.array(r[k].copy()) for k in ("id", "at", "n"))], ["shard", "entry", "id", "at", "n"])

    def rest_pairs(table: pa.Table) -> pa.Table:
        row = np.empty(table.num_rows, _ENTRY)
        for k in ("entry", "id", "at", "n"):
            row[k] = table.column(k).to_numpy()
        order = np.lexsort((row["at"], row["entry"]))
        pair = _last_pairs(row[order], table.column("root").to_numpy()[order], similarity)
        return pa.table({"a": pa.array(pair[:, 0].copy(), pa.int64()), "b": pa.array(pair[:, 1].copy(), pa.int64())})

    def linked(pairs: DataFrame, before: DataFrame | None = None) -> DataFrame:
        """Groups by those of the pairs that are similar, and by the groups that there are."""
        similar = similar_pairs(pairs, rows_in, words, similarity)
        edges = similar if before is None else similar.unionByName(before.select(F.col("node").alias("a"), F.col("root").alias("b")))
        out = materialize(components(edges), "groups")
        discard(pairs, similar, *([] if before is None else [before]))
        return out

    groups = linked(fingerprint_pairs(rows_in))
    packed = rows_in.select("_node", "_text").mapInArrow(entries, "shard bigint, rows binary")
    met = materialize(packed.groupBy("shard").applyInArrow(match, "shard bigint, a bigint, b bigint, rest binary"), "met")
    # texts whose fingerprints have brought them together aren't compared once more
    side = lambda x: groups.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    apart = met.where("a IS NOT NULL").select("a", "b").distinct().join(side("a"), "a", "left").join(side("b"), "b", "left")
    groups = linked(materialize(apart.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"), "pairs"), groups)
    rest = met.where("rest IS NOT NULL").select("shard", "rest")
    if rest.head(1):
        left = rest.mapInArrow(spread, "shard bigint, entry bigint, id bigint, at int, n int")
        left = left.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        more = materialize(left.groupBy("shard").applyInArrow(rest_pairs, "a bigint, b bigint").distinct(), "pairs")
        groups = linked(more, groups) if more.head(1) else groups
    discard(met)
    remove(df.sparkSession, ranks)
    each = found.groupBy("_node").agg(F.min("_id").alias("least"), F.count("*").alias("n_rows"))
    each = materialize(each.join(groups.withColumnRenamed("node", "_node"), "_node", "left").withColumn("component", F.coalesce("root", "_node")).drop("root"), "nodes")
    names = materialize(each.groupBy("component").agg(F.min("least").alias("root"), F.count("*").alias("n_rows")), "names")
    table = materialize(hot_lookup(each.select("_node", "component", F.col("n_rows").alias("n")), names, "component", max(rows, 1), "inner").select("_node", "component", "root", F.col("n").alias("n_rows")), "roots")
    out = hot_lookup(found.select("_id", "_node"), table, "_node", rows, "inner").select(F.col("_id").alias(key), "root", F.col("_node").alias("text_hash"), "component")
    none = df.where(F.col(key).isNull()).select(key, F.lit(None).cast(kind).alias("root"), text_hash(text).alias("text_hash"), F.lit(None).cast("bigint").alias("component"))
    return out.unionByName(none)
