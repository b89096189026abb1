"""Document fingerprints: one-permutation MinHash with optimal densification, packed to low-order bits."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, mix, slices, tidied, word_bounds, word_hashes
from .simhash import shingle_spans

#: Words of a shingle, bins of a fingerprint, bits kept of each bin.
WORDS, BINS, BITS = 5, 512, 4
_EMPTY = np.uint64((1 << 64) - 1)


def densify(bins: np.ndarray) -> np.ndarray:
    """Fill each empty bin with the value of a full one, tried in an order that hangs on the bin's number alone.

    All texts try the same bins in the same order, so two texts agree in a filled bin as likely as in a full one. Every row
    needs one full bin.
    """
    rows, width = bins.shape
    out = bins.copy()
    r, c = np.nonzero(bins == _EMPTY)
    attempt = 0
    while len(r):
        attempt += 1
        other = (mix(c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(width)).astype(np.int64)
        got = bins[r, other]
        full = got != _EMPTY
        out[r[full], c[full]] = got[full]
        r, c = r[~full], c[~full]
        if attempt > 64 * width:  # not reached by chance: take the first full bin
            out[r, c] = bins[r, (bins[r] != _EMPTY).argmax(axis=1)]
            break
    return out


def sketch(texts: pa.Array, words: int = WORDS, bins: int = BINS, bits: int = BITS) -> np.ndarray:
    """Fingerprints of texts, ``bits`` low-order bits for each bin, one byte each. Texts without words have one shingle of their own."""
    out = [np.zeros((0, bins), np.uint8)]
    for a, b in slices(texts, 1 << 20, 4096):
        data, offsets = flat(texts.slice(a, b - a))
        starts, ends, first = word_bounds(data, offsets)
        w = word_hashes(data, starts, ends)
        lo, hi, count = shingle_spans(starts, ends, first, words)
        h = np.zeros(len(lo), np.uint64)
        for k in range(words if len(lo) else 0):
            at = lo + k
            h = np.where(at <= hi, mix(h * np.uint64(0x9E3779B97F4A7C15) + w[np.minimum(at, len(w) - 1)]), h)
        doc = np.repeat(np.arange(len(count)), count)
        none = np.flatnonzero(count == 0)
        h, doc = np.concatenate([h, np.full(len(none), 0x5851F42D4C957F2D, np.uint64)]), np.concatenate([doc, none])
        # one permutation: the upper half of a hash chooses the bin, the lower half is its value
        cell = doc * bins + ((h >> np.uint64(32)) % np.uint64(bins)).astype(np.int64)
        low = np.full(len(count) * bins, _EMPTY, np.uint64)
        np.minimum.at(low, cell, h & np.uint64(0xFFFFFFFF))
        full = densify(low.reshape(-1, bins))
        # a bin's number goes into its bits, so a value that fills many bins agrees by chance in each of them apart
        out.append((mix(full ^ mix(np.arange(1, bins + 1, dtype=np.uint64))) & np.uint64((1 << bits) - 1)).astype(np.uint8))
    return np.concatenate(out)


def pack(values: np.ndarray, bits: int = BITS) -> list[str]:
    """Hexadecimal text of the low-order bits, bin after bin."""
    n, bins = values.shape
    each = (values[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1
    packed = np.packbits(each.reshape(n, bins * bits), axis=1)
    return [row.tobytes().hex() for row in packed]


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity: the share of equal bins, less what chance makes equal, from 0 to 1."""
    chance = 0.5**bits
    return np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0.0, 1.0)


def fingerprints(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, fingerprint`` of every row; equal texts have equal ones, null, empty and blank texts one of their own. No shuffle."""

    @tidied
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pack(sketch(batch.column(1))), pa.string())], [key, "fingerprint"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, fingerprint string")


def _in_order(df: DataFrame, text: str, key: str) -> DataFrame:
    """Rows dealt into ranges of falling keys, a partition each and sorted there: ``b`` (the range), ``own`` (false: the row only
    follows this range's last), key and text.

    Order is by key (of any type that sorts, falling, nulls last), then the text's hash, then the row's number in the input, so
    a key that fills the table is cut too. Ranges are cut at quantiles of a bounded sample of rows, which moves only the cuts.
    The first row of each range goes to the range before it too, and the very first to the last, so each range can be walked
    alone. The driver holds the sample and a row a range. ``df`` is read three times and has to give the same rows in the same
    partitions, as tables do.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
    hashed = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = df.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"), hashed.alias("_hash"), F.monotonically_increasing_id().alias("_n"))
    order = [F.desc_nulls_last("_key"), F.asc("_hash"), F.asc("_n")]
    sample = min(50 * parts, 100_000)
    picked = rows.select("_key", "_hash", "_n").orderBy(F.xxhash64("_key", "_hash", "_n")).limit(sample).orderBy(*order).collect()
    cuts = [picked[i * len(picked) // parts] for i in range(1, parts)] if len(picked) > parts else picked[1:]
    # a row's range is how many cuts lie before it or are it
    places = [(c["_key"] is None, c["_key"], c["_hash"], c["_n"]) for c in cuts]

    def reaches(k, h: int, n: int, cut: tuple) -> bool:
        none, ck, ch, cn = cut
        if none or k is None:
            return k is None and (not none or (h, n) >= (ch, cn))
        return k < ck or (k == ck and (h, n) >= (ch, cn))

    @F.arrow_udf("int")
    def range_of(keys: pa.Array, hashes: pa.Array, numbers: pa.Array) -> pa.Array:
        out = []
        for k, h, n in zip(keys.to_pylist(), hashes.to_pylist(), numbers.to_pylist()):
            lo, hi = 0, len(places)
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if reaches(k, h, n, places[mid]) else (lo, mid)
            out.append(lo)
        return pa.array(out, pa.int32())

    rows = rows.withColumn("_b", range_of("_key", "_hash", "_n"))
    top = F.max(F.struct("_key", F.bitwise_not("_hash").alias("h"), F.bitwise_not("_n").alias("n")))
    tops = rows.drop("_text").groupBy("_b").agg(top.alias("top")).select("_b", "top.*").orderBy("_b").collect()
    kind = rows.schema["_key"].dataType.simpleString()
    before = spark.createDataFrame([(t["_b"], tops[i - 1]["_b"], t["_key"], ~t["h"], ~t["n"]) for i, t in enumerate(tops)], f"_b int, _to int, _top_key {kind}, _top_hash bigint, _top_n bigint")
    told = rows.join(F.broadcast(before), "_b")
    first = F.col("_key").eqNullSafe(F.col("_top_key")) & (F.col("_hash") == F.col("_top_hash")) & (F.col("_n") == F.col("_top_n"))
    own, more = F.struct(F.col("_b").alias("b"), F.lit(True).alias("own")), F.struct(F.col("_to").alias("b"), F.lit(False).alias("own"))
    dealt = told.select(F.explode(F.when(first, F.array(own, more)).otherwise(F.array(own))).alias("_t"), "_key", "_text", "_hash", "_n").select("_t.b", "_t.own", "_key", "_text", "_hash", "_n")
    return dealt.repartitionById(parts, "b").sortWithinPartitions(F.desc("own"), *order).select("b", "own", "_key", "_text")


def edited_likeness(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row.

    The edited text has the last third (rounded down, code points) replaced by as many first code points of the next row's
    text, or all of it. Rows follow each other by falling key, null keys last, equal keys by the text's hash; after the last
    comes the first. Null texts are empty. One shuffle of the texts; each range is walked row by row, so no range has to fit
    in memory, and one key with many rows does no harm but to its range's time.
    """
    kind = df.schema[key].dataType.simpleString()
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    @tidied
    def walk(batches):
        held = None  # (range, key, text, sketch) of the last row, which waits for its next
        for whole in batches:
            for a, b in slices(whole.column(3)):
                batch = whole.slice(a, b - a)
                texts = batch.column(3).to_pylist()
                sketches = sketch(batch.column(3))
                keys, mine, edited, own, following = [], [], [], [], []
                for i, (r, o, k, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts)):
                    if held is not None and held[0] == r:
                        part = len(held[2]) // 3
                        keys.append(held[1])
                        mine.append(held[2])
                        edited.append(held[2][: len(held[2]) - part] + t[:part])
                        own.append(held[3])
                        following.append(sketches[i])
                    held = (r, k, t, sketches[i]) if o else None
                if not keys:
                    continue
                x, y = np.stack(own), np.stack(following)
                z = sketch(pa.array(edited, pa.string()))
                columns = [pa.array(keys, batch.schema.field(2).type), pa.array([len(t) for t in mine], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(pack(x)), pa.array(pack(z)), pa.array(likeness(x, z)), pa.array(likeness(x, y))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return _in_order(df, text, key).mapInArrow(walk, f"`{key}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
