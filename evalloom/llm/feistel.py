"""A reproducible shuffle into shards: a Feistel permutation of global row numbers, walked until it stays inside the table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

SHARDS, SEED, ROUNDS = 40, "17", 6
#: Bytes that a row takes besides its text.
ROW_BYTES = 16


def side_of(rows: int) -> int:
    """Side of the square of numbers that the permutation works on: the least one with room for all rows."""
    return math.isqrt(rows - 1) + 1 if rows > 0 else 1


def _round(half: Column, i: Column, side: int, seed: str) -> Column:
    """52 bits of a hash of half a number, the round and the seed."""
    told = F.concat_ws(":", F.lit(seed), i.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(told, 256), 1, 13), 16, 10).cast("bigint") % side


def _steps(x: Column, side: int, seed: str, back: bool) -> Column:
    """All rounds on one number below ``side`` squared; one to one, and with ``back`` the other way."""
    half = lambda left, right: F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    start = half(F.call_function("div", x, F.lit(side)), x % side)
    if back:
        rounds, one = F.sequence(F.lit(ROUNDS - 1), F.lit(0)), lambda s, i: half(F.pmod(s["r"] - _round(s["l"], i, side, seed), F.lit(side)), s["l"])
    else:
        rounds, one = F.sequence(F.lit(0), F.lit(ROUNDS - 1)), lambda s, i: half(s["r"], F.pmod(s["l"] + _round(s["r"], i, side, seed), F.lit(side)))
    return F.aggregate(rounds, start, one, lambda s: s["l"] * side + s["r"])


def _walked(x: Column, rows: int, seed: str, back: bool) -> Column:
    """The permutation of 0 to ``rows - 1``: steps are taken until the number lies below ``rows`` again.

    Outside lie at most twice the root of ``rows`` numbers, and a walk meets none of them twice; so the bounded walk always ends
    inside. Only rows that the first step leads outside walk at all, one in half the root of ``rows``.
    """
    side = side_of(rows)
    outside = side * side - rows
    first = _steps(x.cast("bigint"), side, seed, back)
    if not outside:
        return first
    on = lambda p: F.aggregate(F.sequence(F.lit(1), F.lit(outside)), p, lambda q, _: F.when(q < rows, q).otherwise(_steps(q, side, seed, back)))
    return F.transform(F.array(first), lambda p: F.when(p < rows, p).otherwise(on(p)))[0]


def place(number: Column, rows: int, shards: int = SHARDS, seed: str = SEED) -> tuple[Column, Column]:
    """Shard and slot of the row with a global number: computed from it, the number of rows, that of shards and the seed alone."""
    to = _walked(number, rows, seed, False)
    return (to % shards).cast("int"), F.call_function("div", to, F.lit(shards))


def number_at(shard: Column, slot: Column, rows: int, shards: int = SHARDS, seed: str = SEED) -> Column:
    """The global number of the row that lies in a slot; null beyond the shard's last one."""
    to = slot.cast("bigint") * shards + shard
    inside = (shard >= 0) & (shard < shards) & (slot >= 0) & (to < rows)
    return F.when(inside, _walked(F.when(inside, to).otherwise(0), rows, seed, True)) if rows else F.lit(None).cast("bigint")


def numbered(df: DataFrame, by: list[str], column: str = "row_number") -> tuple[DataFrame, int]:
    """``df`` with gapless numbers from 0 in the order of ``by`` (nulls first), and how many rows there are.

    Rows are dealt into ranges of ``by`` and, where that is equal, of their place in the input, so a value that a third of all
    rows have is spread; each range counts its rows, and the driver adds up one number a range. Numbers don't hang on files or
    partitions, but for rows that are equal in ``by``. Both tables are written: a task that is run again finds the same rows.
    """
    given = materialize(df.withColumn("_place", F.monotonically_increasing_id()), "given")
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    keys = [F.asc_nulls_first(c) for c in [*by, "_place"]]
    ranges = given.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_place").withColumns({"_part": F.spark_partition_id(), "_at": at})
    ranges = materialize(ranges, "ranges")
    discard(given)
    total, starts = 0, []
    for part, n in sorted(map(tuple, ranges.groupBy("_part").count().collect())):
        starts.append((part, total))
        total += n
    first = df.sparkSession.createDataFrame(starts, "_part int, _start bigint")
    return ranges.join(F.broadcast(first), "_part").withColumn(column, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start"), total


def shuffled(df: DataFrame, shards: int = SHARDS, seed: str = SEED, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard`` and the columns ``keep`` of each row.

    The law is ``rows``: shards differ by one row at most, slots are 0, 1, 2, ... in each. A row's global number is its rank by
    key (nulls first), checksum and size, then by a hash of what is kept; equal rows are interchangeable, so the result is the
    same however the table is stored. Copies of one text are rows like any others. Null texts have no bytes and checksum 0;
    repeated keys and rows are all dealt; an empty table gives none. Columns to keep that have the name of a result give way.
    """
    made = {"size", "text_crc32", "law", "shard", "slot", "grown_shard", key}
    kept = [c for c in keep or [] if c not in made]
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    held = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.lit(None).cast("string")
    rows = df.select(F.col(key), (F.octet_length(raw) + ROW_BYTES).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"), held.alias("_row"))
    rows = rows.withColumn("_kept", F.xxhash64(F.to_json("_row")) if kept else F.lit(0))
    ranked, n = numbered(rows, [key, "text_crc32", "size", "_kept"], "_number")
    shard, slot = place(F.col("_number"), n, shards, seed)
    return ranked.select(key, "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *["_row.*"] * bool(kept))


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, seed: str = SEED, key: str = "doc_id", text: str = "text") -> None:
    """All columns of ``df`` as Parquet, a folder a shard, in the order of slots over the files of a shard.

    A shard of any size is cut into ranges of slots, so no task holds a whole one.
    """
    out = shuffled(df, shards, seed, key, text, df.columns)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
