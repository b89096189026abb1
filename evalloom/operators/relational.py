"""Joins, sets, orders and limits in the forms that this library needs (F-, J-, L- and X-rows, A24-A29, W1, W2)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a product may have on its small side.
RUNS = 1000
#: Needles that a search takes at most.
NEEDLES = 1000


def last_wins(df: DataFrame, key: str, pos: str) -> DataFrame:
    """Of rows with one key the values of the last, at the place of the first. A null among the last row's values stays."""
    w = Window.partitionBy(key)
    ranked = df.withColumns({"_rank": F.row_number().over(w.orderBy(F.desc(pos))), "_first": F.min(pos).over(w)})
    return ranked.where("_rank = 1").withColumn(pos, F.col("_first")).drop("_rank", "_first")


def inner(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """An equi-join; order is that of a column (``pos``), asked for at the end and not here."""
    return left.join(right, key, "inner")


def left_outer(left: DataFrame, right: DataFrame, keys: list[str] | str) -> DataFrame:
    """Rows without a partner keep nulls."""
    return left.join(right, keys, "left")


def missing(left: DataFrame, right: DataFrame, keys: list[str] | str) -> DataFrame:
    """Rows of ``left`` whose key ``right`` lacks."""
    return left.join(right, keys, "left_anti")


def present(left: DataFrame, right: DataFrame, keys: list[str] | str) -> DataFrame:
    """Rows of ``left`` whose key ``right`` has."""
    return left.join(right, keys, "left_semi")


#: Keys that are broadcast as they are; more go into a table of bits first.
BROADCAST_KEYS = 100_000
#: Bits of that table, and of one of its pieces (4 KB each): 8 MB, however many keys there are.
KEY_BITS, PIECE_BITS = 26, 15


def narrowed(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is among ``keys`` (one column, distinct), without a shuffle of the others.

    Few keys are broadcast. Of more, a table of bits is: rows whose bit isn't set surely have no key there, and only what is left
    goes through the shuffled join. Rows without a key match nothing.
    """
    keys = keys.select(F.col(keys.columns[0]).alias(key))
    if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        return df.join(F.broadcast(keys), key, "left_semi")
    slot = lambda: F.xxhash64(key).bitwiseAND((1 << KEY_BITS) - 1)
    piece, place = F.shiftright(slot(), PIECE_BITS), slot().bitwiseAND((1 << PIECE_BITS) - 1)
    bits = keys.where(F.col(key).isNotNull()).groupBy(piece.alias("_piece")).agg(F.bitmap_construct_agg(place).alias("_bits"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, place.bitwiseAND(7).cast("int")).bitwiseAND(1) == 1
    maybe = df.withColumn("_piece", piece).join(F.broadcast(bits), "_piece").where(bit).select(*df.columns)
    return maybe.join(keys, key, "left_semi")


def flagged(left: DataFrame, right: DataFrame, key: str, flag: str) -> DataFrame:
    """All rows of ``left`` and whether ``right`` has their key."""
    keys = right.select(key).distinct().withColumn("_hit", F.lit(True))
    return left.join(keys, key, "left").withColumn(flag, F.col("_hit").isNotNull()).drop("_hit")


def for_each(left: DataFrame, few: DataFrame) -> DataFrame:
    """Each row with each of a few others, such as the runs of a comparison. ``few`` has a handful of rows, given by hand."""
    names = [f"_few.{c}" for c in few.columns]
    rows = [tuple(r) for r in few.take(RUNS + 1)]
    if len(rows) > RUNS:
        raise ValueError(f"more than {RUNS} rows to combine with each row")
    kind = few.schema
    literal = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, kind.fields)]) for r in rows])
    return left.withColumn("_few", F.explode(literal)).select(*left.columns, *names)


def contains_join(left: DataFrame, text: str, needles: DataFrame) -> DataFrame:
    """J15, F-, C22: rows with each needle that their text contains. Needles are a short table given by hand: they become literals
    of one pass over the rows, ``NEEDLES`` of them at most."""
    rows = [tuple(r) for r in needles.take(NEEDLES + 1)]
    if len(rows) > NEEDLES:
        raise ValueError(f"more than {NEEDLES} needles")
    kind = needles.schema
    literals = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, kind.fields)]) for r in rows]
    known = F.array(*literals) if literals else F.array().cast(T.ArrayType(kind))
    return left.withColumn("_needle", F.explode(F.filter(known, lambda n: F.contains(F.col(text), n["needle"])))).select(*left.columns, "_needle.*")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all; columns that some lack are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_union(frames: list[DataFrame]) -> DataFrame:
    """X1, A24."""
    return union_all(frames).distinct()


def sorted_distinct(df: DataFrame, *columns: str) -> DataFrame:
    """L3."""
    return df.select(*columns).distinct().orderBy(*columns)


def first_rows(df: DataFrame, n: int | None, order: str = "pos") -> DataFrame:
    """The first ``n`` by ``order``; 0 and None ask for all. Negative numbers are refused."""
    if n is not None and n < 0:
        raise ValueError("the number of rows can't be negative")
    return df.orderBy(order).limit(n) if n else df


def where_given(df: DataFrame, **values) -> DataFrame:
    """rows equal to each given value; None and the empty text ask for nothing."""
    for column, v in values.items():
        if v is not None and v != "":
            df = df.where(F.col(column) == v)
    return df


def by_frequency(df: DataFrame, key: str, first: Column) -> DataFrame:
    """``key, n`` from frequent to rare, ties by what came first."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min(first).alias("first_pos")).orderBy(F.desc("n"), "first_pos", key)


def keep_all(flag: Column) -> Column:
    """Whether all rows of a group have it; nulls don't count, a group without any has it."""
    return F.coalesce(F.bool_and(flag), F.lit(True))


def keep_any(flag: Column) -> Column:
    """A27."""
    return F.coalesce(F.bool_or(flag), F.lit(False))
