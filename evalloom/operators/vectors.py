"""Search of vectors: cells around centres, a few cells looked into for each query, and exact similarities there."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import written

#: Rows that centres are learned from at most, queries that the number of probes is measured with, and centres at most.
SAMPLE, TRIALS, CELLS = 20_000, 200, 1024
#: Share of the nearest rows that the trials have to find.
RECALL = 0.97
#: Vectors, and queries, that are multiplied at a time.
BLOCK, QUERIES = 4096, 256
_ROUNDS = 8
#: Upper bits of an id's hash by which rows are counted before a sample of them is taken.
_HASH = 14


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; a row of zeros stays."""
    x = x.astype(np.float64)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(lists.flatten(), dtype=np.float64).reshape(-1, dim)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, v`` of rows with a key and a vector of finite numbers only."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(key).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0) & ~bad)


class Cells:
    """Centres of unit length, and how many of them a query looks into."""

    def __init__(self, centres: np.ndarray, probes: int):
        self.centres, self.probes = centres, probes


def sampled(rows: DataFrame, sample: int) -> DataFrame:
    """``v`` of the ``sample`` rows with the least hashes of their ids, in that order.

    Sorting for the first rows sends as many from each partition to the driver. So rows are counted by their hashes' upper bits,
    and only those that can be in the sample are sorted: little more than it has, whatever the number of partitions. Where an
    id that many rows share makes them many, the first ones are chosen by a task and not by the driver.
    """
    order = [F.xxhash64("id"), F.col("id")]
    upper = F.shiftright(order[0], 64 - _HASH)
    last, held = None, 0
    for last, n in sorted(rows.groupBy(upper.alias("upper")).count().collect()):
        held += n
        if held >= sample:
            break
    first = rows.where(upper <= F.lit(last)).orderBy(*order).limit(sample)
    if held > 2 * sample:
        first = written(first, "sample").orderBy(*order)
    return first.select("v")


def fit(rows: DataFrame, n: int, k: int = 10, sample: int = SAMPLE) -> Cells:
    """Centres by spherical k-means, as many as the root of ``n`` (``CELLS`` at most), from ``sample`` rows at most: those with the least
    hashes of their ids. How many cells to look into is measured there too: the least number that finds ``RECALL`` of the ``k``
    nearest of ``TRIALS`` rows. What lies near in the sample is farther than what lies near in the whole, so that is the safe side.
    """
    held = sampled(rows, sample).toPandas()["v"]
    x = _unit(np.array(held.tolist(), dtype=np.float64))
    cells = max(1, min(CELLS, int(n**0.5), len(x)))
    centres = x[:: max(1, len(x) // cells)][:cells].copy()
    for _ in range(_ROUNDS):
        at = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        some = np.bincount(at, minlength=len(centres)) > 0
        centres[some] = _unit(sums[some])
    at = np.argmax(x @ centres.T, axis=1)
    trial = x[: min(TRIALS, len(x))]
    near = trial @ x.T
    near[np.arange(len(trial)), np.arange(len(trial))] = -9
    true = np.argsort(-near, axis=1)[:, : min(k, len(x) - 1)]
    order = np.argsort(np.argsort(-(trial @ centres.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(order, at[true], axis=1).ravel()) + 1
    probes = int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))]) if len(needed) else len(centres)
    return Cells(centres, probes)


def _in_cells(rows: DataFrame, cells: Cells, probes: int) -> DataFrame:
    """``id, v, cell`` with vectors of unit length, once for each of the nearest ``probes`` cells."""
    centres, dim = cells.centres, cells.centres.shape[1]

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                x = _unit(_matrix(part.column(1), dim))
                near = np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :probes]
                ids = np.repeat(part.column(0).to_numpy(), near.shape[1])
                flat = np.repeat(x, near.shape[1], axis=0).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * dim), pa.array(flat)), pa.array(near.ravel().astype(np.int32))], ["id", "v", "cell"])

    return rows.where(F.size("v") == dim).mapInArrow(run, "id bigint, v array<double>, cell int")


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows of a cell in lists of about ``size``, dealt by a hash of the id: a cell that a third of all rows lie in makes many."""
    rows = written(rows, name)
    counts = rows.groupBy("cell").agg(F.count("*").alias("n"))
    dealt = rows.join(F.broadcast(counts), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.floor(F.col("n") / size) + 1))
    return dealt.groupBy("cell", "block").agg(F.collect_list("id").alias("ids"), F.collect_list("v").alias("vs"))


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10) -> DataFrame:
    """``query, key, similarity, place``: for each query its ``k`` most similar rows (cosine; ties by key) among those of the cells looked
    into, without the row itself.

    Every row is indexed: it lies in the cell of its nearest centre. Queries go to their nearest cells; in a cell, lists of
    queries meet lists of rows, and each pair of lists is one product of matrices from which only the best ``k`` a query come
    back. Similarities are exact. Rows without a key or with vectors that are null, empty, of other length than most or not
    finite are no neighbours and have none; rows of zeros have similarity 0 to all.
    """
    rows = written(usable(vectors, key, vector), "vectors")
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], f"query bigint, {key} bigint, similarity double, place int")
    dim, n = sizes[0]
    cells = fit(rows.where(F.size("v") == dim), n, k)
    held = _blocks(_in_cells(rows, cells, 1), BLOCK, "cells")
    asked = _blocks(_in_cells(usable(queries, key, vector), cells, cells.probes), QUERIES, "probes")
    asked = asked.select("cell", F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, vs, q_ids, q_vs = (batch.column(c)[i].values for c in range(4))
                x, q = _matrix(vs, dim), _matrix(q_vs, dim)
                ids, q_ids = ids.to_numpy(), q_ids.to_numpy()
                likeness = np.round(q @ x.T, 9)
                likeness[q_ids[:, None] == ids[None, :]] = -9
                # by likeness, then id
                order = np.lexsort((np.broadcast_to(ids, likeness.shape), -likeness), axis=1)[:, :k]
                found = np.take_along_axis(likeness, order, axis=1)
                ok = found > -9
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, order.shape[1])[ok.ravel()]), pa.array(ids[order][ok]), pa.array(found[ok])], ["query", "id", "similarity"])

    # a query's vector lies in its file once for all its cells, so the file looks small enough to broadcast; its lists aren't
    pairs = held.join(asked.hint("merge"), "cell").select("ids", "vs", "q_ids", "q_vs").mapInArrow(run, "query bigint, id bigint, similarity double")
    once = pairs.groupBy("query", "id").agg(F.max("similarity").alias("similarity"))
    best = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return once.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("query", F.col("id").alias(key), "similarity", "place")
