"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hot_lookup, materialize


def _star(pairs: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """Each (u, v) with ``m``, the least of u and all its v, and the table that this reads. A node that many edges share loads no task."""
    least = materialize(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n_rows")), "stars")
    return hot_lookup(pairs, least, "u", rows, "inner").withColumn("m", F.least("u", "m")), least


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: every node of an edge and the least node that it reaches.

    Loops, repeated edges and edges with a null end do no harm; no edges give no rows. Each round is a few shuffles of the
    remaining edges, kept as a table in the shared folder until the next one is written; the number of rounds grows with the
    logarithm of the longest path.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    # greatest() skips nulls, so an edge with one null end is a loop by now
    e = materialize(e.distinct(), "edges")
    seen = None
    while True:
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state["n"]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        seen, n = state, state["n"]
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        stars, least = _star(both, 2 * n)
        large = materialize(stars.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        small, lesser = _star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), n)
        fresh = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        old, e = e, materialize(fresh, "edges")
        discard(old, least, large, lesser)
