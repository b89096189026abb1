"""Search of texts: an inverted index in blocks, and the best documents for each question by BM25, exactly."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workspace import written
from .relational import narrowed

#: How fast a term's weight saturates, and how much a text's length counts.
K1, B = 1.2, 0.75
#: Scores are counted in whole millionths, so sums don't hang on their order.
UNIT = 1_000_000
#: Documents of a bucket at most, and their words, on average: what a task holds at once.
BLOCK, WORDS = 20_000, 2_000_000
#: Words of questions that a task meets with one bucket, on average.
ASKED = 200_000


def words(text: Column) -> Column:
    """Words between white space, A-Z in lower case."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda w: w != "")


class TextIndex:
    """``blocks``: ``term, bucket, n, docs, tfs, lens`` (three lists as long as each other: documents in order, how often each has the
    term, how many words it has), and ``terms``: ``term, df``; how many documents there are, their mean length, and the buckets."""

    def __init__(self, blocks: DataFrame, terms: DataFrame, documents: int, mean: float, buckets: int):
        self.blocks, self.terms, self.documents, self.mean, self.buckets = blocks, terms, documents, mean, buckets


def build_index(docs: DataFrame, key: str, text: str, asked: DataFrame | None = None) -> TextIndex:
    """Index all whole texts. Null texts and those without words count as documents but are in no postings; rows that share a key are
    one document. Null keys are left out, for they name none. With ``asked`` (a column of texts) only words of those texts are
    indexed: what a known set of questions needs, at a fraction of the postings; lengths count all words.

    Documents are dealt to buckets by a hash, and a block is a term's postings in a bucket: no row and no task holds all postings
    of a term. Texts are shuffled once, by bucket; grouping by document and by term then needs no other exchange.
    """
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), words(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    sizes = rows.groupBy("doc").agg(F.sum(F.size("w")).cast("bigint").alias("len"))
    n, total = sizes.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
    buckets = max(n // BLOCK, total // WORDS) + 1
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc"), F.lit(buckets))).repartition("bucket")
    rows = rows.withColumn("len", F.sum(F.size("w")).over(Window.partitionBy("bucket", "doc")))
    said = rows.select("bucket", "doc", "len", F.explode("w").alias("term"))
    if asked is not None:
        said = narrowed(said, "term", asked.select(F.explode(words(F.col(asked.columns[0]))).alias("term")).distinct())
    counts = said.groupBy("bucket", "doc", "term").agg(F.count("*").alias("tf"), F.max("len").alias("len"))
    posts = counts.groupBy("bucket", "term").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("doc", "tf", "len"))).alias("p"))
    # a field of an array of structs is the list of that field's values
    blocks = written(posts.select("term", "bucket", "n", F.col("p.doc").alias("docs"), F.col("p.tf").alias("tfs"), F.col("p.len").alias("lens")), "blocks")
    terms = written(blocks.groupBy("term").agg(F.sum("n").alias("df")), "terms")
    return TextIndex(blocks, terms, n, total / n if n else 0.0, buckets)


def _matcher(mean: float, k: int):
    """The best documents of one bucket for each question of one part, as a function of two Arrow tables."""

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = left["docs"].combine_chunks()
        names = pc.unique(lists.flatten())
        names = names.take(pc.sort_indices(names))
        place = pc.index_in(lists.flatten(), names).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(left["n"].to_numpy())])
        tf, size = (left[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in ("tfs", "lens"))
        shape = tf * (K1 + 1), tf + K1 * (1 - B + B * size / (mean or 1.0))
        block = {t: i for i, t in enumerate(left["term"].to_pylist())}
        weights: dict[int, tuple[np.ndarray, int]] = {}
        score, seen = np.zeros(len(names), np.int64), np.zeros(len(names), bool)
        asked: dict = {}
        for q, term, idf, bound in zip(*(right[c].to_pylist() for c in ("q", "term", "idf", "bound"))):
            if (i := block.get(term)) is not None:
                asked.setdefault((q, bound), []).append((i, idf))
        out: list[list] = [[], [], []]
        for (q, bound), terms in asked.items():
            for i, idf in terms:
                if i not in weights:
                    a, b = ends[i], ends[i + 1]
                    w = np.floor(idf * shape[0][a:b] / shape[1][a:b] * UNIT + 0.5).astype(np.int64)
                    weights[i] = w, int(w.max())
            if sum(weights[i][1] for i, _ in terms) < bound:
                continue  # not even a document that is best in each of these blocks could be among the best
            for i, _ in terms:
                at = place[ends[i] : ends[i + 1]]
                score[at] += weights[i][0]
                seen[at] = True
            found = np.flatnonzero(seen & (score >= bound))
            found = found[np.lexsort((found, -score[found]))[:k]]
            out[0] += [q] * len(found)
            out[1].append(found)
            out[2].append(score[found])
            score[:], seen[:] = 0, False
        docs, scores = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out[1:])
        return pa.table({"q": pa.array(out[0], right.schema.field("q").type), "doc": names.take(pa.array(docs)), "score": pa.array(scores)})

    return match


def _nearest(index: TextIndex, asked: DataFrame, buckets: tuple[int, int], parts: int, k: int) -> DataFrame:
    """``q, doc, score``: the best documents of each of these buckets, with scores of ``bound`` or more. Questions go by parts of
    bounded size, so a task holds one bucket and one part; blocks are read with each part that there is."""
    first, last = buckets
    blocks = index.blocks.where((F.col("bucket") >= first) & (F.col("bucket") < last))
    blocks = narrowed(blocks, "term", asked.select("term").distinct()).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    sent = asked.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int")).withColumn("bucket", F.explode(F.sequence(F.lit(first).cast("bigint"), F.lit(last - 1).cast("bigint"))))
    q, doc = asked.schema["q"].dataType, index.blocks.schema["docs"].dataType.elementType
    pairs = blocks.groupBy("bucket", "part").cogroup(sent.groupBy("bucket", "part"))
    return pairs.applyInArrow(_matcher(index.mean, k), f"q {q.simpleString()}, doc {doc.simpleString()}, score bigint")


def best(index: TextIndex, questions: DataFrame, key: str, text: str, k: int = 10) -> DataFrame:
    """``key, doc, score, place``: the ``k`` documents with the greatest scores for each question (ties by document), all exact.

    Score is BM25 in millionths over a question's distinct words. A bucket meets the questions in one task, which adds up the
    weights of its postings by document, so no weight is shuffled but only each bucket's best documents. 1. As many buckets as
    the root of their number are looked through whole; the k-th best score there is a bound that the k-th best of all doesn't
    fall below. 2. In all others a question is passed over where the greatest weights of its blocks don't reach the bound
    together, and only documents that reach it are kept. Of N buckets a question keeps some 2 k root(N) documents.

    Questions without words, and those of which no document has a word, have no rows; questions with one key are one, null keys
    are left out.
    """
    asked = questions.where(F.col(key).isNotNull()).select(F.col(key).alias("q"), F.explode(words(F.coalesce(F.col(text), F.lit("")))).alias("term")).distinct()
    idf = F.log(1 + (F.lit(float(index.documents)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = written(asked.join(index.terms, "term").select("q", "term", idf.alias("idf")), "asked")
    parts = asked.count() // ASKED + 1
    some = math.isqrt(index.buckets - 1) + 1
    rank = Window.partitionBy("q").orderBy(F.desc("score"), "doc")
    found = written(_nearest(index, asked.withColumn("bound", F.lit(0).cast("bigint")), (0, some), parts, k), "found")
    if some < index.buckets:
        bounds = found.withColumn("r", F.row_number().over(rank)).where(F.col("r") == k).select("q", F.col("score").alias("bound"))
        bound = asked.join(bounds, "q", "left").withColumn("bound", F.coalesce("bound", F.lit(0).cast("bigint")))
        found = found.unionByName(written(_nearest(index, bound, (some, index.buckets), parts, k), "others"))
    placed = found.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= k)
    return placed.select(F.col("q").alias(key), "doc", "score", "place")
