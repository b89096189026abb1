"""The corpus in five stages; each stage takes the documents that the one before kept, and all but the last return their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import bpe, decontaminate, secrets, simhash, toxicity
from evalloom.llm.common import discard, materialize, with_partner
from evalloom.llm.queries import table, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents with a toxicity score of this or more are rejected.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the lexicon model, learned from the labels, scores as toxic."""
    model = toxicity.learn(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs.select(*COLUMNS), model, column="_score").where(F.col("_score") < TOXIC).drop("_score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal or similar texts (by SimHash fingerprints, confirmed, and an index of shingles for what these
    don't show): the one with the least id. Rows without an id stay; rows that share an id are told apart by their texts."""
    with_id = docs.where("doc_id IS NOT NULL")
    groups = simhash.similar_groups(with_id, words=5, similarity=0.8)
    rows = materialize(groups.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("n")), "rows")
    kept = rows.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash", "n")).alias("r"), F.sum("n").alias("members"))
    kept = materialize(kept.select("component", F.col("r.doc_id").alias("_id"), F.col("r.text_hash").alias("_hash"), "r.n", "members"), "kept")
    # a component bears the hash of one of its texts: these are all texts that aren't alone, and only they are shuffled
    grouped = rows.where("component <> text_hash").select("text_hash").unionByName(kept.where("members > 1").select(F.col("component").alias("text_hash")))
    named = with_partner(with_id.select(*COLUMNS).withColumn("_text_hash", simhash.text_hash("text")), "_text_hash", grouped)
    same = (F.col("doc_id") == F.col("_id")) & (F.col("_text_hash") == F.col("_hash"))
    single = named.where("_met").join(kept.where("n = 1"), same, "left_semi")
    # only rows that are there several times are sorted out by a second shuffle
    repeated = named.where("_met").join(kept.where("n > 1"), same, "left_semi").dropDuplicates(["doc_id", "_text_hash"])
    found = named.where("NOT _met").unionByName(single).unionByName(repeated)
    return found.select(*COLUMNS).unionByName(docs.select(*COLUMNS).where("doc_id IS NULL"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item, word for word or with other numbers, names and units."""
    return decontaminate.decontaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts; ``n_chars`` is that of the new text."""
    masked = secrets.redact(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each whole text, checked by decoding them: ``round_trip`` says that this gives the text again."""
    found = bpe.bpe_round_trip(docs.select("doc_id", "text"), vocabulary(), with_text=True)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", (F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256) == F.col("decoded_sha256")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", mask_secrets),
    ("bpe", encode),
]

#: A lexicon model, similarity groups and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the documents are a table in the shared folder, which goes when the next one
    is written."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            kept = materialize(kept, f"stage-{name}")
            discard(docs)
        docs = kept
    return docs
