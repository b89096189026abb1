"""The pipeline and the registered queries on a small folder of tables."""

import hashlib
import random

import pytest

import corpus_pipeline
from evalloom.llm import queries

random.seed(9)
WORDS = [f"v{i}" for i in range(200)]


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


ITEM = "Then Mary bought 10 apples and gave Tom 10 pears for 9 miles of road work today."


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    texts = [prose(120) for _ in range(300)]
    for i in range(0, 300, 5):
        w = texts[i].split(" ")
        w[7] = "grumpole"
        texts[i] = " ".join(w)
    texts += [texts[1], texts[2] + " more", f"{prose(20)} {ITEM} {prose(20)}", f"{prose(30)} password=abcdef123 {prose(30)}", None, "", ""]
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, ITEM)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, f"http://a.net/{i}", f"<p>{i % 3}</p>") for i in range(30)], "page_id bigint, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(i // 4, i % 4, "user" if i % 2 == 0 else "assistant", f"turn {i}.") for i in range(80)], "conv_id bigint, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder


def test_stages(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{sf_dir}/stage-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {r["doc_id"] for r in docs.collect()}
        if name != "bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "secrets":
            masked = {r["doc_id"]: r for r in docs.collect()}
    toxic = {i for i in range(300) if i % 5 == 0}
    assert kept["toxicity"] == set(whole) - toxic
    assert kept["near_dedup"] == kept["toxicity"] - {300, 301, 305, 306}
    assert kept["decontamination"] == kept["near_dedup"] - {302} == kept["secrets"] == kept["bpe"]
    assert "[SECRET]" in masked[303]["text"] and masked[303]["n_chars"] == len(masked[303]["text"]) and masked[1]["text"] == whole[1] and masked[304]["text"] is None
    assert docs.where("NOT round_trip").count() == 0
    final = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert final == {i: hashlib.sha256((r["text"] or "").encode()).hexdigest() for i, r in masked.items()}


def test_near_copies_with_shared_ids(spark):
    a, b, c, d = (prose(80) for _ in range(4))
    rows = [(3, a), (5, a + " more"), (5, b), (5, c), (5, c), (7, d), (7, d + " more"), (None, d)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    seven = [t for i, t in kept if i == 7]
    assert len(seven) == 1 and seven[0] in (d, d + " more")
    assert sorted((str(i), t) for i, t in kept if i != 7) == sorted([("3", a), ("5", b), ("5", c), ("None", d)])


def test_empty_pipeline(spark, sf_dir, tmp_path):
    for t in ("labels", "benchmark", "documents"):
        queries.table(spark, sf_dir, t).where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_run_over_whole_tables(spark, sf_dir, name):
    n = queries.QUERIES[name](spark, sf_dir).count()
    assert n == {"op1_decontamination": 1, "op4_warc": 30, "op6_url_filter": 30, "op12_conversations": 20}.get(name, 307)
