"""Ids above 2^53 beside nulls keep every digit, in every operator and pipeline stage."""

import importlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from latticeflow.llm import arc_convert, bitplane, bwt_dedup, chunk_bpe, decontam, line_crf, pivot_index, recurrent_lm, shingle_join, toxicity

WIDE = [(1 << 53) + 1, (1 << 53) + 3, None]
TEXTS = ["the first of three texts about rivers and mills", "another text of its own on bread and salt", "a third one without any id at all"]
ITEM = "a long benchmark question about the colour of rivers in winter and what they carry"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t)) for i, t in zip(WIDE, TEXTS, strict=True)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int").coalesce(1)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(WIDE[0], 1, 0), (WIDE[1], 0, 1)], "doc_id bigint, quality int, toxic int")


def ids(df, column="doc_id"):
    return sorted((r[0] for r in df.select(column).collect()), key=str)


def test_operators(spark, docs, labels):
    want = sorted(WIDE, key=str)
    bpe = public_tokenizers.path("byte_bpe_50k.json")
    assert ids(recurrent_lm.score(docs)) == want
    assert ids(chunk_bpe.digests(docs, bpe)) == want
    assert ids(bwt_dedup.digests(docs)) == want
    assert ids(shingle_join.near_groups(docs)) == want
    assert ids(shingle_join.near_groups(docs), "component_id") == want
    assert ids(bitplane.plane_digests(docs, public_tokenizers.path("word_bpe_49k.json"))) == want
    assert ids(toxicity.classify(docs, labels)) == want
    assert ids(line_crf.classify(docs, labels)) == want


def test_vectors_and_pages(spark):
    vectors = spark.createDataFrame([(i, [float(k), 1.0, 0.5]) for k, i in enumerate(WIDE)], "vec_id bigint, embedding array<float>").coalesce(1)
    assert ids(pivot_index.near_vectors(vectors), "vec_id") == sorted(WIDE, key=str)
    pages = spark.createDataFrame([(i, f"http://x/{k}", "<p>same</p>") for k, i in enumerate(WIDE)], "page_id bigint, url string, html string").coalesce(1)
    got = arc_convert.round_trip(pages).select("page_id", "refers_to").collect()
    assert sorted((r[0] for r in got), key=str) == sorted(WIDE, key=str)
    assert {r[0]: r[1] for r in got}[WIDE[0]] == WIDE[1]


def test_matches(spark, docs):
    with_item = docs.withColumn("text", F.concat("text", F.lit(" " + ITEM)))
    items = spark.createDataFrame([((1 << 53) + 5, ITEM)], "item_id bigint, text string")
    found = decontam.matches(with_item, items)
    assert ids(found) == sorted(WIDE, key=str)
    assert {r[0] for r in found.select("item_id").collect()} == {(1 << 53) + 5}


def test_stages(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert ids(stage(spark, docs, str(tmp_path))) == sorted(WIDE, key=str), name
    sure = labels.withColumn("quality", F.lit(1))
    sure.write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    assert ids(corpus_pipeline.quality(spark, docs, str(tmp_path))) == sorted(WIDE, key=str)


def test_labels_without_documents_take_no_room(spark):
    from latticeflow.llm import labelled

    docs = spark.createDataFrame([(k, f"text {k}") for k in range(20)], "doc_id bigint, text string")
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    assert len(labelled.sample(docs, labels, "quality", 4, 2, limit=10)) == 10


def test_every_query_is_there():
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert "pipeline" in names and sum(n.startswith("op") for n in names) == 10
