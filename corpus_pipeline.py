"""The corpus pipeline: line quality, near duplicates, repeated strings, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the
session's shared folder and reads it back as the next stage's docs.  All stages but the last return the
columns that docs came with, whatever their names and types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticeflow.llm import bwt_dedup, chunk_bpe, decontam, line_crf, shingle_join
from latticeflow.llm.common import RID, discard, free_name, least_row, materialise, row_key

VOCABULARY = "byte_bpe_50k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier takes for good (score of at least its threshold).

    A null text is judged as the empty one; rows that repeat one another are judged alike, and all stay or go.
    """
    model = line_crf.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(line_crf.quality_score(model) >= line_crf.THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component, that with the smallest doc_id (five words to a shingle, similarity 0.8).

    A null doc_id comes after all others; texts that share the smallest doc_id go by __lf_rid, and rows that
    repeat a doc_id and text by all their columns (maps by their JSON).  Texts without words are no copies of one another and stay.
    """
    groups = shingle_join.near_groups(docs, words=5, per_cent=80)
    alone = groups.where("comp is null").select(RID, F.lit(False).alias("repeated")).distinct()
    each = groups.where("comp is not null").groupBy("comp", RID).agg(F.min("doc_id").alias("doc_id"), (F.count("*") > 1).alias("repeated"))
    first = each.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", RID, "repeated")).alias("e"))
    keep = materialise(first.select(f"e.{RID}", "e.repeated").unionByName(alone), "kept")
    at = free_name(docs, RID)
    rows, keep = docs.withColumn(at, row_key()), keep.withColumnRenamed(RID, at)
    once = rows.join(keep.where("not repeated"), at, "left_semi").drop(at)
    more = rows.join(keep.where("repeated"), at, "left_semi").groupBy(at).agg(least_row(rows, at).alias("e"))
    return once.unionByName(more.select("e.*"))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the strings of 100 bytes that stand earlier too; a column n_chars counts what is left.

    Bytes of a character that was cut apart are left out with it.  Documents of which nothing is left stay
    as empty texts.
    """
    out = bwt_dedup.dedup_rows(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands, even with edits.

    Null and empty texts hold no item and stay, as do all rows where the benchmark is empty; of rows that repeat a
    doc_id and text all stay or go.
    """
    at = free_name(docs, RID)
    keyed = docs.withColumn(at, row_key())
    found = decontam.matches(keyed.select(F.col(at).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return keyed.join(found.select(F.col("doc_id").alias(at)).distinct(), at, "left_anti").drop(at)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the token ids of every document."""
    import public_tokenizers

    return chunk_bpe.encode_documents(docs.select("doc_id", "text"), public_tokenizers.path(VOCABULARY)).drop("text")


STAGES = [("line quality", quality), ("near duplicates", near_duplicates), ("repeated strings", repeated_strings), ("benchmark leaks", leaks), ("token ids", token_ids)]

#: Stages learn from data, reach components and remove bytes: tested against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline")
        discard(*last)
        last = [docs]
    return docs
