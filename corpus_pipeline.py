"""A training-data pipeline over the documents table: five stages, each written as Parquet and read again by the next.

1. language_id: texts whose language cannot be told (no letters, or no language above half) go; a missing lang is filled in. Where no row has a
   language to learn from, only texts without letters go.
2. near_dedup: of each group of near-duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays; of repeated rows one stays.
3. decontaminate: documents that hold a benchmark item, up to the allowed edits, go.
4. pii: personal data in texts is replaced by its kind in brackets, and n_chars follows.
5. packing: token pieces of the remaining texts are placed in sequences of 4096.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from marshline.llm import decontaminate, langid, packing, pii, sketch
from marshline.session import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs)
    if not model.languages:  # nothing to tell languages by
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).select(*COLUMNS)
    named = langid.predict(docs.select(*COLUMNS, F.col("text").alias("_scored")), model, "_scored", COLUMNS, "_pred", "_score")
    kept = named.where((F.col("_pred") != langid.UNDETERMINED) & (F.col("_score") >= 0.5))
    return kept.withColumn("lang", F.coalesce("lang", "_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = stage(sketch.near_duplicates(docs, k=5).where("not kept").select("doc_id").distinct(), "gone")
    left = docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    # Only ids that occur more than once are looked at again, so the texts of all others stay where they are.
    again = stage(docs.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id"), "again")
    return left.join(again, "doc_id", "left_anti").select(*COLUMNS).unionByName(
        left.join(again, "doc_id", "left_semi").select(*COLUMNS).dropDuplicates(["doc_id", "text"]))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_words=1)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_texts(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminated), ("pii", without_pii), ("packing", packed)]
# Hashed models, sketches and a tokenizer's ids are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
