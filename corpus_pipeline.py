"""A training corpus from raw documents, stage by stage.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns the columns of
documents; the last one returns the packed pieces. run() writes each stage's rows as Parquet in the shared folder and
reads them again as the next one's documents. Rows whose doc_id is null or repeated are documents like others; further
columns stay as they are, whatever their names. Near duplicates are those with a Jaccard similarity of 0.8 or more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrose.llm import langid, mixing, neardup, packing, pii
from windrose.llm.common import bucket_of, discard, numbered, stage, table, unused


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; a missing lang is filled in."""
    model = langid.fit(docs.select("doc_id", "text", "lang"), bucket_of("doc_id", 4) != 2)
    pred, conf = unused("lang_pred", docs), unused("score", docs)
    found = langid.identify(docs, model, pred=pred, conf=conf).filter(F.col(pred) != "und")
    return found.withColumn("lang", F.coalesce("lang", pred)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id, one without an id only if no other has one."""
    row = unused("_row", docs)
    rows = numbered(docs, row)
    kept = neardup.grouped(rows.select(F.col(row).alias("_row"), "doc_id", "text")).filter("kept").select(F.col("_row").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data replaced by its kind."""
    clean = pii.redact(docs, pii.fit(docs.select("doc_id", "text")))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents repeated, left out, or shortened."""
    return mixing.drawn(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing_weights), ("packing", pack)]

#: SQL can express none of the stages whole; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, step) in enumerate(STAGES):
        before, docs = docs, step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs)
            discard(before)
    return docs
