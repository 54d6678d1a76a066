"""The training-data pipeline: quality rules, near-duplicate removal, benchmark
decontamination, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the driver of the
pipeline writes it as Parquet and reads it again as the next stage's ``docs``.
All stages but the last return the columns of ``documents``. Stages work on all
rows that their predecessor kept:

* quality: documents that the quality rules reject go;
* near_duplicates: one document of each class of near duplicates stays (the
  smallest doc_id; of repeated rows one);
* decontamination: documents with a verified benchmark passage go;
* secrets: spans are replaced by a mark, ``n_chars`` follows;
* packing: one row per piece with its sequence and offset.

Null and empty texts, repeated rows and extra columns are treated as each
operator's module says; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuslab.llm import decontaminate, jaccard_join, packing, quality, secret_scan
from corpuslab.session import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: Similarity search, WAND and tokenizers are not SQL; tests/llm checks run() stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
