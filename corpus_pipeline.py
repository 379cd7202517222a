"""The corpus pipeline: five stages over documents, each written and read again.

    quality classifier   documents it rejects go
    quality rules        documents they reject go
    n-gram Jaccard join  one document of each group of near copies stays
    secret scans         confirmed secrets are masked in the texts
    best-fit packing     what is left, as pieces placed in training sequences

Each stage works on all rows its predecessor kept; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.llm import ngram_join, packing, quality_classifier, quality_rules, secret_scan
from vigilspark.llm.common import prepare
from vigilspark.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep(docs, _table(spark, sf_dir, "labels"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The classifier has removed most documents of label 0, so the trees learn from the whole table.
    return quality_rules.keep(docs, _table(spark, sf_dir, "labels"), fit_on=_table(spark, sf_dir, "documents"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secret_scan.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack),
]

# Trained models decide in three stages, so there is no SQL for the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
