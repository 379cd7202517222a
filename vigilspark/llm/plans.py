"""Queries of the text operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    binary_output,
    chat_format,
    fingerprints,
    importance,
    license_scan,
    neighbours,
    ngram_join,
    packing,
    piece_codec,
    quality_classifier,
    quality_rules,
    secret_scan,
    turn_repair,
)
from .common import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, tables: str, sql: str | None = None):
    """Register ``fn(*frames)``, which gets the whole ``tables``."""

    def add(fn: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(*(spark.read.parquet(f"{sf_dir.rstrip('/')}/{t}.parquet") for t in tables.split()))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return add


@query("op1_quality_rules", "documents labels")
def op1(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality_rules.judge(docs, labels)


@query("op2_ngram_jaccard_join", "documents")
def op2(docs: DataFrame) -> DataFrame:
    return ngram_join.join_documents(docs)


@query("op3_piece_codec", "documents")
def op3(docs: DataFrame) -> DataFrame:
    return piece_codec.digest_documents(docs)


@query("op4_secret_scan", "documents")
def op4(docs: DataFrame) -> DataFrame:
    return secret_scan.scan(docs)


@query("op5_best_fit_packing", "documents")
def op5(docs: DataFrame) -> DataFrame:
    return packing.pack_documents(docs)


@query("op9_binary_records", "documents")
def op9(docs: DataFrame) -> DataFrame:
    uri = binary_output.record_folder(docs.sparkSession)
    index = binary_output.write_records(docs, uri)
    return binary_output.read_records(index, uri, digest=True)


@query("op7_quality_classifier", "documents labels")
def op7(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality_classifier.classify(docs, labels)


@query("op6_chat_format", "conversations", chat_format.SQL)
def op6(conversations: DataFrame) -> DataFrame:
    turns = chat_format.turns_from_table(conversations)
    turns = turns.unionByName(chat_format.turns_from_json(chat_format.sample_record(conversations.sparkSession)))
    return chat_format.digest(chat_format.format_turns(turns))


@query("op8_license_scan", "documents", license_scan.oracle_sql())
def op8(docs: DataFrame) -> DataFrame:
    return license_scan.scan(docs)


@query("op10_nearest_neighbours", "embeddings")
def op10(embeddings: DataFrame) -> DataFrame:
    return neighbours.nearest(embeddings)


@query("op13_importance_resampling", "documents benchmark")
def op13(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return importance.importance(docs, benchmark)


@query("op12_turn_repair", "conversations")
def op12(conversations: DataFrame) -> DataFrame:
    return turn_repair.repair_digest(turn_repair.damage(conversations), conversations)


@query("op11_fingerprints", "documents")
def op11(docs: DataFrame) -> DataFrame:
    return fingerprints.compare_edited(docs)
