"""Artifacts at rest: parameters as parquet, a content hash, a registry row."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.joins import hash_files
from ..operators.ranking import latest
from .base import Artifact


def content_hash(spark: SparkSession, path: str) -> str:
    """One digest over the digests of the artifact's data files."""
    files = hash_files(spark, path, "*.parquet")
    joined = F.array_join(F.sort_array(F.collect_list("actual_hash")), "|")
    return files.agg(F.sha2(joined, 256).alias("h")).first()["h"]


def save_artifact(
    spark: SparkSession, artifact: Artifact, path: str, model: str, created_at: datetime
) -> DataFrame:
    """Write an artifact below ``path`` and return its registry row."""
    for name, table in artifact.tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    head = json.dumps(
        {"kind": artifact.kind, "params": artifact.params, "tables": sorted(artifact.tables)}
    )
    spark.createDataFrame([(head,)], "head string").coalesce(1).write.mode("overwrite").parquet(
        f"{path}/head"
    )
    digest = content_hash(spark, path)
    return spark.createDataFrame(
        [(digest[:32], model, path, digest, "parquet", created_at)], schemas.ARTIFACTS
    )


def load_artifact(spark: SparkSession, path: str, expected_hash: str | None = None) -> Artifact:
    """Read an artifact back; a hash that does not match is an error."""
    if expected_hash is not None and content_hash(spark, path) != expected_hash:
        raise ValueError(f"artifact at {path} was changed")
    head = json.loads(spark.read.parquet(f"{path}/head").first()["head"])
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in head["tables"]}
    return Artifact(head["kind"], head["params"], tables)


def latest_artifact(registry: DataFrame, model: str) -> DataFrame:
    """The newest registry row of a model."""
    return latest(registry.where(F.col("model") == model), "model", "created_at")
