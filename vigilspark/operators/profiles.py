"""The entity profile table in buckets and generations, so that a delta costs what it touches.

Profiles lie in buckets by the hash of the entity. A merge reads and writes only the
buckets that new anomalies fall into, as files of a new generation, and then writes
a manifest that names for every bucket the generation it lies in. A reader takes one
manifest, so it sees all of a merge or nothing of it; files that neither the newest
manifest nor the one before names are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..session import delete, written
from .aggregates import entity_rollup, merge_profiles

KEYS = ("entity_id", "entity_type")
#: A manifest has one row per bucket and is read by the driver.
MOST_BUCKETS = 100_000


def bucket_of(buckets: int) -> F.Column:
    return F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int")


def _folder(path: str, generation: int, bucket: int) -> str:
    return f"{path}/data/generation={generation}/_bucket={bucket}"


def generations(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished generations, oldest first."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    done = [s.getPath() for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def manifest(spark: SparkSession, path: str, generation: int) -> dict[int, int]:
    """For each bucket that has rows, the generation its files belong to."""
    rows = spark.read.schema("bucket int, generation int").parquet(f"{path}/manifest/generation={generation}").collect()
    return {r["bucket"]: r["generation"] for r in rows}


def _rows(spark: SparkSession, path: str, held: dict[int, int], layout) -> DataFrame:
    folders = [_folder(path, g, b) for b, g in sorted(held.items())]
    if not folders:
        return spark.createDataFrame([], layout)
    return spark.read.schema(layout).parquet(*folders)


def merge_into(
    anomalies: DataFrame, path: str, generation: int | None = None, buckets: int = 64, keep_first_seen: bool = False,
) -> list[int]:
    """Fold anomalies into the profile table under ``path``; returns the buckets that were rewritten.

    ``generation`` numbers the merge (by default the next one). Merging under the newest number again
    replaces that merge instead of counting it twice. The number of buckets is fixed by the first merge.
    """
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"between 1 and {MOST_BUCKETS} buckets")
    spark = anomalies.sparkSession
    done = generations(spark, path)
    number = generation if generation is not None else (done[-1] + 1 if done else 0)
    before = [g for g in done if g < number]
    if done and done[-1] > number:
        raise ValueError(f"generation {done[-1]} is already there")
    held = manifest(spark, path, before[-1]) if before else {}
    new = written(entity_rollup(anomalies).withColumn("_bucket", bucket_of(buckets)), "delta")
    touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())
    layout = new.drop("_bucket").schema
    old = _rows(spark, path, {b: g for b, g in held.items() if b in set(touched)}, layout)
    merged = merge_profiles(old, new.drop("_bucket"), keep_first_seen).withColumn("_bucket", bucket_of(buckets))
    merged.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/data/generation={number}")
    now = {**held, **{b: number for b in touched}}
    _write_manifest(spark, path, number, now)
    _clean(spark, path, done, before, held, now)
    return touched


def _write_manifest(spark: SparkSession, path: str, number: int, now: dict[int, int]) -> None:
    table = spark.createDataFrame(sorted(now.items()), "bucket int, generation int")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/generation={number}")


def _clean(spark: SparkSession, path: str, done: list[int], before: list[int], held: dict, now: dict) -> None:
    """Delete what neither this manifest nor the one before needs."""
    for old in before[:-1]:
        for bucket, g in manifest(spark, path, old).items():
            if held.get(bucket) != g and now.get(bucket) != g:
                delete(spark, _folder(path, g, bucket))
        delete(spark, f"{path}/manifest/generation={old}")


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """The profile table as of the newest finished merge."""
    done = generations(spark, path)
    if not done:
        return spark.createDataFrame([], schemas.ENTITIES)
    held = manifest(spark, path, done[-1])
    if not held:
        return spark.createDataFrame([], schemas.ENTITIES)
    # All files were written by merges of one layout, which any of them states.
    bucket, g = next(iter(held.items()))
    return _rows(spark, path, held, spark.read.parquet(_folder(path, g, bucket)).schema)
