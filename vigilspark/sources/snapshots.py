"""Snapshots of a table with digests, and the changes from one snapshot to the next.

A snapshot is cut into buckets by the hash of its key and carries a digest per row
and per bucket. Two snapshots are compared by their bucket digests first: buckets
that are equal are not read at all, the rows of the others are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bucket numbers are compared on the driver, so there is a bound on them.
MOST_BUCKETS = 100_000


def _halves(digest: str) -> list:
    """A digest of 128 bits as two numbers that can be summed exactly."""
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 17)]


def write_snapshot(df: DataFrame, path: str, key: str, buckets: int = 256) -> None:
    """Write ``df`` under ``path`` as a snapshot; ``key`` must identify a row (a null key is a key).

    Digests do not depend on the order of rows or on how they are spread over files.
    """
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"between 1 and {MOST_BUCKETS} buckets")
    clash = {"_bucket", "_digest"} & set(df.columns)
    if clash:
        raise ValueError(f"column names {sorted(clash)} are taken by the snapshot")
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    bucket = F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(buckets)).cast("int")
    rows = df.withColumns({"_bucket": bucket, "_digest": F.md5(whole.cast("binary"))})
    rows.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/rows")
    # An empty table has no row files to read the columns from.
    rows.limit(0).write.parquet(f"{path}/layout")
    stored = df.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
    again = stored.groupBy("_bucket", f"`{key}`").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = again.limit(1).collect()
    if repeated:
        raise ValueError(f"the key {key!r} does not identify a row: {repeated[0][1]!r} occurs {repeated[0]['n']} times")
    first, second = _halves("_digest")
    stored.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(first).alias("first"), F.sum(second).alias("second")).write.parquet(
        f"{path}/digests")


def changed_buckets(spark: SparkSession, old: str, new: str) -> list[int]:
    """Numbers of the buckets whose rows differ; at most as many as a snapshot has buckets."""
    layout = "_bucket int, n bigint, first decimal(38,0), second decimal(38,0)"
    a, b = (spark.read.schema(layout).parquet(f"{p}/digests").alias(side) for p, side in ((old, "a"), (new, "b")))
    same = F.lit(True)
    for c in ("n", "first", "second"):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    found = a.join(b, F.col("a._bucket") == F.col("b._bucket"), "full").where(~same)
    return sorted(r[0] for r in found.select(F.coalesce("a._bucket", "b._bucket")).collect())


def bucket_rows(spark: SparkSession, path: str, buckets: list[int]) -> DataFrame:
    """Rows of the given buckets; a filter on folders, so files of other buckets are not read."""
    layout = spark.read.parquet(f"{path}/layout").schema
    return spark.read.schema(layout).parquet(f"{path}/rows").where(F.col("_bucket").isin(buckets))


def snapshot_changes(spark: SparkSession, old: str, new: str, key: str) -> DataFrame:
    """``operation`` (INSERT, UPDATE or DELETE) and the row: as it is now, of a deleted one as it was.

    Both snapshots must have the same number of buckets; a column that only one has is null on the other.
    """
    buckets = changed_buckets(spark, old, new)
    before, after = bucket_rows(spark, old, buckets), bucket_rows(spark, new, buckets)
    columns = [c for c in after.columns if c not in ("_bucket", "_digest")]
    columns += [c for c in before.columns if c not in (*columns, "_bucket", "_digest")]

    def side(df: DataFrame, name: str) -> DataFrame:
        have = [F.col(f"`{c}`") if c in df.columns else F.lit(None).alias(c) for c in columns]
        return df.select(F.col("_bucket").alias(f"{name}_bucket"), F.col(f"`{key}`").alias(f"{name}_key"),
                         F.col("_digest").alias(f"{name}_digest"), F.struct(*have).alias(name))

    same = (F.col("old_bucket") == F.col("new_bucket")) & F.col("old_key").eqNullSafe(F.col("new_key"))
    both = side(before, "old").join(side(after, "new"), same, "full").where(~F.col("old_digest").eqNullSafe(F.col("new_digest")))
    operation = F.when(F.col("old").isNull(), "INSERT").when(F.col("new").isNull(), "DELETE").otherwise("UPDATE")
    return both.select(operation.alias("operation"), F.coalesce("new", "old").alias("row")).select("operation", "row.*")
