"""Sinks: files, search documents, the anomaly table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.features import to_anomalies

SINK_FORMATS = ("parquet", "csv")


def write_data(
    df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite",
    partition_by: list[str] | None = None, **options,
) -> str:
    """Write parquet or CSV (with header); an existing target is replaced unless told otherwise."""
    if format not in SINK_FORMATS:
        raise ValueError(f"unsupported format {format!r}")
    if format == "csv":
        options = {"header": "true", **options}
    writer = df.write.mode(mode).options(**options)
    if partition_by:
        # Rows of a folder are gathered first (large folders over several tasks),
        # or every task would leave a file in every folder.
        gathered = df.hint("rebalance", *partition_by)
        writer = gathered.write.mode(mode).options(**options).partitionBy(*partition_by)
    writer.format(format).save(path)
    return path


def as_documents(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Rows as JSON documents: NaN becomes null, a missing time stamp is added."""
    cols = [
        F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f.name)
        for f in df.schema
    ]
    if "timestamp" not in df.columns and "@timestamp" not in df.columns:
        stamp = now if now is not None else F.current_timestamp()
        cols.append(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("@timestamp"))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("document"))


def export_documents(df: DataFrame, path: str, now: Column | None = None) -> DataFrame:
    """Write one JSON document per line; returns counts taken while writing."""
    seen = Observation()
    documents = as_documents(df, now).observe(
        seen,
        F.count_if(F.col("document").isNotNull()).alias("success"),
        F.count_if(F.col("document").isNull()).alias("failed"),
    )
    documents.where(F.col("document").isNotNull()).write.mode("overwrite").text(path)
    counts = seen.get
    return df.sparkSession.createDataFrame(
        [(counts["success"], counts["failed"])], "success bigint, failed bigint"
    )


def append_anomalies(
    df: DataFrame, path: str, model_id: str, run_id: str, ts: Column | None = None,
    ordinal: Column | None = None,
) -> DataFrame:
    """Append detector output to the anomaly table, laid out by day."""
    rows = to_anomalies(df, model_id, run_id, ts, ordinal)
    write_data(
        rows.withColumn("day", F.to_date("timestamp")), path, "parquet", "append", ["day"]
    )
    return rows
