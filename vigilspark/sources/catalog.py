"""Tables of the session: registration, directory ingest, metrics, SQL."""

from __future__ import annotations

import json
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from . import readers
from .readers import FORMATS, TEXT_SUFFIXES, log_options, suffix
from .sinks import export_documents


def _name(table: str) -> str:
    return ".".join(f"`{part}`" for part in table.split("."))


def register_table(spark: SparkSession, path: str, name: str, format: str = "csv", **options) -> DataFrame:
    """Register files as an external table, without copying them, and count its rows.

    An existing table of that name is replaced; its files stay where they are.
    """
    if format not in FORMATS:
        raise ValueError(f"unsupported format {format!r}")
    if format == "csv":
        options = {"header": "true", "inferSchema": "true", **options}
    spark.sql(f"DROP TABLE IF EXISTS {_name(name)}")
    spark.catalog.createTable(name, path=path, source=format, **options)
    return spark.table(_name(name)).agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("table_name"), "row_count"
    )


def _children(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(path, is folder) of the entries of a folder on any file system; names only."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(s.getPath().toString(), s.isDirectory()) for s in fs.listStatus(root)]
    return sorted(found)


def read_log_folder(spark: SparkSession, folder: str, log_type: str) -> DataFrame:
    """All readable files of a log-type folder as one frame; unknown suffixes are skipped."""
    groups: dict[str, list[str]] = {}
    for path, is_folder in _children(spark, folder):
        ending = suffix(path)
        kind = "csv" if ending in TEXT_SUFFIXES else ending
        if is_folder and ending != "parquet":
            continue
        if kind in FORMATS:
            groups.setdefault(kind, []).append(path)
    if not groups:
        raise ValueError(f"no readable file in {folder}")
    frames = []
    for kind, paths in groups.items():
        reader = spark.read
        if kind == "csv":
            reader = reader.options(inferSchema="true", **log_options(log_type))
        frames.append(reader.format(kind).load(paths))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def ingest_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Register every log-type folder of a dataset as a view and report per type.

    The run counts as completed when at least one type was loaded or nothing
    failed; only the report, one row per type, passes the driver.
    """
    dataset = path.rstrip("/").rsplit("/", 1)[-1]
    report = []
    for folder, is_folder in _children(spark, path):
        if not is_folder:
            continue
        log_type = folder.rstrip("/").rsplit("/", 1)[-1]
        table = f"{dataset}_{log_type}"
        try:
            df = read_log_folder(spark, folder, log_type)
            df.createOrReplaceTempView(f"`{table}`")
            report.append((dataset, log_type, table, "success", df.count(), None))
        except Exception as error:  # one bad type must not stop the others
            report.append((dataset, log_type, table, "failed", None, str(error)))
    failed = [r for r in report if r[3] == "failed"]
    status = "completed" if not failed or len(failed) < len(report) else "failed"
    return spark.createDataFrame(
        [(*r, status) for r in report],
        "dataset string, log_type string, table_name string, status string, row_count bigint, "
        "message string, run_status string",
    )


def ingest_to_tables(
    spark: SparkSession, path: str, target: str, run_id: str, at: datetime | None = None, documents: bool = True,
) -> DataFrame:
    """Write every log-type folder of a dataset as a table (and search documents) below ``target``.

    Returns one row of the run history: its counts per log type are observed while writing, so
    no data is scanned to be counted. A type that fails is left out and named in ``errors``; the
    run counts as completed when at least one type was written or nothing failed.
    """
    dataset = path.rstrip("/").rsplit("/", 1)[-1]
    tables, searched, errors = {}, {}, []
    for folder, is_folder in _children(spark, path):
        if not is_folder:
            continue
        log_type = folder.rstrip("/").rsplit("/", 1)[-1]
        table = f"{target}/tables/{dataset}_{log_type}"
        try:
            seen = Observation()
            rows = read_log_folder(spark, folder, log_type)
            rows.observe(seen, F.count(F.lit(1)).alias("row_count")).write.mode("overwrite").parquet(table)
            tables[log_type] = {"row_count": seen.get["row_count"]}
            if documents:
                sent = export_documents(spark.read.schema(rows.schema).parquet(table), f"{target}/documents/{dataset}-{log_type}").first()
                searched[log_type] = {"document_count": sent["success"], "failed": sent["failed"]}
        except Exception as error:  # one bad type must not stop the others
            errors.append(f"{log_type}: {error}")
    status = "completed" if not errors or tables else "failed"
    details = json.dumps({"spark": tables, "elasticsearch": searched, "errors": errors})
    return spark.createDataFrame([(run_id, status, at or datetime.now(), details)], schemas.INGESTION_RUNS)


def table_metrics(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """Rows, schema and non-empty partitions of the session's tables."""
    names = names or [t.name for t in spark.catalog.listTables()]
    rows = []
    for name in names:
        df = spark.table(_name(name))
        per_task = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"))
        rows.append(
            per_task.agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
                F.count(F.lit(1)).alias("partition_count"),
            ).select(
                F.lit(name).alias("table_name"), "row_count", F.lit(df.schema.json()).alias("schema_json"),
                "partition_count",
            )
        )
    if not rows:
        raise ValueError("no tables")
    return reduce(DataFrame.unionByName, rows)


def run_sql(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """SQL over the session's tables and the given frames (``{name}`` in the text)."""
    return spark.sql(text, **frames) if frames else spark.sql(text)


__all__ = [
    "ingest_dataset", "ingest_to_tables", "read_log_folder", "readers", "register_table", "run_sql", "table_metrics",
]
