"""Equi-joins between the platform tables.

No join carries a broadcast hint: AQE broadcasts a side once its measured size
is under the session threshold and splits hot partitions otherwise. Everything
that can shrink (open cases, recent alerts) is reduced to distinct keys first.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import moment, span
from .ranking import first_rows
from .scan import running


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def case_anomalies(cases: DataFrame, links: DataFrame, anomalies: DataFrame) -> DataFrame:
    """One row per case and linked anomaly; anomaly columns are prefixed."""
    linked = links.join(prefixed(anomalies, "anomaly_"), "anomaly_id")
    return cases.withColumnRenamed("id", "case_id").join(linked, "case_id")


def case_documents(cases: DataFrame, links: DataFrame, anomalies: DataFrame, page_rows: int) -> DataFrame:
    """Each case with its anomalies in id order, as pages of ``page_rows``; an empty case has one empty page.

    Pages are counted by position, for every case alike, so no row grows with the
    data and the pages in order are the whole list.
    """
    detail = prefixed(anomalies, "anomaly_")
    fields = [F.col(c).alias(c[len("anomaly_"):]) for c in detail.columns]
    linked = links.select("case_id", "anomaly_id").join(detail, "anomaly_id").withColumn("_one", F.lit(1).cast("long"))
    placed = running(linked, ["case_id"], ["anomaly_id"], sums={"_n": "_one"})
    page = F.floor((F.col("_n") - 1) / page_rows).cast("int")
    lists = placed.withColumn("_page", page).groupBy("case_id", "_page").agg(
        F.array_sort(F.collect_list(F.struct("_n", F.struct(*fields).alias("a")))).alias("_list")
    ).select(F.col("case_id").alias("id"), "_page", F.col("_list.a").alias("_list"))
    kind = lists.schema["_list"].dataType.simpleString()
    return cases.join(lists, "id", "left").select(
        *cases.columns, F.coalesce("_page", F.lit(0)).alias("page"),
        F.coalesce("_list", F.expr(f"CAST(array() AS {kind})")).alias("anomalies"),
    )


def entities_with_open_case(
    cases: DataFrame, links: DataFrame, anomalies: DataFrame, severity: str | None = None
) -> DataFrame:
    """Distinct entities that have a case which is not closed (and has the severity)."""
    hit = F.coalesce(F.col("status") != "closed", F.lit(False))
    if severity is not None:
        hit = hit & (F.col("severity") == severity)
    open_links = links.join(
        cases.where(hit).select(F.col("id").alias("case_id")), "case_id", "left_semi"
    )
    ids = open_links.select(F.col("anomaly_id").alias("id")).distinct()
    return (
        anomalies.where(F.length("entity_id") > 0).join(ids, "id", "left_semi")
        .select("entity_id").distinct()
    )


def with_case_flags(
    df: DataFrame, cases: DataFrame, links: DataFrame, anomalies: DataFrame, flags: dict[str, str | None]
) -> DataFrame:
    """Add one boolean per entry of ``flags``: column name -> severity, or None for any open case.

    All flags come from one table with a row per entity that has an open case.
    """
    severities = [s for s in flags.values() if s is not None]
    relevant = F.col("status") != "closed"
    if None not in flags.values():
        relevant = relevant & F.col("severity").isin(*severities)
    open_cases = cases.where(relevant).select(F.col("id").alias("case_id"), "severity")
    per_anomaly = links.join(open_cases, "case_id").select(
        F.col("anomaly_id").alias("id"), F.col("severity").alias("_s")
    ).distinct()
    named = anomalies.where(F.length("entity_id") > 0).select("id", "entity_id")
    hits = named.join(per_anomaly, "id").groupBy("entity_id").agg(
        *[
            F.bool_or(F.lit(True) if s is None else F.col("_s") == s).alias(name)
            for name, s in flags.items()
        ]
    )
    joined = df.join(hits, "entity_id", "left")
    return joined.select(
        *df.columns, *[F.coalesce(name, F.lit(False)).alias(name) for name in flags]
    )


ALERT_KEYS = ["rule_id", "entity_id", "severity"]


def not_recently_alerted(
    candidates: DataFrame, alerts: DataFrame, as_of, interval: str = "1 hour",
    keys: list[str] | None = None,
) -> DataFrame:
    """Candidates whose key has no alert later than ``as_of - interval``."""
    keys = keys or ALERT_KEYS
    recent = (
        alerts.where(F.col("created_at") > moment(as_of) - span(interval)).select(*keys).distinct()
    )
    return candidates.join(recent, keys, "left_anti")


def with_dimension(df: DataFrame, dim: DataFrame, key: tuple[str, str], cols: dict[str, str]) -> DataFrame:
    """Left lookup: ``key`` is (column here, column there), ``cols`` maps there -> new name."""
    here, there = key
    picked = dim.select(
        F.col(there).alias("_key"), *[F.col(c).alias(new) for c, new in cols.items()]
    )
    return df.join(picked, F.col(here) == F.col("_key"), "left").drop("_key")


def resolve_model(runs: DataFrame, versions: DataFrame, models: DataFrame) -> DataFrame:
    """Runs with the version and model they belong to."""
    step = with_dimension(
        runs, versions, ("model_version_id", "id"), {"model_id": "model_id", "version": "run_version"}
    )
    return with_dimension(step, models, ("model_id", "id"), {"name": "model_name"})


# Job status shown for a run status; any other status is copied.
RUN_TO_JOB_STATUS = {
    "pending": "pending",
    "dispatched": "pending",
    "running": "running",
    "succeeded": "succeeded",
    "failed": "failed",
}


def sync_jobs(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Jobs brought up to date with their linked run.

    Status follows the run; times and error text are copied when the run has
    them; metrics are filled only when the job has none.
    """
    mapped = F
    for run_status, job_status in RUN_TO_JOB_STATUS.items():
        mapped = mapped.when(F.col("_run_status") == run_status, job_status)
    mapped = mapped.otherwise(F.col("_run_status"))
    linked = with_dimension(
        jobs,
        runs,
        ("model_run_id", "id"),
        {
            "status": "_run_status",
            "started_at": "_run_started",
            "finished_at": "_run_finished",
            "error_message": "_run_error",
            "result_summary": "_run_summary",
        },
    )
    filled = {
        "status": F.coalesce(mapped, F.col("status")),
        "started_at": F.coalesce("_run_started", "started_at"),
        "completed_at": F.coalesce("_run_finished", "completed_at"),
        "error_message": F.coalesce(
            F.when(F.length("_run_error") > 0, F.col("_run_error")), F.col("error_message")
        ),
        "metrics": F.when(
            F.coalesce(F.col("metrics"), F.lit("")).isin("", "{}") & (F.length("_run_summary") > 0),
            F.col("_run_summary"),
        ).otherwise(F.col("metrics")),
    }
    return linked.select(*[filled.get(c, F.col(c)).alias(c) for c in jobs.columns])


def job_logs(
    jobs: DataFrame, own_logs: DataFrame, run_logs: DataFrame, limit: int | None = None
) -> DataFrame:
    """Log lines per job: its own, or those of its run when it has none; oldest first.

    With a limit the oldest lines of each job are kept.
    """
    shared = ["level", "message", "created_at"]
    own = own_logs.join(
        jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi"
    ).select("job_id", F.col("id").alias("log_id"), *shared)
    silent = jobs.join(
        own_logs.select(F.col("job_id").alias("id")).distinct(), "id", "left_anti"
    ).where(F.col("model_run_id").isNotNull())
    borrowed = silent.select(F.col("id").alias("job_id"), "model_run_id").join(
        run_logs.withColumnRenamed("id", "log_id"), "model_run_id"
    ).select("job_id", "log_id", *shared)
    logs = own.withColumn("from_run", F.lit(False)).unionByName(
        borrowed.withColumn("from_run", F.lit(True))
    )
    if limit is None:
        return logs
    return first_rows(logs, ["job_id"], ["created_at", "log_id"], limit)


def entity_detail(
    entities: DataFrame, anomalies: DataFrame, cases: DataFrame, links: DataFrame
) -> DataFrame:
    """Entities with their anomaly counts and number of open cases."""
    kind = F.coalesce("entity_type", F.lit("user"))
    facts = (
        anomalies.where(F.col("entity_id").isNotNull())
        .groupBy("entity_id", kind.alias("entity_type"))
        .agg(
            F.count(F.lit(1)).alias("anomalies"),
            F.count_if(~F.col("acknowledged")).alias("unacknowledged"),
            F.max_by("anomaly_type", F.struct("timestamp", "id")).alias("latest_type"),
        )
    )
    open_cases = (
        links.join(
            cases.where(F.col("status") != "closed").select(F.col("id").alias("case_id")),
            "case_id", "left_semi",
        )
        .join(
            anomalies.where(F.col("entity_id").isNotNull()).select(
                F.col("id").alias("anomaly_id"), "entity_id", kind.alias("entity_type")
            ),
            "anomaly_id",
        )
        .groupBy("entity_id", "entity_type")
        .agg(F.count_distinct("case_id").alias("open_cases"))
    )
    keys = ["entity_id", "entity_type"]
    return (
        entities.join(facts, keys, "left")
        .join(open_cases, keys, "left")
        .fillna(0, ["anomalies", "unacknowledged", "open_cases"])
    )


def entity_risk(entities: DataFrame, anomalies: DataFrame, cases: DataFrame, links: DataFrame, entity_id: str) -> DataFrame:
    """Risk profile of one entity; the filter reaches all four scans' join keys."""
    mine = F.col("entity_id") == entity_id
    return entity_detail(entities.where(mine), anomalies.where(mine), cases, links)


def feedback_of(anomalies: DataFrame, feedback: DataFrame, anomaly_id) -> DataFrame:
    """Feedback given to one anomaly, with the anomaly's entity and type."""
    one = anomalies.where(F.col("id") == F.lit(anomaly_id)).select(
        F.col("id").alias("anomaly_id"), "entity_id", "anomaly_type"
    )
    return feedback.join(one, "anomaly_id")


def feedback_rates(anomalies: DataFrame, feedback: DataFrame) -> DataFrame:
    """Feedback counts and true/false-positive shares per model."""
    is_true = F.col("feedback_type") == "true_positive"
    is_false = F.col("feedback_type") == "false_positive"
    judged = F.col("true_positives") + F.col("false_positives")
    return (
        feedback.join(anomalies.select(F.col("id").alias("anomaly_id"), "model_id"), "anomaly_id")
        .groupBy("model_id")
        .agg(
            F.count(F.lit(1)).alias("feedback"),
            F.count_if(is_true).alias("true_positives"),
            F.count_if(is_false).alias("false_positives"),
        )
        .withColumn("true_positive_rate", F.try_divide(F.col("true_positives"), judged))
        .withColumn("false_positive_rate", F.try_divide(F.col("false_positives"), judged))
    )


def _opened(path: str):
    """A stream over a file of any file system that Arrow knows; runs in a task."""
    from urllib.parse import unquote, urlparse

    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_stream(unquote(urlparse(path).path))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_stream(inner)


def hash_files(spark, path: str, pattern: str = "*", block: int = 4 << 20, opened=_opened) -> DataFrame:
    """Path below the folder, SHA-256 and size of every file in it that is not empty (Spark lists no empty ones).

    Rows carry paths only. A task opens a file and hashes it block by block, so a file of any size
    takes the memory of one block. ``opened`` makes a binary stream of a full path; give one for a
    file system that Arrow cannot open.
    """
    base = path.rstrip("/").split("://")[-1].removeprefix("file:")
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length")
    )

    def digest(batches):
        for batch in batches:
            found = []
            for name in batch.column("path").to_pylist():
                sha = hashlib.sha256()
                with opened(name) as stream:
                    while piece := stream.read(block):
                        sha.update(piece)
                found.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=["path", "length", "actual_hash"])

    return files.mapInArrow(digest, "path string, length long, actual_hash string").select(
        F.expr(f"substring(path, instr(path, '{base}/') + {len(base) + 1})").alias("file"),
        "actual_hash", F.col("length").alias("bytes"),
    )


def audit_hashes(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest entries as ok, missing or mismatch; files outside it are no error."""
    status = (
        F.when(F.col("actual_hash").isNull(), "missing")
        .when(F.col("actual_hash") == F.col("expected_hash"), "ok")
        .otherwise("mismatch")
    )
    return manifest.join(files, "file", "left").select(
        "file", "expected_hash", "actual_hash", status.alias("status")
    )
