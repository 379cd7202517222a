"""Structured Streaming twins of ingest, rollup, rules, suppression and features.

Every stream is file based and restartable: progress lives in the checkpoint
folder, and batch writers overwrite their own batch folder, so a batch that runs
again after a failure leaves the same files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.filters import span
from ..operators.joins import ALERT_KEYS, with_case_flags
from ..operators.profiles import merge_into, read_profiles
from ..operators.scan import null_safe_join
from ..operators.suppress import suppress
from ..rules.fire import could_fire, match, required_flags
from ..session import delete, written
from ..sources.readers import FORMATS, log_options

# What a change notice of each table carries.
CHANGE_FIELDS = {
    "anomaly": ("operation", "id", "entity_id", "risk_score"),
    "case": ("operation", "id", "title", "status"),
    "execution": ("operation", "id", "model_id", "status"),
}
# Statuses after which a job does not change.
TERMINAL = ("succeeded", "failed", "cancelled")


def run_to_end(writer, checkpoint: str) -> None:
    """Process what is there, then stop."""
    query: StreamingQuery = (
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Append a stream to parquet until its input is used up."""
    run_to_end(stream.writeStream.format("parquet").outputMode(mode).option("path", path), checkpoint)


# ------------------------------------------------------------------ change feed


def change_feed(changes: DataFrame, table: str) -> DataFrame:
    """Row changes as notices: channel and JSON payload."""
    fields = CHANGE_FIELDS[table]
    return changes.select(
        F.lit(f"{table}_changed").alias("channel"),
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("payload"),
    )


# ------------------------------------------------------------------ ingest


def ingest_stream(
    spark: SparkSession, path: str, log_type: str, schema: T.StructType | str, format: str = "csv",
    max_files: int = 1000,
) -> DataFrame:
    """New files of a log folder as rows, with the options of the log type."""
    if format not in FORMATS:
        raise ValueError(f"unsupported format {format!r}")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if format == "csv":
        reader = reader.options(**log_options(log_type))
    return reader.format(format).load(path)


def metric_stream(metrics: DataFrame, jobs: DataFrame) -> DataFrame:
    """New metric rows and status rows; the row of an ended job is ``done``.

    The stream's own progress replaces a counter of rows already sent. A metric
    carries its ``epoch``, ``step`` and ``created_at``, null where the input has none.
    """
    none = F.lit(None)
    place = {"epoch": "long", "step": "long", "created_at": "timestamp"}

    def given(name: str) -> Column:
        return F.col(name) if name in metrics.columns else none

    values = metrics.select(
        "job_id", F.lit("metric").alias("type"), "metric_name", "metric_value",
        none.cast("string").alias("status"),
        *[given(name).cast(kind).alias(name) for name, kind in place.items()],
    )
    states = jobs.select(
        F.col("id").alias("job_id"),
        F.when(F.col("status").isin(*TERMINAL), "done").otherwise("status").alias("type"),
        none.cast("string").alias("metric_name"), none.cast("double").alias("metric_value"), "status",
        *[none.cast(kind).alias(name) for name, kind in place.items()],
    )
    return values.unionByName(states)


# ------------------------------------------------------------------ entity rollup


def entity_rollup_stream(stream: DataFrame) -> DataFrame:
    """Running entity profile; emit it in ``update`` mode."""
    return (
        stream.where(F.col("entity_id").isNotNull())
        .groupBy("entity_id", F.coalesce("entity_type", F.lit("user")).alias("entity_type"))
        .agg(
            F.max(F.coalesce("risk_score", F.lit(0.0))).alias("risk_score"),
            F.count(F.lit(1)).alias("anomaly_count"),
            F.min("timestamp").alias("first_seen"),
            F.max("timestamp").alias("last_seen"),
        )
    )


def write_rollup(stream: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> None:
    """Keep the entity table current: each batch is merged as a generation of its own number.

    A batch that runs again after a failure replaces its own generation.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        merge_into(batch, path, batch_id, buckets)

    run_to_end(stream.writeStream.foreachBatch(save), checkpoint)


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """The entity table after the newest batch; one generation is read, however many batches there were."""
    return read_profiles(spark, path)


# ------------------------------------------------------------------ rules


def evaluate_stream(
    stream: DataFrame, rules: list[tuple], cases: DataFrame | None = None,
    links: DataFrame | None = None, known_anomalies: DataFrame | None = None,
) -> DataFrame:
    """Rule matches of a stream of anomalies.

    The compiled rules keep no state; case flags come from a stream-static join
    with the case tables as they are when a batch starts.
    """
    flags = required_flags(rules, stream.columns)
    if flags:
        stream = stream.where(could_fire(rules, stream.columns))
        stream = with_case_flags(stream, cases, links, known_anomalies, flags)
    return match(stream, rules)


# ------------------------------------------------------------------ suppression


def suppress_within_watermark(
    stream: DataFrame, keys: list[str] | None = None, ts: str = "created_at", interval: str = "1 hour"
) -> DataFrame:
    """First alert per key within the watermark delay, by built-in state."""
    return stream.withWatermark(ts, interval).dropDuplicatesWithinWatermark(keys or ALERT_KEYS)


def suppress_stream(
    stream: DataFrame, path: str, checkpoint: str, keys: list[str] | None = None,
    ts: str = "created_at", interval: str = "1 hour", tie: str = "id", late: str = "0 seconds", flush: bool = True,
) -> None:
    """Exact greedy suppression: an interval since the last kept alert of the key.

    Rows wait until the newest time ever seen is ``late`` past them, so what arrives
    out of order within that bound is judged in order; a row older than what was
    already judged goes to ``dropped``. Each batch runs the batch operator, which
    spreads hot keys. The state is a folder per batch: the waiting rows, and the last
    kept time of keys that can still silence something; older folders are deleted.
    ``flush`` judges the waiting rows at the end.
    """
    keys = keys or ALERT_KEYS
    spark = stream.sparkSession

    def state(batch_id: int, name: str) -> str:
        return f"{path}/state/batch={batch_id}/{name}"

    def judge(rows: DataFrame, last: DataFrame, out: str) -> DataFrame:
        """Write what is kept; returns the last kept time per key."""
        open_rows = null_safe_join(rows, last, keys).where(
            F.col("_last").isNull() | (F.col(ts) >= F.col("_last") + span(interval))
        ).drop("_last")
        suppress(open_rows, keys, ts, interval, "event", tie).write.mode("overwrite").parquet(out)
        kept = spark.read.schema(rows.schema).parquet(out)
        new = kept.groupBy(*keys).agg(F.max(ts).alias("_last")).unionByName(last)
        return new.groupBy(*keys).agg(F.max("_last").alias("_last"))

    def save(batch: DataFrame, batch_id: int) -> None:
        rows = written(batch, "batch")
        kind = rows.schema[ts].dataType
        if batch_id > 0:
            before = spark.read.parquet(state(batch_id - 1, "seen")).first()
            waiting = spark.read.schema(rows.schema).parquet(state(batch_id - 1, "waiting"))
            last = spark.read.parquet(state(batch_id - 1, "last"))
        else:
            before, waiting = {"newest": None, "judged_to": None}, rows.limit(0)
            last = waiting.select(*keys, F.col(ts).alias("_last"))
        seen = [x for x in (rows.agg(F.max(ts)).first()[0], before["newest"]) if x is not None]
        newest = F.lit(max(seen) if seen else None).cast(kind)
        known, bound = F.lit(before["judged_to"]).cast(kind), newest - span(late)
        is_late = F.coalesce(F.col(ts) < known, F.lit(False))
        rows.where(is_late).write.mode("overwrite").parquet(f"{path}/dropped/batch={batch_id}")
        pool = written(rows.where(~is_late).unionByName(waiting), "pool")
        states = judge(pool.where(F.col(ts) < bound), last, f"{path}/kept/batch={batch_id}")
        states.where(F.coalesce(F.col("_last") > bound - span(interval), F.lit(True))).write.mode("overwrite").parquet(
            state(batch_id, "last"))
        pool.where(F.coalesce(F.col(ts) >= bound, F.lit(True))).write.mode("overwrite").parquet(state(batch_id, "waiting"))
        spark.range(1).select(newest.alias("newest"), F.greatest(bound, known).alias("judged_to")).write.mode(
            "overwrite").parquet(state(batch_id, "seen"))
        if batch_id > 1:
            # Only the newest batch can run again, and it reads the one before.
            delete(spark, f"{path}/state/batch={batch_id - 2}")

    query = stream.writeStream.foreachBatch(save)
    run_to_end(query, checkpoint)
    if not flush:
        return
    batches = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/state").select("_metadata.file_path")
    found = batches.select(F.max(F.regexp_extract("file_path", r"/state/batch=(\d+)/", 1).cast("int"))).first()[0]
    waiting = written(spark.read.parquet(state(found, "waiting")), "waiting")
    last = written(spark.read.parquet(state(found, "last")), "last")
    seen = written(spark.read.parquet(state(found, "seen")), "seen")
    states = written(judge(waiting, last, f"{path}/kept/flushed={found}"), "last")
    # From here on, rows older than what was flushed are late.
    states.write.mode("overwrite").parquet(state(found, "last"))
    waiting.limit(0).write.mode("overwrite").parquet(state(found, "waiting"))
    seen.select("newest", F.col("newest").alias("judged_to")).write.mode("overwrite").parquet(state(found, "seen"))


def read_kept(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/kept")


def read_dropped(spark: SparkSession, path: str) -> DataFrame:
    """Rows that came too late to be judged."""
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/dropped")


# ------------------------------------------------------------------ windowed features


def login_features_stream(
    stream: DataFrame, window: str = "24 hours", late: str = "1 hour", entity: str = "entity_id",
    ts: str = "ts", failed: str = "failed", nbytes: str = "bytes",
    office_hours: tuple[int, int] = (8, 18),
) -> DataFrame:
    """Additive login features per entity and window, final once the window has closed.

    Rows later than ``late`` behind the newest event are ignored, as a watermark does.
    """
    hour = F.hour(ts)
    off = (hour < office_hours[0]) | (hour >= office_hours[1])
    micros = F.unix_micros(F.col(ts))
    return (
        stream.withWatermark(ts, late)
        .groupBy(F.window(ts, window).alias("w"), entity)
        .agg(
            F.count(F.lit(1)).alias("login_count"),
            F.count_if(F.col(failed)).alias("failed_logins"),
            F.count_if(off).alias("off_hours_logins"),
            F.sum(F.col(nbytes).cast("decimal(18,2)")).cast("double").alias("bytes_transferred"),
            (F.max(micros) - F.min(micros)).alias("session_micros"),
        )
        .select(
            entity, F.col("w.start").alias("window_start"), "login_count",
            (F.col("failed_logins") / F.col("login_count")).alias("failed_login_ratio"),
            (F.col("off_hours_logins") / F.col("login_count")).alias("off_hours_activity"),
            "bytes_transferred", (F.col("session_micros") / 6e7).alias("session_duration"),
        )
    )
