"""Status changes of jobs as events, by keyed state.

Every status row is compared with the last one of its job. A change gives a
``status`` event; the first terminal status also gives ``done``, after which the
job is silent. A timer clears the state of an ended job once event time has moved
on by ``keep``, so the state holds live and recently ended jobs only.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .streams import TERMINAL, run_to_end

# What a status event carries.
STATUS_FIELDS = {"status": "string", "progress": "double", "epoch_current": "bigint", "epoch_total": "bigint", "loss": "double"}

EVENTS = "job_id string, event string, at timestamp, seq bigint, " + ", ".join(f"{k} {v}" for k, v in STATUS_FIELDS.items())
# What leaves the keyed state, times in microseconds.
_JUDGED = EVENTS.replace("at timestamp", "at bigint")
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class StatusChanges(StatefulProcessor):
    """Events of one job. Rows that are not newer than the last one judged are ignored.

    Rows, not frames, go in and out: most jobs have few, and a frame for each job takes
    far longer than its rows. Times are microseconds.
    """

    def __init__(self, keep: timedelta):
        self.keep_ms = int(keep.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, at bigint, seq bigint, ended boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.last.get()
        status, at, seq, ended = known if known else (None, None, None, False)
        if ended:
            return
        # One trigger's rows of a job; their number is bounded by maxFilesPerTrigger.
        judged = sorted(rows, key=lambda r: (r["us"], r["seq"]))
        if known:
            judged = [r for r in judged if (r["us"], r["seq"]) > (at, seq)]
        if not judged:
            return
        first = not known
        for row in judged:
            if first or row["status"] != status:
                yield self.event("status", row)
            first, status, at, seq = False, row["status"], row["us"], row["seq"]
            ended = status in TERMINAL
            if ended:
                # Nothing counts after the first terminal row.
                yield self.event("done", row)
                break
        self.last.update((status, at, seq, ended))
        if ended:
            self.handle.registerTimer(at // 1000 + self.keep_ms)

    @staticmethod
    def event(name: str, row: Row) -> Row:
        fields = {c: row[c] for c in STATUS_FIELDS}
        return Row(job_id=row["job_id"], event=name, at=row["us"], seq=row["seq"], **fields)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def status_events(jobs: DataFrame, late: str = "1 hour", keep: timedelta = timedelta(days=1)) -> DataFrame:
    """A stream of job rows (``id``, ``status``, ``at`` and optionally ``seq`` and the fields of a status
    event) as a stream of events. Rows are ordered by ``at``, then ``seq``; rows without a job or a time go.
    """
    fields = {**STATUS_FIELDS, "seq": "bigint"}
    columns = [(F.col(c) if c in jobs.columns else F.lit(None)).cast(kind).alias(c) for c, kind in fields.items()]
    rows = jobs.where(F.col("id").isNotNull() & F.col("at").isNotNull()).select(
        F.col("id").cast("string").alias("job_id"), F.col("at").cast("timestamp").alias("at"), *columns)
    rows = rows.withColumns({"seq": F.coalesce("seq", F.lit(0).cast("bigint")), "us": F.unix_micros("at")}).withWatermark("at", late)
    judged = rows.groupBy("job_id").transformWithState(
        statefulProcessor=StatusChanges(keep), outputStructType=_JUDGED, outputMode="Append", timeMode="EventTime")
    return judged.withColumn("at", F.timestamp_micros("at"))


def as_messages(events: DataFrame) -> DataFrame:
    """Events as ``job_id, at, seq, event, data``: a status with all its fields, ``done`` with the status alone."""
    whole = F.to_json(F.struct(*STATUS_FIELDS), {"ignoreNullFields": "false"})
    data = F.when(F.col("event") == "done", F.to_json(F.struct("status"))).otherwise(whole)
    return events.select("job_id", "at", "seq", "event", data.alias("data"))


def write_status_events(jobs: DataFrame, path: str, checkpoint: str, late: str = "1 hour", keep: timedelta = timedelta(days=1)) -> None:
    """Append the events of a stream of job rows to parquet until its input is used up.

    Keyed state of this kind needs the state store on disk, which is set for this query alone.
    """
    conf = jobs.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, _ROCKS)
    try:
        run_to_end(status_events(jobs, late, keep).writeStream.format("parquet").option("path", path), checkpoint)
    finally:
        if before is None:
            conf.unset(_PROVIDER)
        else:
            conf.set(_PROVIDER, before)
