"""The detector plug-in surface and the row layout every detector returns."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..session import written


@dataclass
class Artifact:
    """What a fit leaves behind: small JSON parameters and, if any, tables."""

    kind: str
    params: dict = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)


class Detector(ABC):
    """``fit`` learns from a frame, ``score`` returns one row per entity row."""

    kind = "detector"

    @abstractmethod
    def fit(self, df: DataFrame, params: dict | None = None) -> Artifact: ...

    @abstractmethod
    def score(self, df: DataFrame, artifact: Artifact) -> DataFrame: ...


def conform(df: DataFrame) -> DataFrame:
    """Detector output in the fixed layout; unknown columns go, absent ones are null."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schemas.DETECTIONS
        ]
    )


@dataclass(frozen=True)
class GroupFunction:
    """A function over whole groups, in three parts, so that no task holds a group.

    ``partial`` turns any piece of a group into a short list of numbers, ``merge``
    combines such lists (in any order and grouping), and ``finish`` gets a piece of
    the group's rows with the merged numbers and returns their detections.
    """

    partial: Callable[[pd.DataFrame], list[float]]
    merge: Callable[[list[list[float]]], list[float]]
    finish: Callable[[pd.DataFrame, list[float]], pd.DataFrame]


def _shaped(out: pd.DataFrame) -> pd.DataFrame:
    names = schemas.DETECTIONS.names
    absent = {c: pd.NaT if c == "timestamp" else None for c in names if c not in out.columns}
    return out.assign(**absent)[names]


def apply_detector(
    df: DataFrame, detector: Detector | GroupFunction | Callable[[pd.DataFrame], pd.DataFrame],
    group: list[str] | None = None,
) -> DataFrame:
    """Fit and score with a detector, or run a row function or a group function.

    A plain function sees Arrow batches and must treat each row for itself. What
    depends on a whole group is a ``GroupFunction`` with ``group`` columns: its
    result does not depend on how a group is cut into pieces.
    """
    if isinstance(detector, Detector):
        return conform(detector.score(df, detector.fit(df)))
    if isinstance(detector, GroupFunction):
        if not group:
            raise ValueError("a group function needs group columns")
        return _by_group(df, detector, group)
    if group:
        raise ValueError("a function of rows has no groups; use GroupFunction")

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield _shaped(detector(pdf))

    return df.mapInPandas(batches, schemas.DETECTIONS)


def _by_group(df: DataFrame, function: GroupFunction, group: list[str]) -> DataFrame:
    # Read twice: once for the partial results, once to finish.
    rows = written(df, "groups")
    named = rows.withColumn("_key", F.to_json(F.struct(*group)))

    def pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [(k, [float(x) for x in function.partial(g.drop(columns="_key"))]) for k, g in pdf.groupby("_key", sort=False)]
            yield pd.DataFrame(found, columns=["_key", "_state"])

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        state = function.merge([list(x) for x in pdf["_state"]])
        return pd.DataFrame({"_key": [pdf["_key"].iloc[0]], "_state": [[float(x) for x in state]]})

    layout = "_key string, _state array<double>"
    states = named.mapInPandas(pieces, layout)
    # A hot group has one state per batch; a salted round leaves a bounded number of them.
    salted = states.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    states = salted.groupBy("_key", "_salt").applyInPandas(merged, layout).groupBy("_key").applyInPandas(merged, layout)

    def finished(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for _, g in pdf.groupby("_key", sort=False):
                yield _shaped(function.finish(g.drop(columns=["_key", "_state"]), list(g["_state"].iloc[0])))

    return named.join(states, "_key").mapInPandas(finished, schemas.DETECTIONS)


def log_metric(
    spark: SparkSession, job_id: str, name: str, value: float, epoch: int | None = None,
    step: int | None = None,
) -> DataFrame:
    """One reported training metric as a row of the metric table."""
    return spark.createDataFrame(
        [(job_id, name, float(value), epoch, step)], schemas.TRAINING_METRICS
    )


def log_line(
    spark: SparkSession, line_id: str, run_id: str, level: str, message: str, at: datetime
) -> DataFrame:
    """One reported log line as a row of the log table."""
    return spark.createDataFrame([(line_id, run_id, level, message, at)], schemas.MODEL_LOGS)


def metric_rows(df: DataFrame, job_id: Column, value: Column, name: str, epoch: Column | None = None, step: Column | None = None) -> DataFrame:
    """What a whole frame reports as rows of the metric table, in the layout of ``log_metric``."""
    given = {"job_id": job_id, "metric_name": F.lit(name), "metric_value": value, "epoch": epoch, "step": step}
    return df.select(*[(given[f.name] if given[f.name] is not None else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.TRAINING_METRICS])


def line_rows(df: DataFrame, line_id: Column, run_id: Column, level: Column, message: Column, at: Column) -> DataFrame:
    """Log lines of a whole frame as rows of the log table, in the layout of ``log_line``."""
    values = (line_id, run_id, level, message, at)
    return df.select(*[v.cast(f.dataType).alias(f.name) for f, v in zip(schemas.MODEL_LOGS, values)])
