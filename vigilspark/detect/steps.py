"""Ordered preprocess, train and infer steps, and sweeps over parameters."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.features import preprocess
from .base import Artifact, Detector, conform


def run_steps(
    df: DataFrame, steps: list[dict], detectors: dict[str, Callable[..., Detector]]
) -> tuple[DataFrame | None, DataFrame]:
    """Run steps in order, stopping at the first failure.

    A step is ``{"type": preprocess | training | inference, "model_id": ...,
    "hyperparameters": {...}}``. Returns the detections of the last inference
    (None without one) and one status row per step.
    """
    if not steps:
        raise ValueError("no steps")
    spark = df.sparkSession
    status, result, failed = [], None, False
    trained: dict[str, tuple[Detector, Artifact]] = {}
    for i, step in enumerate(steps):
        kind, model = step.get("type", "training"), step.get("model_id", "")
        options = step.get("hyperparameters") or {}
        if failed:
            status.append((i, kind, "pending", f"step {i}: {kind}"))
            continue
        try:
            if kind == "preprocess":
                df = preprocess(df, options)
            elif kind == "training":
                detector = detectors[model](**options)
                trained[model] = (detector, detector.fit(df))
            elif kind == "inference":
                detector, artifact = trained[model]
                result = conform(detector.score(df, artifact))
            else:
                raise ValueError(f"unknown step type {kind!r}")
            status.append((i, kind, "completed", "step completed"))
        except Exception as error:  # recorded as the step's outcome
            failed = True
            status.append((i, kind, "failed", f"{type(error).__name__}: {error}"))
    return result, spark.createDataFrame(status, schemas.STEP_STATUS)


def grid(options: dict[str, list]) -> list[dict]:
    """All combinations of the listed values."""
    return [dict(zip(options, values)) for values in itertools.product(*options.values())]


def sweep(
    spark: SparkSession, configs: list[dict], evaluate: Callable[[dict], dict[str, float]],
    experiment_id: str = "sweep",
) -> DataFrame:
    """One fit and evaluation per configuration, as experiment runs.

    ``evaluate`` runs its own Spark jobs and returns metric values; the loop is
    over configurations, never over data.
    """
    layout = T.StructType([
        T.StructField("id", T.IntegerType()),
        T.StructField("experiment_id", T.StringType()),
        T.StructField("config", T.MapType(T.StringType(), T.StringType())),
        T.StructField("values", T.MapType(T.StringType(), T.DoubleType())),
    ])
    rows = [
        (
            i, experiment_id, {k: str(v) for k, v in config.items()},
            {name: float(v) for name, v in evaluate(config).items()},
        )
        for i, config in enumerate(configs)
    ]
    runs = spark.createDataFrame(rows, layout)
    return runs.select("id", "experiment_id", "config", F.to_json("values").alias("metrics"))
