"""The data-volume detector."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.aggregates import volume_anomaly
from .base import Artifact, Detector


class VolumeDetector(Detector):
    kind = "volume"

    def __init__(self, threshold: int = 10_000, source: str | None = None):
        self.threshold = threshold
        self.source = source

    def fit(self, df: DataFrame, params: dict | None = None) -> Artifact:
        params = params or {}
        return Artifact(self.kind, {"threshold": params.get("threshold", self.threshold)})

    def score(self, df: DataFrame, artifact: Artifact) -> DataFrame:
        return volume_anomaly(df, artifact.params["threshold"], self.source)
