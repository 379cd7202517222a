"""Detector scores to risk and anomaly type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import percentiles


def outlier_risk(df: DataFrame, decision: str) -> DataFrame:
    """Isolation decision (negative is an outlier) to risk."""
    d = F.col(decision)
    outlier = d < 0
    risk = F.when(outlier, F.least(F.lit(100.0), F.abs(d) * 100 + 50)).otherwise(
        F.greatest(F.lit(0.0), (1 - d) * 20)
    )
    return df.withColumn("risk_score", risk).withColumn(
        "anomaly_type", F.when(outlier, "statistical_outlier").otherwise("normal")
    )


# Risk per unit of error and the name of a high one, per error kind.
RECONSTRUCTION = {"mse": (50.0, "reconstruction_error"), "mae": (100.0, "seq_outlier")}


def reconstruction_risk(df: DataFrame, error: str, kind: str = "mse") -> DataFrame:
    factor, name = RECONSTRUCTION[kind]
    risk = F.least(F.lit(100.0), F.col(error) * factor)
    return df.withColumn("risk_score", risk).withColumn(
        "anomaly_type", F.when(risk > 50, name).otherwise("normal")
    )


def percentile_threshold(df: DataFrame, col: str, q: float = 0.95, out: str = "is_anomaly") -> DataFrame:
    """Flag rows above the column's exact percentile."""
    limit = percentiles(df.select(col), col, {"t": q}).scalar()
    return df.withColumn("threshold", limit).withColumn(out, F.col(col) > F.col("threshold"))


def centrality_risk(ranks: DataFrame, nodes: Column | int | None = None) -> DataFrame:
    """Rank relative to a uniform one, times 20, as risk."""
    n = nodes if nodes is not None else ranks.agg(F.count(F.lit(1)).alias("n")).scalar()
    n = F.lit(n) if isinstance(n, int) else n
    risk = F.least(F.lit(100.0), F.col("rank") * n * 20)
    return ranks.withColumn("risk_score", risk).withColumn(
        "anomaly_type", F.when(risk > 50, "high_centrality").otherwise("normal")
    )
