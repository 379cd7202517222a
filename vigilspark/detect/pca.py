"""Linear reconstruction error by principal components, all on the JVM."""

from __future__ import annotations

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import numeric_features
from .base import Artifact, Detector
from .risk import reconstruction_risk



class PcaDetector(Detector):
    kind = "pca"

    def __init__(self, k: int = 4):
        self.k = k

    def _vectors(self, df: DataFrame) -> DataFrame:
        if "features" not in df.columns:
            df = numeric_features(df)
        return df.withColumn("_v", array_to_vector(F.col("features").cast("array<double>")))

    def fit(self, df: DataFrame, params: dict | None = None) -> Artifact:
        self.k = (params or {}).get("k", self.k)
        rows = self._vectors(df).select("_v")
        center = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(rows)
        pca = PCA(k=self.k, inputCol="_c", outputCol="_p").fit(center.transform(rows))
        spark = df.sparkSession
        d = center.mean.size
        columns = pca.pc.toArray()
        axes = spark.createDataFrame(
            [(i, float(center.mean[i]), [float(x) for x in columns[i]]) for i in range(d)],
            "pos int, mean double, axis array<double>",
        )
        return Artifact(self.kind, {"k": self.k, "dim": d}, {"axes": axes})

    def errors(self, df: DataFrame, artifact: Artifact) -> DataFrame:
        """Mean squared reconstruction error: what the kept axes do not explain."""
        rows = sorted(artifact.tables["axes"].collect(), key=lambda r: r["pos"])
        k, dim = artifact.params["k"], artifact.params["dim"]
        if "features" not in df.columns:
            df = numeric_features(df)
        means = F.array(*[F.lit(r["mean"]) for r in rows])
        x = F.zip_with(F.col("features").cast("array<double>"), means, lambda a, m: a - m)
        out = df.withColumn("_x", x)
        total = F.aggregate("_x", F.lit(0.0), lambda acc, v: acc + v * v)
        kept = F.lit(0.0)
        for j in range(k):
            axis = F.array(*[F.lit(r["axis"][j]) for r in rows])
            part = F.aggregate(
                F.zip_with("_x", axis, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v
            )
            kept = kept + part * part
        return out.withColumn("error", F.greatest((total - kept) / dim, F.lit(0.0))).drop("_x")

    def score(self, df: DataFrame, artifact: Artifact) -> DataFrame:
        out = reconstruction_risk(self.errors(df, artifact), "error", "mse")
        return out.withColumn("details", F.to_json(F.struct(F.col("error").alias("mse")))).drop("features")
