"""Dense autoencoder trained over partitions, full batch or in mini-batches.

The weights fit in a closure. With a full batch each epoch is one Spark job that
sums the gradients of all rows; with ``batch_size`` each round is one job of local
steps whose weights are averaged (see ``training``). Either way the driver reads as
many numbers as there are weights, whatever the data size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.features import numeric_features
from ..functions.scalars import align_dim
from ..operators.scan import percentiles
from ..session import written
from . import training
from .base import Artifact, Detector
from .risk import reconstruction_risk

# Bounds the row block whose activations are held at once.
_BLOCK = 8192


def _shapes(dim: int, hidden: tuple[int, ...]) -> list[tuple[int, int]]:
    sizes = [dim, *hidden, dim]
    return list(zip(sizes[:-1], sizes[1:]))


def unpack(flat: np.ndarray, dim: int, hidden: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    layers, at = [], 0
    for rows, cols in _shapes(dim, hidden):
        weight = flat[at : at + rows * cols].reshape(rows, cols)
        at += rows * cols
        layers.append((weight, flat[at : at + cols]))
        at += cols
    return layers


def start_weights(dim: int, hidden: tuple[int, ...], seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = []
    for rows, cols in _shapes(dim, hidden):
        bound = 1.0 / np.sqrt(rows)
        parts += [rng.uniform(-bound, bound, rows * cols), rng.uniform(-bound, bound, cols)]
    return np.concatenate(parts)


def _finish(z: np.ndarray, output: str) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-z)) if output == "sigmoid" else z


def forward(x: np.ndarray, layers: list, output: str) -> list[np.ndarray]:
    """Activations of every layer; ReLU inside, ``output`` at the end."""
    seen = [x]
    for i, (weight, bias) in enumerate(layers):
        z = seen[-1] @ weight + bias
        seen.append(np.maximum(z, 0.0) if i < len(layers) - 1 else _finish(z, output))
    return seen


def gradient(x: np.ndarray, layers: list, output: str) -> tuple[np.ndarray, float]:
    """Gradient and value of the summed squared error."""
    seen = forward(x, layers, output)
    gap = seen[-1] - x
    delta = 2.0 * gap
    if output == "sigmoid":
        delta = delta * seen[-1] * (1.0 - seen[-1])
    parts: list[np.ndarray] = []
    for i in range(len(layers) - 1, -1, -1):
        parts = [(seen[i].T @ delta).ravel(), delta.sum(axis=0), *parts]
        if i:
            delta = (delta @ layers[i][0].T) * (seen[i] > 0)
    return np.concatenate(parts), float((gap * gap).sum())


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    flat = batch.column("features").flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(batch.num_rows, dim)


class Autoencoder(Detector):
    kind = "autoencoder"

    def __init__(
        self, hidden: tuple[int, ...] = (16, 8, 16), epochs: int = 50, lr: float = 0.01,
        metric: str = "mse", output: str = "linear", seed: int = 42, batch_size: int | None = None, shards: int = 8,
    ):
        self.hidden = tuple(hidden)
        self.epochs = epochs
        self.lr = lr
        self.metric = metric
        self.output = output
        self.seed = seed
        self.batch_size = batch_size
        self.shards = shards

    def _features(self, df: DataFrame, dim: int | None = None) -> DataFrame:
        if "features" not in df.columns:
            df = numeric_features(df)
        wide = F.col("features").cast("array<double>")
        return df.withColumn("features", align_dim(wide, dim) if dim else wide)

    def _gradient(self, dim: int) -> training.Gradient:
        hidden, output = self.hidden, self.output

        def of_batch(flat: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, float, float]:
            layers, x = unpack(flat, dim, hidden), _matrix(batch, dim)
            total, loss = np.zeros(len(flat)), 0.0
            for at in range(0, len(x), _BLOCK):
                g, e = gradient(x[at : at + _BLOCK], layers, output)
                total, loss = total + g, loss + e
            return total, loss, float(len(x) * dim)

        return of_batch

    def fit(self, df: DataFrame, params: dict | None = None) -> Artifact:
        for name, value in (params or {}).items():
            setattr(self, name, tuple(value) if name == "hidden" else value)
        raw = written(self._features(df).select("features"), "features")
        head = raw.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("dim")).first()
        n, dim = head["n"], head["dim"]
        if not n:
            raise ValueError("no rows to fit")
        # Shorter rows are padded to the widest one.
        rows = raw.select(align_dim(F.col("features"), dim).alias("features"))
        flat = start_weights(dim, self.hidden, self.seed)
        if self.batch_size:
            flat, losses = training.mini_batches(rows, self._gradient(dim), flat, self.epochs, self.lr, self.batch_size, self.shards)
        else:
            flat, losses = training.full_batch(rows, self._gradient(dim), flat, self.epochs, self.lr)
        spark = df.sparkSession
        weights = spark.createDataFrame(
            [(i, float(w)) for i, w in enumerate(flat)], "pos int, weight double"
        )
        settings = {
            "dim": int(dim), "hidden": list(self.hidden), "output": self.output,
            "metric": self.metric, "losses": losses,
        }
        artifact = Artifact(self.kind, settings, {"weights": weights})
        errors = written(self.errors(rows, artifact).select("error"), "errors")
        settings["threshold"] = percentiles(errors, "error", {"t": 0.95}).first()["t"]
        return artifact

    def errors(self, df: DataFrame, artifact: Artifact) -> DataFrame:
        """Add the reconstruction ``error`` of every row; features are cut or padded to fit."""
        dim, hidden = artifact.params["dim"], tuple(artifact.params["hidden"])
        output, metric = artifact.params["output"], artifact.params["metric"]
        flat = artifact.tables["weights"].toPandas().sort_values("pos")["weight"].to_numpy()
        df = self._features(df, dim)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            layers = unpack(flat, dim, hidden)
            for batch in batches:
                x = _matrix(batch, dim)
                gap = forward(x, layers, output)[-1] - x
                error = (gap * gap if metric == "mse" else np.abs(gap)).mean(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(error)], names=[*batch.schema.names, "error"]
                )

        layout = T.StructType([*df.schema.fields, T.StructField("error", T.DoubleType())])
        return df.mapInArrow(run, layout)

    def score(self, df: DataFrame, artifact: Artifact) -> DataFrame:
        metric = artifact.params["metric"]
        out = reconstruction_risk(self.errors(df, artifact), "error", metric)
        return (
            out.withColumn("is_anomaly", F.col("error") > F.lit(artifact.params["threshold"]))
            .withColumn("details", F.to_json(F.struct(F.col("error").alias(metric))))
            .drop("features")
        )
