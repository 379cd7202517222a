"""Odd sequences by the error of a gated recurrent autoencoder over windows of each entity's rows.

An encoder reads a window step by step into one code; a decoder unrolls the code
into the same number of steps. Both are gated recurrent units, trained by
back-propagation through time on Arrow batches of windows, with gradients summed
by Spark. Windows are cut by position within the entity and grouped by entity and
window, so an entity with any share of the rows is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scan import running
from ..session import written
from . import training
from .base import Artifact, Detector
from .risk import reconstruction_risk

#: Windows whose activations are held at once.
_BLOCK = 512
_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


class Gru:
    """A layer of gated recurrent units over padded windows; a padded step keeps the state."""

    def __init__(self, inputs: int, hidden: int):
        self.inputs, self.hidden = inputs, hidden
        self.size = (inputs + hidden + 1) * 3 * hidden

    def start(self, rng: np.random.Generator) -> np.ndarray:
        w = rng.uniform(-1, 1, (self.inputs, 3 * self.hidden)) / np.sqrt(self.inputs + self.hidden)
        u = rng.uniform(-1, 1, (self.hidden, 3 * self.hidden)) / np.sqrt(self.hidden)
        return np.concatenate([w.ravel(), u.ravel(), np.zeros(3 * self.hidden)])

    def _parts(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        wide = 3 * self.hidden
        a, b = self.inputs * wide, (self.inputs + self.hidden) * wide
        return flat[:a].reshape(self.inputs, wide), flat[a:b].reshape(self.hidden, wide), flat[b:]

    def forward(self, flat: np.ndarray, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        """States after each step (windows, steps, hidden), and what the way back needs."""
        w, u, b = self._parts(flat)
        n = self.hidden
        h, states, kept = np.zeros((len(x), n)), [], []
        for t in range(x.shape[1]):
            m = mask[:, t : t + 1]
            given = x[:, t] @ w + b
            gates = _sigmoid(given[:, : 2 * n] + h @ u[:, : 2 * n])
            update, reset = gates[:, :n], gates[:, n:]
            fresh = np.tanh(given[:, 2 * n :] + (reset * h) @ u[:, 2 * n :])
            kept.append((h, update, reset, fresh, m))
            h = h + m * update * (fresh - h)
            states.append(h)
        return np.stack(states, axis=1), kept

    def backward(self, flat: np.ndarray, x: np.ndarray, kept: list, d_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the weights and of the inputs, given those of the states."""
        w, u, _ = self._parts(flat)
        n = self.hidden
        dw, du, db = np.zeros_like(w), np.zeros_like(u), np.zeros(3 * n)
        dx, carried = np.zeros_like(x), np.zeros((len(x), n))
        for t in range(x.shape[1] - 1, -1, -1):
            h, update, reset, fresh, m = kept[t]
            d = d_states[:, t] + carried
            d_update = d * m * (fresh - h) * update * (1 - update)
            d_fresh = d * m * update * (1 - fresh * fresh)
            d_held = d_fresh @ u[:, 2 * n :].T
            d_reset = d_held * h * reset * (1 - reset)
            d_gates = np.concatenate([d_update, d_reset], axis=1)
            d_given = np.concatenate([d_gates, d_fresh], axis=1)
            dw += x[:, t].T @ d_given
            db += d_given.sum(axis=0)
            du[:, : 2 * n] += h.T @ d_gates
            du[:, 2 * n :] += (reset * h).T @ d_fresh
            dx[:, t] = d_given @ w.T
            carried = d * (1 - m * update) + d_gates @ u[:, : 2 * n].T + d_held * reset
        return np.concatenate([dw.ravel(), du.ravel(), db]), dx


class Network:
    """Encoder, decoder and a linear output per step."""

    def __init__(self, width: int, hidden: int):
        self.width, self.hidden = width, hidden
        self.encoder, self.decoder = Gru(width, hidden), Gru(hidden, hidden)
        self.size = self.encoder.size + self.decoder.size + (hidden + 1) * width

    def start(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        out = rng.uniform(-1, 1, (self.hidden, self.width)) / np.sqrt(self.hidden)
        return np.concatenate([self.encoder.start(rng), self.decoder.start(rng), out.ravel(), np.zeros(self.width)])

    def _split(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a = self.encoder.size
        b = a + self.decoder.size
        c = b + self.hidden * self.width
        return flat[:a], flat[a:b], flat[b:c].reshape(self.hidden, self.width), flat[c:]

    def rebuilt(self, flat: np.ndarray, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        encoder, decoder, out, bias = self._split(flat)
        states, seen = self.encoder.forward(encoder, x, mask)
        code = np.repeat(states[:, -1:], x.shape[1], axis=1)
        unrolled, told = self.decoder.forward(decoder, code, mask)
        return unrolled @ out + bias, (seen, code, unrolled, told)

    def gradient(self, flat: np.ndarray, x: np.ndarray, mask: np.ndarray, metric: str) -> tuple[np.ndarray, float, float]:
        """Summed gradient and error over all steps that are not padding, and their number."""
        encoder, decoder, out, _ = self._split(flat)
        found, (seen, code, unrolled, told) = self.rebuilt(flat, x, mask)
        gap = (found - x) * mask[:, :, None]
        if metric == "mae":
            loss, d = float(np.abs(gap).sum() / self.width), np.sign(gap) / self.width
        else:
            loss, d = float((gap * gap).sum() / self.width), 2 * gap / self.width
        d_out = np.einsum("bth,btf->hf", unrolled, d)
        d_decoder, d_code = self.decoder.backward(decoder, code, told, d @ out.T)
        d_states = np.zeros((len(x), x.shape[1], self.hidden))
        d_states[:, -1] = d_code.sum(axis=1)
        d_encoder, _ = self.encoder.backward(encoder, x, seen, d_states)
        return np.concatenate([d_encoder, d_decoder, d_out.ravel(), d.sum(axis=(0, 1))]), loss, float(mask.sum())

    def errors(self, flat: np.ndarray, x: np.ndarray, mask: np.ndarray, metric: str) -> np.ndarray:
        """Mean error of each window over its own steps."""
        gap = (self.rebuilt(flat, x, mask)[0] - x) * mask[:, :, None]
        total = np.abs(gap) if metric == "mae" else gap * gap
        return total.sum(axis=(1, 2)) / (np.maximum(mask.sum(axis=1), 1) * self.width)


def padded(steps: pa.ListArray, length: int, mean: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled windows (windows, length, width) and which of their steps are real; a missing number is the mean."""
    rows = steps.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = steps.flatten().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(mean))
    values = np.nan_to_num((values - mean) / spread, nan=0.0, posinf=0.0, neginf=0.0)
    mask = np.arange(length) < rows[:, None]
    x = np.zeros((len(rows), length, len(mean)))
    x[mask] = values
    return x, mask.astype(float)


class SequenceDetector(Detector):
    """Risk of each window of ``length`` rows of an entity, one beginning every ``step`` rows.

    ``columns`` are the numbers of a row (all numeric columns if not given), ``order`` the columns
    that order an entity's rows; rows equal in both are interchangeable. Rows with a null entity are
    an entity like any other. With ``batch_size`` the weights are trained in rounds of mini-batches.
    """

    kind = "sequence"

    def __init__(self, entity: str = "entity_id", order: tuple[str, ...] = ("timestamp",), columns: list[str] | None = None,
                 length: int = 32, step: int = 16, hidden: int = 16, epochs: int = 20, lr: float = 0.02, metric: str = "mae",
                 seed: int = 42, batch_size: int | None = None, shards: int = 8):
        if not 0 < step <= length:
            raise ValueError("a step must be between 1 and the window length")
        self.entity, self.order, self.columns = entity, tuple(order), columns
        self.length, self.step, self.hidden, self.epochs, self.lr = length, step, hidden, epochs, lr
        self.metric, self.seed, self.batch_size, self.shards = metric, seed, batch_size, shards

    def _columns(self, df: DataFrame) -> list[str]:
        outside = {self.entity, *self.order}
        names = self.columns or [f.name for f in df.schema if isinstance(f.dataType, _NUMBERS) and f.name not in outside]
        if not names:
            raise ValueError("no numeric columns")
        return names

    def windows(self, df: DataFrame) -> DataFrame:
        """``entity_id, window, first_at, last_at, rows, steps``; the last window of an entity may be shorter.

        Windows overlap by ``length - step`` rows. One is left out if all its rows are in the one before.
        """
        length, step = self.length, self.step
        order = [f"o{i}" for i in range(len(self.order))]
        rows = df.select(
            F.col(self.entity).cast("string").alias("entity_id"), *[F.col(c).alias(o) for c, o in zip(self.order, order)],
            F.array(*[F.col(c).cast("double") for c in self._columns(df)]).alias("x"), F.lit(1).cast("long").alias("one"))
        rows = running(rows, ["entity_id"], [*order, "x"], sums={"pos": "one"}).withColumn("pos", F.col("pos") - 1)
        first = F.greatest(F.floor((F.col("pos") - length) / step) + 1, F.lit(0))
        members = rows.select("entity_id", "o0", "pos", "x", F.explode(F.sequence(first, F.floor(F.col("pos") / step))).alias("window"))
        # At most ``length`` rows meet in a window.
        found = members.groupBy("entity_id", "window").agg(
            F.min("o0").alias("first_at"), F.max("o0").alias("last_at"), F.max("pos").alias("end"),
            F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("steps"))
        fresh = (F.col("window") == 0) | (F.col("end") >= (F.col("window") - 1) * step + length)
        return found.where(fresh).select(
            "entity_id", "window", "first_at", "last_at", F.size("steps").alias("rows"), F.transform("steps", lambda s: s["x"]).alias("steps"))

    def fit(self, df: DataFrame, params: dict | None = None) -> Artifact:
        for name, value in (params or {}).items():
            setattr(self, name, value)
        columns = self._columns(df)
        values = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns]
        facts = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)],
                       *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(values)]).first()
        mean = [facts[f"m{i}"] or 0.0 for i in range(len(columns))]
        spread = [facts[f"s{i}"] or 1.0 for i in range(len(columns))]
        windows = written(self.windows(df), "windows").select("steps")
        if windows.isEmpty():
            raise ValueError("no rows to fit")
        network, length, metric = Network(len(columns), self.hidden), self.length, self.metric
        at, width = np.array(mean), np.array(spread)

        def gradient(flat: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, float, float]:
            total, loss, weight = np.zeros(len(flat)), 0.0, 0.0
            for start in range(0, batch.num_rows, _BLOCK):
                x, mask = padded(batch.slice(start, _BLOCK).column("steps"), length, at, width)
                g, e, n = network.gradient(flat, x, mask, metric)
                total, loss, weight = total + g, loss + e, weight + n
            return total, loss, weight

        flat = network.start(self.seed)
        if self.batch_size:
            flat, losses = training.mini_batches(windows, gradient, flat, self.epochs, self.lr, self.batch_size, self.shards)
        else:
            flat, losses = training.full_batch(windows, gradient, flat, self.epochs, self.lr)
        weights = df.sparkSession.createDataFrame([(i, float(w)) for i, w in enumerate(flat)], "pos int, weight double")
        settings = {"columns": columns, "mean": mean, "spread": spread, "hidden": self.hidden, "length": self.length,
                    "step": self.step, "metric": self.metric, "losses": losses}
        return Artifact(self.kind, settings, {"weights": weights})

    def errors(self, df: DataFrame, artifact: Artifact) -> DataFrame:
        """``error`` of every window of ``df``."""
        p = artifact.params
        self.columns, self.length, self.step = p["columns"], p["length"], p["step"]
        network, length, metric = Network(len(p["columns"]), p["hidden"]), p["length"], p["metric"]
        mean, spread = np.array(p["mean"]), np.array(p["spread"])
        rows = artifact.tables["weights"].collect()
        flat = np.zeros(network.size)
        flat[[r["pos"] for r in rows]] = [r["weight"] for r in rows]
        windows = self.windows(df)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                error = np.zeros(batch.num_rows)
                for start in range(0, batch.num_rows, _BLOCK):
                    x, mask = padded(batch.slice(start, _BLOCK).column("steps"), length, mean, spread)
                    error[start : start + _BLOCK] = network.errors(flat, x, mask, metric)
                kept = batch.drop_columns(["steps"])
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(error)], names=[*kept.schema.names, "error"])

        fields = [f for f in windows.schema if f.name != "steps"]
        return windows.mapInArrow(run, T.StructType([*fields, T.StructField("error", T.DoubleType())]))

    def score(self, df: DataFrame, artifact: Artifact) -> DataFrame:
        out = reconstruction_risk(self.errors(df, artifact), "error", artifact.params["metric"])
        details = F.to_json(F.struct("window", "rows", "first_at", F.col("error").alias(artifact.params["metric"])))
        return out.withColumn("details", details).withColumn("timestamp", F.col("last_at"))
