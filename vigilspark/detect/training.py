"""Gradient training over partitions: weights go out in a closure, sums come back one row per weight.

A model is given as ``gradient(flat, batch)``: the summed gradient and loss of an
Arrow batch at the flat weights, and how much data it weighs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Gradient = Callable[[np.ndarray, pa.RecordBatch], tuple[np.ndarray, float, float]]

_LAYOUT = "pos int, v double"


class Adam:
    """Adam with its usual constants."""

    def __init__(self, size: int, lr: float):
        self.lr, self.step = lr, 0
        self.first, self.second = np.zeros(size), np.zeros(size)

    def moved(self, flat: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.step += 1
        self.first = 0.9 * self.first + 0.1 * g
        self.second = 0.999 * self.second + 0.001 * g * g
        scale = np.sqrt(self.second / (1 - 0.999**self.step)) + 1e-8
        return flat - self.lr * (self.first / (1 - 0.9**self.step)) / scale


def _vector(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["pos", "v"])


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of all partial vectors; as many rows reach the driver as a vector is long."""
    out = np.zeros(size)
    for row in parts.groupBy("pos").agg(F.sum("v").alias("v")).collect():
        out[row["pos"]] = row["v"]
    return out


def gradient_sum(rows: DataFrame, gradient: Gradient, flat: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Gradient, loss and weight summed over all rows, in one job."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(flat) + 2)
        for batch in batches:
            if batch.num_rows:
                g, loss, weight = gradient(flat, batch)
                total += np.concatenate([g, [loss, weight]])
        yield _vector(total)

    total = _summed(rows.mapInArrow(partial, _LAYOUT), len(flat) + 2)
    return total[:-2], float(total[-2]), float(total[-1])


def full_batch(rows: DataFrame, gradient: Gradient, flat: np.ndarray, epochs: int, lr: float) -> tuple[np.ndarray, list[float]]:
    """One step over all rows per epoch; also returns the loss before each step."""
    adam, losses = Adam(len(flat), lr), []
    for _ in range(epochs):
        g, loss, weight = gradient_sum(rows, gradient, flat)
        losses.append(loss / weight)
        flat = adam.moved(flat, g / weight)
    return flat, losses


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows sorted by ``_shard``, as pieces of exactly ``size`` rows of one shard (the last of a shard may be shorter)."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        shard = held.column("_shard").to_numpy()
        ends = np.append(np.flatnonzero(shard[1:] != shard[:-1]) + 1, len(shard))
        at = 0
        for end in ends:
            while end - at >= size or (end < len(shard) and at < end):
                take = min(size, end - at)
                yield int(shard[at]), held.slice(at, take).combine_chunks().to_batches()[0]
                at += take
        held = held.slice(at) if at < len(shard) else None
    if held is not None and held.num_rows:
        yield held.column("_shard")[0].as_py(), held.combine_chunks().to_batches()[0]


def mini_batches(
    rows: DataFrame, gradient: Gradient, flat: np.ndarray, rounds: int, lr: float, batch_size: int = 32, shards: int = 8,
) -> tuple[np.ndarray, list[float]]:
    """Local steps with averaged weights.

    Rows belong to a shard, and follow each other in it, by the hash of their content, so the
    file layout does not matter. Every round each shard starts from the common weights and makes
    one Adam step per ``batch_size`` rows; the shards' weights are averaged by their data.
    Returns the mean loss met in each round as well. A task holds one mini-batch at a time; a round
    brings the driver one packed vector of weights per shard.
    """
    names = rows.columns
    digest = F.xxhash64(*names)
    placed = rows.withColumn("_shard", F.pmod(digest, F.lit(shards)).cast("int")).withColumn("_at", F.xxhash64(digest, F.lit(1)))
    placed = placed.repartition("_shard").sortWithinPartitions("_shard", "_at", *names)
    losses = []
    for _ in range(rounds):
        start = flat

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            current, at, adam, loss, weight = None, start, None, 0.0, 0.0

            def closed() -> pa.RecordBatch:
                out = np.concatenate([at * weight, [loss, weight]]).astype("<f8")
                return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["shard", "v"])

            for shard, piece in _pieces(batches, batch_size):
                if shard != current:
                    if adam:
                        yield closed()
                    current, at, adam, loss, weight = shard, start, Adam(len(start), lr), 0.0, 0.0
                g, more, w = gradient(at, piece.drop_columns(["_shard", "_at"]))
                at, loss, weight = adam.moved(at, g / w), loss + more, weight + w
            if adam:
                yield closed()

        total = np.zeros(len(start) + 2)
        # Shards are added in their order, so that the sum is the same every time.
        for row in sorted(placed.mapInArrow(local, "shard int, v binary").collect()):
            total += np.frombuffer(row["v"], "<f8")
        flat = total[:-2] / total[-1]
        losses.append(float(total[-2] / total[-1]))
    return flat, losses
