"""Document quality by attention over passages (multiple-instance learning).

A document is a bag of passages. Every passage is encoded from hashed word
shapes and endings; gated attention, learned from document labels only, weighs
the passages; the weighted sum gives the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..detect import training
from ..session import written
from .common import SMALL_BYTES, SMALL_ROWS, WORD_LIMIT, arrow_map, prepare

PASSAGE = 100  # words
SHAPES, ENDINGS = 192, 320
WIDTH = SHAPES + ENDINGS
#: Labelled rows to learn from (those of smallest hash), with all their passages.
FIT_ROWS = 4_000
#: Rounds of local steps over the sample, rows of a step, shards that step side by side.
ROUNDS, STEP_ROWS, SHARDS = 16, 32, 4
#: Passages of one step whose activations are held at once, unless one text has more.
STEP_PASSAGES = 8_192


def word_codes(word: bytes) -> tuple[int, int]:
    """Hash buckets of a word's shape and of its case-free last three bytes.

    The shape has one sign, at most twice in a row, for a run of one kind; only its first 24 signs are a feature.
    """
    import xxhash

    shape = re.sub(rb"[a-z\x80-\xff]+", b"a", re.sub(rb"[A-Z]+", b"A", re.sub(rb"[0-9]+", b"0", word)))
    shape = re.sub(rb"(.)\1+", rb"\1\1", shape)[:24]
    return (xxhash.xxh32_intdigest(shape) % SHAPES, SHAPES + xxhash.xxh32_intdigest(word.lower()[-3:], 1) % ENDINGS)


class Bags:
    """Passages of texts as count vectors, built for a whole batch."""

    def __init__(self, limit: int = WORD_LIMIT):
        self.limit, self.codes = limit, {}

    def passages(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of root-scaled shares, one per passage, and the passages of each text; an empty text has one empty passage."""
        if len(self.codes) > self.limit:
            self.codes.clear()
        codes, sizes, flat = self.codes, [], []
        for text in texts:
            words = (text or "").encode().split()
            sizes.append(len(words))
            try:
                flat.append(np.fromiter((codes[w] for w in words), np.int64, len(words)))
            except KeyError:
                for w in words:
                    if w not in codes:
                        a, b = word_codes(w)
                        codes[w] = a << 16 | b
                flat.append(np.fromiter((codes[w] for w in words), np.int64, len(words)))
        sizes = np.array(sizes, np.int64)
        number = np.maximum(1, -(-sizes // PASSAGE))
        first = np.cumsum(number) - number
        rows = int(number.sum())
        if not rows:
            return np.zeros((0, WIDTH), np.float32), number
        both = np.concatenate(flat)
        inside = np.arange(len(both)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        row = np.repeat(first, sizes) + inside // PASSAGE
        counts = np.bincount(row * WIDTH + (both >> 16), minlength=rows * WIDTH)
        counts += np.bincount(row * WIDTH + (both & 0xFFFF), minlength=rows * WIDTH)
        counts = counts.reshape(rows, WIDTH).astype(np.float32)
        return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)), number


class GatedAttention:
    """score = sigmoid(c . sum_i a_i h_i + d), a = softmax(w . (tanh(V h_i) * sigmoid(U h_i))), h_i = tanh(W x_i + b)."""

    def __init__(self, hidden: int = 24, inner: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        shapes = {"W": (WIDTH, hidden), "b": (hidden,), "V": (hidden, inner), "U": (hidden, inner), "w": (inner,),
                  "c": (hidden,), "d": (1,)}
        self.p = {k: (rng.standard_normal(s) / np.sqrt(s[0] if k != "W" else 8)).astype(np.float32) for k, s in shapes.items()}
        self.p["b"][:] = 0
        self.p["d"][:] = 0

    def forward(self, x: np.ndarray, number: np.ndarray) -> dict:
        p, first = self.p, np.cumsum(number) - number
        h = np.tanh(x @ p["W"] + p["b"])
        u, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (u * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), number))
        a = e / np.repeat(np.add.reduceat(e, first), number)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return {"h": h, "u": u, "g": g, "a": a, "z": z, "y": 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))}

    def gradients(self, x: np.ndarray, number: np.ndarray, y: np.ndarray) -> dict:
        p, f, first = self.p, self.forward(x, number), np.cumsum(number) - number
        h, u, g, a = f["h"], f["u"], f["g"], f["a"]
        off = (f["y"] - y) / len(y)
        dz = np.repeat(off[:, None] * p["c"], number, axis=0)
        da = (dz * h).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, first), number))
        du, dg = de[:, None] * p["w"] * g * (1 - u * u), de[:, None] * p["w"] * u * g * (1 - g)
        dh = (a[:, None] * dz + du @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ du, "U": h.T @ dg, "w": (u * g).T @ de,
                "c": f["z"].T @ off, "d": off.sum(keepdims=True)}

    @property
    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()]).astype(np.float64)

    def at(self, flat: np.ndarray) -> GatedAttention:
        """The same network at other weights."""
        start = 0
        for k, v in self.p.items():
            self.p[k] = flat[start : start + v.size].reshape(v.shape).astype(np.float32)
            start += v.size
        return self

    def score(self, x: np.ndarray, number: np.ndarray) -> np.ndarray:
        return self.forward(x, number)["y"].astype(float) if len(number) else np.zeros(0)


def learnable(labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """At most ``rows`` labelled ids outside the held-out third; several labels of one id count as the lowest."""
    known = labels.selectExpr("cast(doc_id as long) doc_id", "quality").filter("doc_id is not null and quality is not null")
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("_y"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit_classifier(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, rounds: int = ROUNDS,
                   decay: float = 1e-4) -> GatedAttention | None:
    """Learn from at most ``rows`` labelled documents, each with all its passages.

    The passages stay in a table and gradients are made in tasks; the driver holds weights only.
    Of several rows with one labelled id that of the least text hash counts. None when there are
    no labels of both kinds.
    """
    prepare(docs.sparkSession, SMALL_ROWS, SMALL_BYTES)

    def bags(batches):
        builder = Bags()
        for batch in batches:
            x, number = builder.passages(batch["text"].to_pylist())
            last = np.cumsum(number)
            yield {"_y": batch["_y"], "n": number.astype(np.int32), "x": [x[e - n : e].astype("<f2").tobytes() for e, n in zip(last, number)]}

    # The sample has a fixed bound, so it may be broadcast.
    sample = docs.selectExpr("cast(doc_id as long) doc_id", "text").join(F.broadcast(learnable(labels, rows)), "doc_id")
    sample = sample.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("_y").alias("_y"))
    table = written(arrow_map(sample.select("_y", "text"), "_y int, n int, x binary", bags), "passages")
    if table.agg(F.count_distinct("_y")).first()[0] < 2:
        return None

    def gradient(flat: np.ndarray, batch) -> tuple[np.ndarray, float, float]:
        model, total = GatedAttention().at(flat), decay * flat * batch.num_rows
        number = batch.column("n").to_numpy()
        for some in _blocks(number, STEP_PASSAGES):
            x = np.concatenate([np.frombuffer(batch.column("x")[i].as_py(), "<f2").reshape(-1, WIDTH) for i in some]).astype(np.float32)
            y = batch.column("_y").to_numpy()[some].astype(np.float32)
            found = model.gradients(x, number[some], y)
            total = total + np.concatenate([found[k].ravel() for k in model.p]) * float(len(some))
        return total, 0.0, float(batch.num_rows)

    model = GatedAttention()
    flat, _ = training.mini_batches(table, gradient, model.flat, rounds, 0.01, STEP_ROWS, SHARDS)
    return model.at(flat)


def _blocks(number: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Runs of rows with at most ``most`` passages together, or one row with more."""
    start, held = 0, 0
    for i, n in enumerate(number):
        if held and held + n > most:
            yield np.arange(start, i)
            start, held = i, 0
        held += int(n)
    if start < len(number):
        yield np.arange(start, len(number))


def score_texts(model: GatedAttention | None, builder: Bags, texts: list[str | None]) -> np.ndarray:
    """Scores from 0 to 1; without a model every text has 1."""
    if model is None:
        return np.ones(len(texts))
    return np.clip(model.score(*builder.passages(texts)), 0.0, 1.0)


def classify(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """``held_out``, ``score`` and ``predicted`` for every row's whole text.

    Null and empty texts are scored as one empty passage. Rows with a null id are
    never learned from and not held out. Repeated ids are scored row by row; other
    columns are ignored; an empty table gives no rows; without labels of both
    kinds every score is 1.
    """
    model = fit_classifier(docs, labels, rows)

    def run(batches):
        builder = Bags()
        for batch in batches:
            yield {"doc_id": batch["doc_id"], "score": score_texts(model, builder, batch["text"].to_pylist())}

    out = arrow_map(docs.selectExpr("cast(doc_id as long) doc_id", "text"), "doc_id long, score double", run)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, with their own columns."""
    model = fit_classifier(docs, labels, rows)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        builder = Bags()
        for text in batches:
            yield pd.Series(score_texts(model, builder, text.tolist()))

    return docs.filter(score("text") >= threshold)
