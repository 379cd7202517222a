"""Quality rules: boosted trees over document statistics.

Statistics are counted over whole texts; fixed base rules fail texts that are
too short or too repetitive, and gradient-boosted trees with monotonic
constraints judge the rest. The trees are flattened into numpy node arrays, so
that a batch of documents walks all trees level by level.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import SMALL_BYTES, SMALL_ROWS, WordIds, arrow_map, prepare

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Labelled rows that the trees are fitted on, at most (those of smallest hash).
FIT_ROWS = 20_000

SYMBOLS = "[#*$%&|<>]"  # fixed by the contract
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE_COUNTS = ["n_lines", "n_upper", "n_lower", "n_digits", "n_stops", "n_loud", "n_bare", "n_distinct"]
#: Feature -> direction in which a larger value may move the score (0: either).
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_rate": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": 0,
    "digit_rate": -1, "stop_rate": 0, "loud_rate": -1, "bare_share": -1, "distinct_share": 0, "line_words": 0,
}


def repeated_positions(ids: np.ndarray, size: int = 3) -> int:
    """Positions covered by windows of ``size`` words that occur twice or more."""
    n = len(ids) - size + 1
    if n < 2:
        return 0
    key = ids[:n]
    for k in range(1, size):
        nxt = ids[k : k + n]
        if int(key.max()) >= 1 << 41 or int(nxt.max()) >= 1 << 21:
            key = np.unique(key, return_inverse=True)[1]
            nxt = np.unique(nxt, return_inverse=True)[1]
        key = key * (int(nxt.max()) + 1) + nxt
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for k in range(size):
        covered[k : k + n] |= twice
    return int(covered.sum())


_CLASS = np.zeros(256, np.int64)
_BLANK = [0x20, *range(0x09, 0x0E)]
_CLASS[_BLANK] = 1
_CLASS[0x80:0xC0] = 2  # the later bytes of a character
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 3
_CLASS[ord("A") : ord("Z") + 1] = 4
_CLASS[ord("a") : ord("z") + 1] = 5
_CLASS[ord("0") : ord("9") + 1] = 6
_CLASS[ord(".")] = 7
_CLASS[ord("!")] = 8


def text_counts(text: str | None, numbers: WordIds) -> tuple[int, ...]:
    """``COUNTS`` and ``MORE_COUNTS`` of one whole text."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return (0,) * 13
    kinds = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=9)
    ids = numbers.number(words)
    lines = [line for line in data.split(b"\n") if line.split(None, 1)]
    bare = sum(len(w) <= 3 and not w.isalnum() and w.isascii() for w in words)
    return (
        len(words), len(data) - int(kinds[1] + kinds[2]), int(kinds[3]), len(lines) - len(set(lines)),
        repeated_positions(ids), len(lines), int(kinds[4]), int(kinds[5]), int(kinds[6]), int(kinds[7]),
        int(kinds[8]), bare, len(np.unique(ids)),
    )


def document_statistics(docs: DataFrame) -> DataFrame:
    """Counts for each row; words are runs of anything but the six ASCII blanks, null text has none."""

    def run(batches):
        numbers = WordIds()
        for batch in batches:
            rows = [text_counts(t, numbers) for t in batch["text"].to_pylist()]
            yield {"doc_id": batch["doc_id"]} | dict(zip(COUNTS + MORE_COUNTS, list(zip(*rows)) or [[]] * 13))

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS + MORE_COUNTS)
    return arrow_map(docs.selectExpr("cast(doc_id as long) doc_id", "text"), schema, run)


def feature_matrix(c: pd.DataFrame) -> np.ndarray:
    words = np.maximum(c["n_words"].to_numpy(float), 1)
    lines = np.maximum(c["n_lines"].to_numpy(float), 1)
    letters = np.maximum((c["n_upper"] + c["n_lower"]).to_numpy(float), 1)
    rate = lambda name, by: c[name].to_numpy(float) / by
    return np.column_stack([
        np.log1p(c["n_words"].to_numpy(float)), rate("word_chars", words), rate("n_symbols", words),
        rate("n_dup_lines", lines), rate("n_repeat_words", words), rate("n_upper", letters), rate("n_digits", words),
        rate("n_stops", words), rate("n_loud", words), rate("n_bare", words), rate("n_distinct", words),
        words / lines,
    ])


class BoostedTrees:
    """Logistic boosting on binned features; a tree of depth d is one row of 2^(d+1)-1 heap-ordered nodes."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 1.0,
                 constraints: tuple[int, ...] = ()):
        self.trees, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2
        self.constraints = constraints
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        signs = np.array(self.constraints or [0] * width)
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(width)]
        binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
        nodes = 2 ** (self.depth + 1) - 1
        self.feature = np.zeros((self.trees, nodes), np.int64)
        self.threshold = np.full((self.trees, nodes), np.inf)
        self.value = np.zeros((self.trees, nodes))
        share = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(n, self.base)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
            at = np.zeros(n, np.int64)
            limits = {0: (-np.inf, np.inf)}
            for node in range(2**self.depth - 1):
                if node not in limits:
                    continue
                rows = np.flatnonzero(at == node)
                low, high = limits[node]
                self.value[t, node] = self._leaf(grad[rows].sum(), hess[rows].sum(), low, high)
                best = self._split(binned[rows], grad[rows], hess[rows], edges, signs, low, high)
                if best is None:
                    continue
                j, b, left, right = best
                self.feature[t, node], self.threshold[t, node] = j, edges[j][b]
                goes_right = binned[rows, j] > b
                at[rows] = 2 * node + 1 + goes_right
                middle = (left + right) / 2
                kinds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high),) * 2}
                for side, bounds in enumerate(kinds[int(signs[j])]):
                    limits[2 * node + 1 + side] = bounds
                    self.value[t, 2 * node + 1 + side] = (left, right)[side]
            margin = margin + self.rate * self.value[t, at]
        # A node without a split hands its value down, so that every walk has the full depth.
        for node in range(2**self.depth - 1):
            dead = np.isinf(self.threshold[:, node])
            self.value[dead, 2 * node + 1] = self.value[dead, node]
            self.value[dead, 2 * node + 2] = self.value[dead, node]
        return self

    def _leaf(self, grad: float, hess: float, low: float, high: float) -> float:
        return float(np.clip(-grad / (hess + self.l2), low, high))

    def _split(self, binned, grad, hess, edges, signs, low, high):
        g_all, h_all = grad.sum(), hess.sum()
        worth = lambda g, h, v: -(g * v + 0.5 * (h + self.l2) * v * v)
        top, best = 1e-6 + worth(g_all, h_all, self._leaf(g_all, h_all, low, high)), None
        for j, e in enumerate(edges):
            if not len(e):
                continue
            g = np.cumsum(np.bincount(binned[:, j], grad, len(e) + 1))[:-1]
            h = np.cumsum(np.bincount(binned[:, j], hess, len(e) + 1))[:-1]
            left = np.clip(-g / (h + self.l2), low, high)
            right = np.clip(-(g_all - g) / (h_all - h + self.l2), low, high)
            gain = worth(g, h, left) + worth(g_all - g, h_all - h, right)
            gain[(h < 0.5) | (h_all - h < 0.5) | (signs[j] * (right - left) < 0)] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] > top:
                top, best = gain[b], (j, b, float(left[b]), float(right[b]))
        return best

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1, all trees and rows at once, level by level."""
        tree = np.arange(self.trees)[None, :]
        node = np.zeros((len(x), self.trees), np.int64)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        margin = self.base + self.rate * self.value[tree, node].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def fit_rules(statistics: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> BoostedTrees | None:
    """Trees from a bounded sample of labelled rows; None when the labels are of one kind only.

    Rows whose ``crc32(doc_id)`` leaves 1 modulo 3 stay out, for held-out tests. A
    document with several labels takes the lowest.
    """
    known = labels.selectExpr("cast(doc_id as long) doc_id", "quality").filter("quality is not null")
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).groupBy("doc_id").agg(F.min("quality").alias("_y"))
    sample = (
        statistics.join(known, "doc_id").filter(f"n_words >= {MIN_WORDS}")
        .orderBy(F.xxhash64("doc_id"), "doc_id", *COUNTS).limit(rows).toPandas()
    )
    if sample["_y"].nunique() < 2:
        return None
    return BoostedTrees(constraints=tuple(FEATURES.values())).fit(feature_matrix(sample), sample["_y"].to_numpy(float))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rows: int = FIT_ROWS) -> DataFrame:
    """Statistics, ``base_failed``, ``score`` and ``kept`` for every row.

    Null or empty text has no words and fails the base rules. Without usable
    labels only the base rules decide (``score`` is 1). Null and repeated ids are
    judged row by row; other columns are ignored; an empty table gives no rows.
    """
    prepare(docs.sparkSession, SMALL_ROWS, SMALL_BYTES)
    statistics = written(document_statistics(docs), "statistics")
    model = fit_rules(statistics, labels, rows)

    def run(batches):
        for batch in batches:
            counts = pd.DataFrame({c: batch[c].to_numpy() for c in COUNTS + MORE_COUNTS})
            score = model.score(feature_matrix(counts)) if model and len(counts) else np.ones(len(counts))
            yield {c: batch[c] for c in ["doc_id", *COUNTS]} | {"score": score}

    out = arrow_map(statistics, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double", run)
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words")
    )
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rows: int = FIT_ROWS,
         fit_on: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns.

    The verdict is computed beside the row, so repeated or null ids need no join. The trees are
    fitted on ``fit_on`` (by default ``docs``): give the whole labelled documents where ``docs``
    is what another filter has left of them. Without labels of both kinds there are no trees;
    the base rules then decide alone, and a warning says so.
    """
    prepare(docs.sparkSession, SMALL_ROWS, SMALL_BYTES)
    model = fit_rules(document_statistics(docs if fit_on is None else fit_on), labels, rows)
    if model is None:
        warnings.warn("no labels of both kinds among the documents: only the base rules decide", stacklevel=2)
    counts = COUNTS + MORE_COUNTS

    @F.pandas_udf("boolean")
    def kept(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        numbers = WordIds()
        for text in batches:
            c = pd.DataFrame([text_counts(t, numbers) for t in text], columns=counts)
            good = (c["n_words"] >= MIN_WORDS) & (100 * c["n_repeat_words"] <= MAX_REPEAT_PERCENT * c["n_words"])
            yield good & (model.score(feature_matrix(c)) >= threshold) if model and len(c) else good

    return docs.filter(kept("text"))
