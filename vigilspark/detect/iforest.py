"""Isolation forest (Liu, Ting, Zhou 2008) fitted and scored on Spark.

Fitting reads the data once to draw a small sample by hashing a row key, so the
same rows give the same forest however they are partitioned. Trees are built in
parallel from at most ``max_samples`` rows each. Scoring is one pass of Arrow
batches through the forest, which has a size fixed by its parameters.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.features import numeric_features
from ..operators.scan import percentiles
from ..session import written
from .base import Artifact, Detector
from .risk import outlier_risk

_NODES = "tree int, node int, feature int, split double, left int, right int, path double"
_EULER = 0.5772156649015329


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + _EULER) - 2.0 * (n - 1.0) / n


def grow(points: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes of one tree; a leaf has feature -1 and the path length it stands for."""
    nodes: list[tuple] = []
    work = [(0, np.arange(len(points)), 0)]
    created = 1
    while work:
        node, rows, depth = work.pop()
        block = points[rows]
        low, high = block.min(axis=0), block.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            nodes.append((node, -1, 0.0, -1, -1, depth + average_path(len(rows))))
            continue
        feature = int(rng.choice(usable))
        split = float(rng.uniform(low[feature], high[feature]))
        goes_left = block[:, feature] <= split
        left, right = created, created + 1
        created += 2
        nodes.append((node, feature, split, left, right, 0.0))
        work += [(left, rows[goes_left], depth + 1), (right, rows[~goes_left], depth + 1)]
    return nodes


def forest_arrays(nodes: pd.DataFrame) -> list[dict[str, np.ndarray]]:
    trees = []
    for _, tree in nodes.sort_values(["tree", "node"]).groupby("tree"):
        trees.append({c: tree[c].to_numpy() for c in ("feature", "split", "left", "right", "path")})
    return trees


def mean_depth(points: np.ndarray, trees: list[dict[str, np.ndarray]]) -> np.ndarray:
    """Mean path length of each point over all trees."""
    total = np.zeros(len(points))
    row = np.arange(len(points))
    for tree in trees:
        at = np.zeros(len(points), dtype=np.int64)
        while True:
            feature = tree["feature"][at]
            inner = feature >= 0
            if not inner.any():
                break
            value = points[row, np.maximum(feature, 0)]
            below = np.where(value <= tree["split"][at], tree["left"][at], tree["right"][at])
            at = np.where(inner, below, at)
        total += tree["path"][at]
    return total / max(len(trees), 1)


def prefix_depths(points: np.ndarray, trees: list[dict[str, np.ndarray]], sizes: list[int]) -> np.ndarray:
    """Mean path lengths over the first trees, one column per number of trees; each tree is walked once."""
    out, total, done = np.zeros((len(points), len(sizes))), np.zeros(len(points)), 0
    for i in np.argsort(sizes):
        more = trees[done : sizes[i]]
        total = total + mean_depth(points, more) * len(more)
        done = max(done, min(sizes[i], len(trees)))
        out[:, i] = total / max(done, 1)
    return out


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends only on the given values."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / float(1 << 53)


def _pool(share: float):
    """Keeps each row with probability ``share``, decided by its mark.

    Rows are drawn, not keys or distinct values: of equal rows within a batch the first has
    the mark of its content, the others one of their place. So distinct rows are drawn alike
    under any partitioning, and a row that fills batches has its share of the pool.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = np.uint64(TaskContext.get().partitionId() << 40)
        for batch in batches:
            mark = batch.column("_copy").to_numpy().view(np.uint64)
            first = np.zeros(len(mark), bool)
            first[np.unique(mark, return_index=True)[1]] = True
            place = at + np.arange(1, len(mark) + 1, dtype=np.uint64)
            at = at + np.uint64(len(mark))
            copy = np.where(first, mark, _mixed(mark ^ _mixed(place)))
            kept = np.flatnonzero((_mixed(copy) >> np.uint64(11)) < share * float(1 << 53))
            if len(kept):
                some = batch.take(pa.array(kept))
                yield pa.RecordBatch.from_arrays([some.column("_k"), some.column("features"), pa.array(copy[kept].view(np.int64))], names=["_k", "features", "_copy"])

    return run


def _mixed(x: np.ndarray) -> np.ndarray:
    """One round of a public 64-bit mixing function."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class IsolationForest(Detector):
    kind = "isolation_forest"

    def __init__(
        self, n_estimators: int = 100, contamination: float = 0.1,
        max_samples: int | str = "auto", seed: int = 42, key: str = "entity_id",
    ):
        self.n_estimators = n_estimators
        self.contamination = contamination
        self.max_samples = max_samples
        self.seed = seed
        self.key = key

    def _features(self, df: DataFrame) -> DataFrame:
        if "features" in df.columns:
            return df
        return numeric_features(df, exclude=(self.key, "entity_id", "user_id", "id"))

    def samples(self, df: DataFrame, n: int) -> DataFrame:
        """(tree, features): at most ``max_samples`` rows for every tree.

        One pass without a shuffle keeps a pool whose expected size does not grow with
        the data; the trees then draw from the pool only.
        """
        size = self._psi(n)
        pool_rows = min(n, 2 * size * self.n_estimators)
        mark = F.xxhash64(F.col(self.key), F.xxhash64("features"), F.lit(self.seed))
        rows = df.select(F.col(self.key).alias("_k"), "features", mark.alias("_copy"))
        pool = rows.mapInArrow(_pool(pool_rows / n), rows.schema)
        share = min(1.0, 3.0 * size / pool_rows)
        trees = F.sequence(F.lit(0), F.lit(self.n_estimators - 1))
        ticket = lambda t: _uniform(F.col("_k"), F.xxhash64("features"), F.col("_copy"), t, F.lit(self.seed + 1))
        drawn = pool.withColumn("tree", F.explode(F.filter(trees, lambda t: ticket(t) < share)))
        rank = F.row_number().over(
            Window.partitionBy("tree").orderBy(ticket(F.col("tree")), "_k", "_copy")
        )
        return drawn.withColumn("_rank", rank).where(F.col("_rank") <= size).drop("_rank")

    def _psi(self, n: int) -> int:
        return min(256 if self.max_samples == "auto" else int(self.max_samples), n)

    def grow_forest(self, df: DataFrame) -> Artifact:
        """The forest without its decision offset."""
        df = self._features(df)
        n = df.count()
        if n == 0:
            raise ValueError("no rows to fit")
        size = self._psi(n)
        limit = max(1, math.ceil(math.log2(max(size, 2))))
        seed = self.seed

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(pdf["tree"].iloc[0])
            pdf = pdf.assign(_f=pdf["features"].map(tuple)).sort_values(["_k", "_f", "_copy"])
            points = np.stack(pdf["features"].to_numpy())
            grown = grow(points, limit, np.random.default_rng([seed, tree]))
            out = pd.DataFrame(grown, columns=["node", "feature", "split", "left", "right", "path"])
            out.insert(0, "tree", tree)
            return out

        nodes = written(self.samples(df, n).groupBy("tree").applyInPandas(build, _NODES), "forest")
        params = {"sample_size": size, "contamination": self.contamination, "offset": None}
        return Artifact(self.kind, params, {"nodes": nodes})

    def fit(self, df: DataFrame, params: dict | None = None) -> Artifact:
        for name, value in (params or {}).items():
            setattr(self, name, value)
        # Read three times below: the count, the sample, the scores.
        rows = written(self._features(df).select(self.key, "features"), "features")
        artifact = self.grow_forest(rows)
        scored = self.sample_scores(rows, artifact).select("sample_score")
        offset = percentiles(scored, "sample_score", {"offset": self.contamination}).first()
        artifact.params["offset"] = offset["offset"]
        return artifact

    def sample_scores(self, df: DataFrame, artifact: Artifact) -> DataFrame:
        """Add ``sample_score``, the negated anomaly score of the paper."""
        # At most n_estimators * (2 * sample_size - 1) nodes by construction.
        trees = forest_arrays(artifact.tables["nodes"].toPandas())
        norm = average_path(artifact.params["sample_size"]) or 1.0
        df = self._features(df)
        source = df.schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column("features")
                points = lists.flatten().to_numpy(zero_copy_only=False)
                points = points.reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
                score = -np.power(2.0, -mean_depth(points, trees) / norm)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(score)], names=[*batch.schema.names, "sample_score"]
                )

        layout = T.StructType([*source.fields, T.StructField("sample_score", T.DoubleType())])
        return df.mapInArrow(run, layout)

    def score(self, df: DataFrame, artifact: Artifact) -> DataFrame:
        scored = self.sample_scores(df, artifact).withColumn(
            "decision", F.col("sample_score") - F.lit(artifact.params["offset"])
        )
        out = outlier_risk(scored, "decision").withColumn(
            "details", F.to_json(F.struct(F.col("decision").alias("raw_score")))
        )
        if "entity_id" not in df.columns:
            out = out.withColumn("entity_id", F.col(self.key).cast("string"))
        return out.drop("features")


def sweep_forest(
    df: DataFrame, configs: list[dict], key: str = "entity_id", max_samples: int | str = "auto", seed: int = 42,
    experiment_id: str = "sweep",
) -> DataFrame:
    """Forests of several sizes and contaminations as experiment runs, from one forest and one scan.

    A smaller forest is the first trees of the largest one. The features are read to grow that
    forest and once to score them for all sizes; thresholds and shares of all configurations come
    from the scores in two further passes, however many configurations there are.
    """
    sizes = sorted({int(c["n_estimators"]) for c in configs})
    names = {f"q{i}": q for i, q in enumerate(sorted({float(c["contamination"]) for c in configs}))}
    forest = IsolationForest(n_estimators=sizes[-1], max_samples=max_samples, seed=seed, key=key)
    rows = written(forest._features(df).select(key, "features"), "features")
    artifact = forest.grow_forest(rows)
    trees = forest_arrays(artifact.tables["nodes"].toPandas())
    norm = average_path(artifact.params["sample_size"]) or 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            scores = -np.power(2.0, -prefix_depths(points, trees, sizes) / norm)
            yield pa.RecordBatch.from_arrays([pa.array(list(scores), pa.list_(pa.float64()))], names=["scores"])

    scores = written(rows.select("features").mapInArrow(run, "scores array<double>"), "scores")
    flat = scores.select(F.posexplode("scores").alias("size", "score"))
    limits = percentiles(flat, "score", names, ["size"])
    counted = flat.join(limits, "size").groupBy("size").agg(
        F.count(F.lit(1)).alias("n"), *[F.max(q).alias(q) for q in names], *[F.count_if(F.col("score") < F.col(q)).alias(f"below_{q}") for q in names])
    # One row per forest size.
    found = {sizes[r["size"]]: r for r in counted.collect()}
    of = {q: name for name, q in names.items()}
    runs = []
    for i, config in enumerate(configs):
        row, q = found[int(config["n_estimators"])], of[float(config["contamination"])]
        runs.append((i, experiment_id, {k: str(v) for k, v in config.items()}, {"flagged": row[f"below_{q}"] / row["n"], "threshold": row[q]}))
    table = df.sparkSession.createDataFrame(runs, "id int, experiment_id string, config map<string,string>, values map<string,double>")
    return table.select("id", "experiment_id", "config", F.to_json("values").alias("metrics"))
