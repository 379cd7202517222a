import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigilspark import schemas
from vigilspark.detect import graph as G
from vigilspark.detect.autoencoder import Autoencoder, gradient, start_weights, unpack
from vigilspark.detect.base import GroupFunction, apply_detector, log_line, log_metric
from vigilspark.detect.iforest import IsolationForest, average_path, forest_arrays
from vigilspark.detect.pca import PcaDetector
from vigilspark.detect.registry import content_hash, latest_artifact, load_artifact, save_artifact
from vigilspark.detect.steps import grid, run_steps, sweep
from vigilspark.operators.aggregates import compare_runs
from vigilspark.session import scratch_path


@pytest.fixture(scope="module")
def points(spark):
    """300 rows around the origin and 6 far away."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(306, 4))
    x[300:] += 12
    pdf = pd.DataFrame(x, columns=list("abcd"))
    pdf.insert(0, "entity_id", [f"e{i:03d}" for i in range(306)])
    return spark.createDataFrame(pdf)


def test_forest_finds_outliers(points):
    forest = IsolationForest(n_estimators=50, contamination=0.02)
    out = forest.score(points, forest.fit(points)).toPandas()
    flagged = set(out[out["anomaly_type"] == "statistical_outlier"]["entity_id"])
    assert flagged == {f"e{i}" for i in range(300, 306)} | (flagged - {f"e{i}" for i in range(300, 306)})
    assert len(flagged) <= 8 and out["risk_score"].between(0, 100).all()


def test_forest_does_not_depend_on_partitioning(points):
    forest = IsolationForest(n_estimators=10, max_samples=64)
    a = forest.grow_forest(points.repartition(2)).tables["nodes"].toPandas()
    b = forest.grow_forest(points.repartition(9)).tables["nodes"].toPandas()
    order = ["tree", "node"]
    pd.testing.assert_frame_equal(
        a.sort_values(order).reset_index(drop=True), b.sort_values(order).reset_index(drop=True)
    )


def test_forest_samples(points):
    forest = IsolationForest(n_estimators=10, max_samples=32)
    df = forest._features(points)
    sizes = forest.samples(df, 306).groupBy("tree").count().toPandas()
    assert len(sizes) == 10 and (sizes["count"] == 32).all()


def test_forest_score_matches_a_walk(points):
    forest = IsolationForest(n_estimators=5, max_samples=64)
    artifact = forest.grow_forest(points)
    got = forest.sample_scores(points, artifact).toPandas().set_index("entity_id")
    trees = forest_arrays(artifact.tables["nodes"].toPandas())
    for name in ("e000", "e305"):
        x = np.array(got.loc[name, "features"])
        depth = []
        for t in trees:
            at = 0
            while t["feature"][at] >= 0:
                at = t["left"][at] if x[t["feature"][at]] <= t["split"][at] else t["right"][at]
            depth.append(t["path"][at])
        assert got.loc[name, "sample_score"] == pytest.approx(-(2 ** (-np.mean(depth) / average_path(64))))
    with pytest.raises(ValueError):
        forest.grow_forest(points.where("false"))


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    x, hidden = rng.normal(size=(5, 3)), (4, 2, 4)
    for output in ("linear", "sigmoid"):
        flat = start_weights(3, hidden, 1) + 0.05
        g, _ = gradient(x, unpack(flat, 3, hidden), output)
        for i in range(0, len(flat), 7):
            step = np.zeros_like(flat)
            step[i] = 1e-6
            up = gradient(x, unpack(flat + step, 3, hidden), output)[1]
            down = gradient(x, unpack(flat - step, 3, hidden), output)[1]
            assert g[i] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-5)


def test_autoencoder_learns(points):
    net = Autoencoder(hidden=(8, 3, 8), epochs=12)
    artifact = net.fit(points)
    losses = artifact.params["losses"]
    assert losses[-1] < losses[0]
    out = net.score(points, artifact).orderBy(F.desc("error")).toPandas()
    assert set(out["entity_id"].head(3)) <= {f"e{i}" for i in range(300, 306)}
    assert out["is_anomaly"].sum() == 16  # the top five per cent of 306
    narrow = net.score(points.drop("d"), artifact)
    assert narrow.count() == 306


def test_pca_error_matches_numpy(points):
    pca = PcaDetector(2)
    out = pca.score(points, pca.fit(points)).toPandas().sort_values("entity_id")
    x = points.toPandas().sort_values("entity_id")[list("abcd")].to_numpy()
    c = x - x.mean(axis=0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    want = ((c - c @ vt[:2].T @ vt[:2]) ** 2).mean(axis=1)
    assert np.allclose(out["error"], want)


@pytest.fixture(scope="module")
def edges(spark):
    rng = np.random.default_rng(5)
    pairs = [("hub", f"n{i}") for i in range(60)] + [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 60, (80, 2))]
    pairs += [("n1", "hub"), ("n2", "n2"), (None, "n3")]
    return spark.createDataFrame(pairs, "source string, target string")


def power_iteration(pairs, steps, alpha=0.85):
    nodes = sorted({n for p in pairs for n in p})
    at = {n: i for i, n in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for a, b in pairs:
        m[at[a], at[b]] = m[at[b], at[a]] = 1
    m = m / m.sum(axis=1, keepdims=True)
    r = np.full(len(nodes), 1 / len(nodes))
    for _ in range(steps):
        r = (1 - alpha) / len(nodes) + alpha * r @ m
    return dict(zip(nodes, r))


@pytest.mark.parametrize("hub_edges", [200_000, 7])
def test_pagerank(edges, hub_edges):
    pairs = G.build_edges(edges)
    got = {r["node"]: r["rank"] for r in G.pagerank(pairs, fixed_iter=7, hub_edges=hub_edges).collect()}
    want = power_iteration([(r["a"], r["b"]) for r in pairs.collect()], 7)
    assert got.keys() == want.keys()
    assert all(got[n] == pytest.approx(want[n]) for n in want)


def test_pagerank_converges_and_ranks_the_hub(edges):
    ranks = G.pagerank(G.build_edges(edges)).toPandas()
    assert ranks["rank"].sum() == pytest.approx(1.0)
    want = power_iteration([(r["a"], r["b"]) for r in G.build_edges(edges).collect()], 300)
    assert np.allclose(ranks["rank"], ranks["node"].map(want), atol=1e-4)
    out = apply_detector(edges, G.CentralityDetector()).toPandas().sort_values("risk_score")
    assert out["entity_id"].iloc[-1] == "hub" and out["anomaly_type"].iloc[-1] == "high_centrality"


def test_edges_fall_back_to_position(spark):
    df = spark.createDataFrame([("b", "a"), ("a", "b"), ("c", "c")], "x string, y string")
    assert {tuple(r) for r in G.build_edges(df, "no", "such").collect()} == {("a", "b"), ("c", "c")}
    with pytest.raises(ValueError):
        G.build_edges(df.select("x"))


def test_k_hop(spark):
    chain = G.build_edges(spark.createDataFrame([(str(i), str(i + 1)) for i in range(9)], "source string, target string"))
    got = {r["node"]: r["hop"] for r in G.k_hop(chain, ["4"], 2).collect()}
    assert got == {"4": 0, "3": 1, "5": 1, "2": 2, "6": 2}
    assert G.k_hop(chain, ["nowhere"], 2).count() == 0


def test_group_function_does_not_depend_on_pieces(spark):
    rows = [("hot" if i % 3 else f"e{i}", float(i)) for i in range(300)]

    def finish(pdf, state):
        assert pdf["entity_id"].nunique() == 1
        return pdf.assign(risk_score=pdf["v"] / state[1], anomaly_type=str(int(state[0])), entity_type="user")

    function = GroupFunction(lambda p: [len(p), p["v"].max()], lambda s: [sum(x[0] for x in s), max(x[1] for x in s)], finish)
    got = []
    for pieces in (1, 7):
        out = apply_detector(spark.createDataFrame(rows, "entity_id string, v double").repartition(pieces), function, ["entity_id"])
        assert out.schema.simpleString() == schemas.DETECTIONS.simpleString()
        got.append(sorted((r["entity_id"], r["risk_score"], r["anomaly_type"]) for r in out.collect() if r["risk_score"] is not None))
    assert got[0] == got[1] and {n for e, _, n in got[0] if e == "hot"} == {"200"}
    with pytest.raises(ValueError):
        apply_detector(spark.createDataFrame(rows, "entity_id string, v double"), lambda p: p, ["entity_id"])


def test_a_hot_key_has_its_share_of_each_sample(spark):
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("e"), F.col("id"))).alias("entity_id"),
        F.array((F.col("id") % 977).cast("double"), (F.col("id") % 31).cast("double")).alias("features"))
    forest = IsolationForest(n_estimators=10)
    drawn = forest.samples(rows, 40_000).groupBy("tree").agg(F.avg((F.col("_k") == "hot").cast("int")).alias("s"), F.count("*").alias("n")).collect()
    assert len(drawn) == 10 and all(r["n"] == 256 and 0.35 < r["s"] < 0.65 for r in drawn)


def test_registry_round_trip(spark, points):
    from datetime import datetime

    forest = IsolationForest(n_estimators=5)
    artifact = forest.fit(points)
    path = scratch_path(spark, "artifact")
    old = save_artifact(spark, artifact, scratch_path(spark, "artifact"), "forest", datetime(2024, 1, 1))
    new = save_artifact(spark, artifact, path, "forest", datetime(2024, 1, 2))
    row = latest_artifact(old.unionByName(new), "forest").first()
    assert row["path"] == path and row["file_hash"] == content_hash(spark, path)
    loaded = load_artifact(spark, path, row["file_hash"])
    assert loaded.params == artifact.params
    a = forest.score(points, artifact).select("entity_id", "risk_score")
    assert a.exceptAll(forest.score(points, loaded).select("entity_id", "risk_score")).count() == 0
    with pytest.raises(ValueError):
        load_artifact(spark, path, "0" * 64)


def test_steps_stop_at_the_first_failure(points):
    steps = [
        {"type": "preprocess", "hyperparameters": {"normalize": True}},
        {"type": "training", "model_id": "forest", "hyperparameters": {"n_estimators": 5}},
        {"type": "inference", "model_id": "forest"},
    ]
    found, status = run_steps(points, steps, {"forest": IsolationForest})
    assert found.count() == 306 and {r["status"] for r in status.collect()} == {"completed"}
    found, status = run_steps(points, [steps[2], *steps], {"forest": IsolationForest})
    assert found is None
    assert [r["status"] for r in status.orderBy("step_index").collect()] == ["failed", "pending", "pending", "pending"]
    with pytest.raises(ValueError):
        run_steps(points, [], {})


def test_sweep_and_reports(spark):
    from datetime import datetime

    runs = sweep(spark, grid({"a": [1, 2], "b": [3]}), lambda c: {"score": c["a"] * c["b"]}, "s")
    assert {(r["id"], r["score"]) for r in compare_runs(runs).collect()} == {(0, 3.0), (1, 6.0)}
    assert log_metric(spark, "j", "loss", 1, epoch=2).first()["epoch"] == 2
    assert log_line(spark, "1", "r", "info", "hello", datetime(2024, 1, 1)).first()["level"] == "info"
