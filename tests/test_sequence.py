import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilspark.detect.autoencoder import Autoencoder
from vigilspark.detect.base import apply_detector
from vigilspark.detect.sequence import Network, SequenceDetector


@pytest.mark.parametrize("metric", ["mae", "mse"])
def test_gradient_matches_differences(metric):
    rng = np.random.default_rng(1)
    network = Network(2, 3)
    flat = network.start(5) + rng.normal(0, 0.1, network.size)
    x = rng.normal(size=(4, 6, 2))
    mask = (np.arange(6) < np.array([6, 4, 1, 5])[:, None]).astype(float)
    x *= mask[:, :, None]
    g, loss, weight = network.gradient(flat, x, mask, metric)
    assert weight == 16 and loss == pytest.approx((network.errors(flat, x, mask, metric) * mask.sum(axis=1)).sum())
    for i in range(0, network.size, 3):
        step = np.zeros(network.size)
        step[i] = 1e-6
        up, down = (network.gradient(flat + s * step, x, mask, metric)[1] for s in (1, -1))
        assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def waves(spark, entities=30, n=70, odd=(3, 17)):
    """A wave per entity; the odd ones have their values shuffled, so only the order tells them apart."""
    rng = np.random.default_rng(4)
    rows = []
    for e in range(entities):
        values = np.sin(np.arange(n) * 0.5 + e) + rng.normal(0, 0.05, n)
        if e in odd:
            values = rng.permutation(values)
        rows += [(f"e{e:02d}", t, float(v)) for t, v in enumerate(values)]
    rng.shuffle(rows)
    return spark.createDataFrame([(str(a), int(b), float(c)) for a, b, c in rows], "entity_id string, t int, v double")


def detector(**more):
    settings = {"order": ("t",), "columns": ["v"], "length": 14, "step": 7, "hidden": 10, "epochs": 25, "lr": 0.03} | more
    return SequenceDetector(**settings)


def test_odd_sequences_rank_first(spark):
    df = waves(spark)
    fitted = detector(batch_size=16, shards=1, epochs=30)
    artifact = fitted.fit(df)
    assert artifact.params["losses"][-1] < 0.7 * artifact.params["losses"][0]
    mean = fitted.errors(df, artifact).groupBy("entity_id").agg(F.avg("error").alias("e")).orderBy(F.desc("e")).collect()
    assert {r["entity_id"] for r in mean[:2]} == {"e03", "e17"}
    found = fitted.score(df, artifact)
    assert found.where("risk_score NOT BETWEEN 0 AND 100").count() == 0


def test_same_result_for_any_partitioning(spark):
    df = waves(spark, entities=6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for parts in ("2", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            for more in ({"epochs": 4}, {"epochs": 3, "batch_size": 5, "shards": 3}):
                fitted = detector(**more)
                given = df.repartition(int(parts))
                rows = fitted.errors(given, fitted.fit(given)).select("entity_id", "window", "error").collect()
                results.append({(r[0], r[1]): r[2] for r in rows})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for a, b in ((results[0], results[2]), (results[1], results[3])):
        assert a.keys() == b.keys()
        assert np.allclose([a[k] for k in a], [b[k] for k in a], atol=1e-9)


def test_windows_cover_every_row_and_spread_a_hot_entity(spark):
    n = 1000
    rows = [("hot", t, float(t)) for t in range(n)] + [("one", 0, 1.0), (None, 0, 2.0)] + [("two", t, float(t)) for t in range(16)]
    df = spark.createDataFrame(rows, "entity_id string, t int, v double")
    found = detector(length=10, step=5).windows(df).collect()
    assert max(r["rows"] for r in found) == 10
    by_entity = {}
    for r in found:
        by_entity.setdefault(r["entity_id"], []).append((r["window"], [s[0] for s in r["steps"]]))
    assert {k: len(v) for k, v in by_entity.items()} == {"hot": 199, "one": 1, None: 1, "two": 3}
    assert {x for _, steps in by_entity["hot"] for x in steps} == set(map(float, range(n)))
    for window, steps in by_entity["two"]:
        assert steps == [float(t) for t in range(5 * window, min(5 * window + 10, 16))]


def test_missing_numbers_and_no_rows(spark):
    df = spark.createDataFrame([("a", t, None if t % 3 else 1.0, float("nan")) for t in range(9)], "entity_id string, t int, v double, w double")
    fitted = detector(columns=["v", "w"], length=4, step=2, epochs=2)
    found = apply_detector(df, fitted)
    assert found.count() == 4 and found.where("isnan(risk_score) OR risk_score IS NULL").count() == 0
    with pytest.raises(ValueError):
        fitted.fit(df.limit(0))


def test_mini_batches_learn_faster_and_ignore_the_layout(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(600, 2)) @ rng.normal(size=(2, 8))
    df = spark.createDataFrame([(str(i), [float(x) for x in row]) for i, row in enumerate(base)], "entity_id string, features array<double>")
    rounds = 6
    small = Autoencoder(hidden=(6,), epochs=rounds, batch_size=32, shards=2)
    local = small.fit(df.repartition(3))
    steps = Autoencoder(hidden=(6,), epochs=rounds).fit(df)
    assert local.params["losses"][-1] < steps.params["losses"][-1]
    other = Autoencoder(hidden=(6,), epochs=rounds, batch_size=32, shards=2).fit(df.orderBy("entity_id").repartition(7))
    assert np.allclose(local.params["losses"], other.params["losses"], atol=1e-9)


def test_a_round_is_two_jobs(spark):
    """One places the rows, one steps; the shards' weights need no shuffle of their own."""
    df = spark.createDataFrame([(str(i), [float(i % 7), 1.0]) for i in range(64)], "entity_id string, features array<double>").repartition(2)
    made = []
    for epochs in (2, 7):
        group = f"rounds{epochs}"
        spark.sparkContext.setJobGroup(group, group)
        Autoencoder(hidden=(2,), epochs=epochs, batch_size=8, shards=2).fit(df)
        made.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setJobGroup("after", "after")
    assert made[1] - made[0] <= 5 * 2
