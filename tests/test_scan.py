import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigilspark.operators.filters import page
from vigilspark.operators.ranking import first_rows, latest, status_transitions
from vigilspark.operators.scan import numbered, percentiles, ranged, running


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows have one key; some keys are null."""
    n = 3000
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({
        "id": np.arange(n),
        "k": [None if i % 29 == 0 else ("hot" if i % 3 == 0 else f"k{i % 50}") for i in range(n)],
        "ts": rng.integers(0, 200, n),
        "v": [None if i % 11 == 0 else int(i % 7) for i in range(n)],
    })
    pdf["v"] = pdf["v"].astype("Int64")
    return spark.createDataFrame(pdf).repartition(7)


def test_running_sum_lag_and_fill(skewed):
    out = running(
        skewed, ["k"], ["ts", "id"], sums={"total": "v"}, lags={"before": "id"}, fills={"seen": "v"}
    ).toPandas()
    assert len(out) == 3000
    out["k"] = out["k"].fillna("<null>")
    out = out.sort_values(["k", "ts", "id"])
    for _, g in out.groupby("k"):
        v = g["v"].astype(float)
        assert np.allclose(g["total"].astype(float), v.fillna(0).cumsum())
        assert g["before"].iloc[1:].tolist() == g["id"].iloc[:-1].tolist()
        assert pd.isna(g["before"].iloc[0])
        assert g["seen"].astype(float).fillna(-1).tolist() == v.ffill().fillna(-1).tolist()


def test_hot_key_is_spread_over_slices(spark, skewed):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        slices = ranged(skewed, ["k"], ["ts", "id"])
        assert slices.where("k = 'hot'").select("_slice").distinct().count() >= 2
        largest = slices.groupBy("_slice").count().agg(F.max("count")).first()[0]
        assert largest < 3000 / 4
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_running_descending_sum(skewed):
    out = running(skewed.withColumn("one", F.lit(1)), [], ["-ts", "id"], sums={"n": "one"}).toPandas()
    out = out.sort_values("n")
    assert out["n"].tolist() == list(range(1, 3001))
    assert out["ts"].is_monotonic_decreasing
    with pytest.raises(ValueError):
        running(skewed, [], ["-ts"], lags={"x": "id"})


def test_numbered(skewed):
    out = numbered(skewed.select("id"), ["id"]).toPandas()
    assert (out["id"] == out["row_index"]).all()


def test_percentiles_match_numpy(spark, skewed):
    qs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.951, "e": 1.0}
    pdf = skewed.toPandas()
    got = percentiles(skewed, "ts", qs).first()
    for name, q in qs.items():
        assert got[name] == pytest.approx(np.percentile(pdf["ts"], q * 100))
    by = {r["k"]: r for r in percentiles(skewed, "ts", qs, ["k"]).collect()}
    assert len(by) == pdf["k"].nunique(dropna=False)
    hot = pdf[pdf["k"] == "hot"]["ts"]
    assert by["hot"]["d"] == pytest.approx(np.percentile(hot, 95.1))
    assert by[None]["c"] == pytest.approx(np.percentile(pdf[pdf["k"].isna()]["ts"], 50))


def test_page_shallow_and_deep_agree(skewed, monkeypatch):
    from vigilspark.operators import filters

    want = [r["id"] for r in page(skewed, ["-ts", "id"], 50, 100).collect()]
    monkeypatch.setattr(filters, "TOP_K_ROWS", 10)
    got = {r["id"] for r in page(skewed, ["-ts", "id"], 50, 100).collect()}
    assert got == set(want) and len(want) == 50


def test_first_rows_keeps_the_oldest(skewed):
    got = first_rows(skewed, ["k"], ["ts", "id"], 5, salts=4).toPandas()
    pdf = skewed.toPandas().sort_values(["ts", "id"]).groupby("k", dropna=False).head(5)
    assert sorted(got["id"]) == sorted(pdf["id"])


def test_latest_prefers_the_default(spark):
    df = spark.createDataFrame([(1, 10, 5), (1, 11, 9), (2, 20, 1), (2, 21, 1)], "m int, id int, at int")
    default = spark.createDataFrame([(1, 10)], "m int, default_id int")
    assert {(r["m"], r["id"]) for r in latest(df, "m", "at").collect()} == {(1, 11), (2, 21)}
    assert {(r["m"], r["id"]) for r in latest(df, "m", "at", default).collect()} == {(1, 10), (2, 21)}


def test_status_transitions(spark):
    rows = [("r", 1, 1, "queued"), ("r", 2, 2, "queued"), ("r", 3, 3, "running"), ("r", 4, 4, "failed"), ("s", 1, 5, "running")]
    df = spark.createDataFrame(rows, "run_id string, ts int, id int, status string")
    got = {(r["id"], r["previous"]) for r in status_transitions(df).collect()}
    assert got == {(1, None), (3, "queued"), (4, "running"), (5, None)}
