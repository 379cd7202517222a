from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from vigilspark.operators.suppress import suppress


def greedy(pdf, width):
    kept = set()
    for _, g in pdf.sort_values(["created_at", "id"]).groupby(["rule_id", "entity_id"], dropna=False):
        last = None
        for i, at in zip(g["id"], g["created_at"]):
            if last is None or at >= last + width:
                kept.add(i)
                last = at
    return kept


@pytest.fixture(scope="module")
def candidates(spark):
    rng = np.random.default_rng(7)
    start = datetime(2024, 1, 1)
    minutes = np.concatenate([
        rng.integers(0, 3000, 900),  # a hot key, dense
        rng.integers(0, 20000, 300),  # sparse keys
        np.arange(0, 600, 60),  # exactly one interval apart
        np.repeat(5, 5),  # equal times
    ])
    keys = ["hot"] * 900 + [f"e{i % 4}" for i in range(300)] + ["exact"] * 10 + [None] * 5
    return pd.DataFrame({
        "id": np.arange(len(keys)),
        "rule_id": 1,
        "entity_id": keys,
        "created_at": [start + timedelta(minutes=int(m)) for m in minutes],
    })


@pytest.mark.parametrize("fold_rows", [50_000, 40, 12, 0])
@pytest.mark.parametrize("interval,width", [("1 hour", timedelta(hours=1)), ("7 minutes", timedelta(minutes=7))])
def test_greedy(spark, candidates, fold_rows, interval, width):
    df = spark.createDataFrame(candidates).repartition(5)
    got = suppress(df, ["rule_id", "entity_id"], interval=interval, fold_rows=fold_rows)
    assert {r["id"] for r in got.collect()} == greedy(candidates, width)


def test_one_per_key_in_a_run(spark, candidates):
    got = suppress(spark.createDataFrame(candidates), ["rule_id", "entity_id"], mode="run").toPandas()
    assert len(got) == candidates["entity_id"].nunique(dropna=False)
    with pytest.raises(ValueError):
        suppress(spark.createDataFrame(candidates), ["rule_id"], mode="other")


def test_more_rows_make_more_tasks(spark, candidates, monkeypatch):
    """No task sorts a share of the whole table: the fixed number of shuffle partitions is exceeded."""
    from vigilspark.operators import suppress as module

    monkeypatch.setattr(module, "TASK_ROWS", 50)
    df = spark.createDataFrame(candidates).repartition(5)
    got = suppress(df, ["rule_id", "entity_id"])
    assert {r["id"] for r in got.collect()} == greedy(candidates, timedelta(hours=1))
    tasks = -(-len(candidates) // 50)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert tasks > 8 and plan.count(f"RepartitionByExpression") >= 3 and plan.count(f", {tasks}\n") >= 3


def test_late_arrivals_are_written_by_many_tasks(spark, tables, monkeypatch):
    """Four arrivals, each in as many files as cores and judged in one batch."""
    from vigilspark.plans import detection

    paths = []
    scratch = detection.scratch_path
    monkeypatch.setattr(detection, "scratch_path", lambda *a: paths.append(scratch(*a)) or paths[-1])
    monkeypatch.setattr(detection.T, "suppress_stream", lambda *a, **k: None)
    monkeypatch.setattr(detection.T, "read_kept", lambda session, path: session.range(1))
    from vigilspark.plans.catalog import QUERIES

    QUERIES["t04_suppress_late"](spark, tables.dir)
    files = spark.read.parquet(paths[0]).selectExpr("_metadata.file_path").distinct().count()
    assert files == 4 * spark.sparkContext.defaultParallelism
    assert spark.read.parquet(paths[0]).count() == tables.alert_candidates.count()


def test_time_grows_with_the_rows(spark):
    """Alerts of one key, all of them kept: a copy of the kept list per alert would take minutes."""
    import time

    from pyspark.sql import functions as F

    rows = spark.range(40_000).select("id", F.lit("k").alias("entity_id"), F.timestamp_seconds(F.col("id") * 7200).alias("created_at"))
    start = time.time()
    assert suppress(rows, ["entity_id"]).count() == 40_000
    assert time.time() - start < 60
