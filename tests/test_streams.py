from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from vigilspark.operators.aggregates import entity_rollup, merge_entities
from vigilspark.operators.suppress import suppress
from vigilspark.streaming import streams as T

START = datetime(2024, 1, 1)


def write_in_batches(spark, pdf, path, n):
    for part in np.array_split(np.arange(len(pdf)), n):
        spark.createDataFrame(pdf.iloc[part]).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture(scope="module")
def anomalies():
    rng = np.random.default_rng(2)
    n = 300
    return pd.DataFrame({
        "id": np.arange(n),
        "entity_id": [None if i % 31 == 0 else f"e{i % 7}" for i in range(n)],
        "entity_type": [None if i % 5 == 0 else "user" for i in range(n)],
        "risk_score": rng.uniform(0, 100, n).round(2),
        "timestamp": [START + timedelta(minutes=int(m)) for m in rng.integers(0, 5000, n)],
    })


def test_rollup_over_batches_equals_batch(spark, tmp_path, anomalies):
    write_in_batches(spark, anomalies, str(tmp_path / "in"), 4)
    T.write_rollup(stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = T.read_rollup(spark, str(tmp_path / "out"))
    want = entity_rollup(spark.createDataFrame(anomalies))
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_merge_is_order_independent(spark, anomalies):
    df = spark.createDataFrame(anomalies)
    first = entity_rollup(df.where("id < 100"))
    merged = merge_entities(merge_entities(first, df.where("id >= 200")), df.where("id BETWEEN 100 AND 199"))
    want = entity_rollup(df)
    assert sorted(map(tuple, merged.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_suppression_over_batches_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    n = 240
    pdf = pd.DataFrame({
        "id": np.arange(n), "rule_id": 1, "entity_id": [f"e{i % 3}" for i in range(n)], "severity": "high",
        "created_at": sorted(START + timedelta(minutes=int(m)) for m in rng.integers(0, 3000, n)),
    })
    write_in_batches(spark, pdf, str(tmp_path / "in"), 3)
    T.suppress_stream(stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r["id"] for r in T.read_kept(spark, str(tmp_path / "out")).collect()}
    keys = ["rule_id", "entity_id", "severity"]
    assert got == {r["id"] for r in suppress(spark.createDataFrame(pdf), keys).collect()}


def test_watermark_suppression_keeps_one_per_key(spark, tmp_path):
    rows = [(i, 1, f"e{i % 2}", "high", START + timedelta(minutes=i)) for i in range(20)]
    spark.createDataFrame(rows, "id int, rule_id int, entity_id string, severity string, created_at timestamp").write.parquet(str(tmp_path / "in"))
    T.to_table(T.suppress_within_watermark(stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("entity_id").count().where("count = 1").count() == 2


def test_metric_stream_sends_each_row_once(spark, tmp_path):
    metrics, jobs, out, cp = (str(tmp_path / d) for d in ("m", "j", "o", "c"))
    layout = "job_id string, metric_name string, metric_value double"

    def run():
        T.to_table(T.metric_stream(stream(spark, metrics), stream(spark, jobs)), out, cp)
        return spark.read.parquet(out)

    spark.createDataFrame([("j", "loss", 1.0)], layout).write.parquet(metrics)
    spark.createDataFrame([("j", "running")], "id string, status string").write.parquet(jobs)
    assert run().count() == 2
    spark.createDataFrame([("j", "loss", 0.5)], layout).write.mode("append").parquet(metrics)
    spark.createDataFrame([("j", "succeeded")], "id string, status string").write.mode("append").parquet(jobs)
    rows = run().collect()
    assert len(rows) == 4 and [r["status"] for r in rows if r["type"] == "done"] == ["succeeded"]


def test_metric_stream_carries_the_place_of_a_metric(spark, tmp_path):
    metrics, jobs, out, cp = (str(tmp_path / d) for d in ("m", "j", "o", "c"))
    layout = "job_id string, metric_name string, metric_value double, epoch int, step int, created_at timestamp"
    spark.createDataFrame([("j", "loss", 1.0, 2, None, START)], layout).write.parquet(metrics)
    spark.createDataFrame([("j", "running")], "id string, status string").write.parquet(jobs)
    T.to_table(T.metric_stream(stream(spark, metrics), stream(spark, jobs)), out, cp)
    rows = {r["type"]: (r["epoch"], r["step"], r["created_at"]) for r in spark.read.parquet(out).collect()}
    assert rows == {"metric": (2, None, START), "status": (None, None, None)}


def test_late_rows_are_ignored_and_open_windows_wait(spark, tmp_path):
    layout = "entity_id string, ts timestamp, failed boolean, bytes double"
    path = str(tmp_path / "in")
    day = lambda d, h: START + timedelta(days=d, hours=h)
    batches = [[("a", day(0, 9), False, 1.5), ("a", day(0, 20), True, 2.0)], [("a", day(2, 1), False, 1.0)], [("a", day(2, 2), False, 1.0)], [("a", day(0, 10), False, 9.0)]]
    for rows in batches:
        spark.createDataFrame(rows, layout).coalesce(1).write.mode("append").parquet(path)
    T.to_table(T.login_features_stream(stream(spark, path)), str(tmp_path / "out"), str(tmp_path / "cp"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 1
    got = rows[0]
    assert (got["login_count"], got["failed_login_ratio"], got["off_hours_activity"], got["bytes_transferred"], got["session_duration"]) == (2, 0.5, 0.5, 3.5, 660.0)


def test_change_feed_payload(spark):
    df = spark.createDataFrame([("UPDATE", 1, "t", None)], "operation string, id int, title string, status string")
    row = T.change_feed(df, "case").first()
    assert row["channel"] == "case_changed" and row["payload"] == '{"operation":"UPDATE","id":1,"title":"t","status":null}'
