from datetime import datetime, timedelta

from pyspark.sql import functions as F

from vigilspark.streaming import status

START = datetime(2024, 1, 1)


def write(spark, batches, path):
    for rows in batches:
        stamped = [(j, s, START + timedelta(minutes=m), i) for i, (j, s, m) in rows]
        spark.createDataFrame(stamped, "id string, status string, at timestamp, seq long").coalesce(1).write.mode("append").parquet(path)


def events(spark, tmp_path, batches, **more):
    """Batches arrive one file after another; a row is (job, status, minute)."""
    numbered, n = [], 0
    for rows in batches:
        numbered.append([(n + i, r) for i, r in enumerate(rows)])
        n += len(rows)
    source = str(tmp_path / "in")
    write(spark, numbered, source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    status.write_status_events(stream, str(tmp_path / "out"), str(tmp_path / "cp"), **more)
    found = spark.read.schema(status.EVENTS).parquet(str(tmp_path / "out")).withColumn("m", F.expr("timestampdiff(MINUTE, TIMESTAMP '2024-01-01', at)"))
    return sorted((r["job_id"], r["m"], r["event"] == "done", r["event"], r["status"]) for r in found.collect())


def short(found):
    return [(j, m, e, s) for j, m, _, e, s in found]


def test_changes_over_batches(spark, tmp_path):
    found = events(spark, tmp_path, [
        [("a", "queued", 1), ("a", "running", 3), ("a", "queued", 2), ("b", None, 1)],
        [("a", "running", 4), ("b", None, 5), ("b", "running", 6), (None, "running", 7)],
        [("a", "succeeded", 8), ("a", "succeeded", 9), ("a", "running", 10), ("b", "running", 7)],
        [("a", "succeeded", 11), ("a", "failed", 12), ("b", "cancelled", 13)],
    ])
    assert short(found) == [
        ("a", 1, "status", "queued"), ("a", 3, "status", "running"), ("a", 8, "status", "succeeded"), ("a", 8, "done", "succeeded"),
        ("b", 1, "status", None), ("b", 6, "status", "running"), ("b", 13, "status", "cancelled"), ("b", 13, "done", "cancelled")]


def test_rows_that_are_not_newer_are_ignored(spark, tmp_path):
    found = events(spark, tmp_path, [[("a", "running", 10)], [("a", "queued", 9), ("a", "running", 10)], [("a", "failed", 11)]])
    assert short(found) == [("a", 10, "status", "running"), ("a", 11, "status", "failed"), ("a", 11, "done", "failed")]


def test_timer_clears_an_ended_job(spark, tmp_path):
    """Within ``keep`` a repeated end is silent; much later the job counts as new."""
    found = events(spark, tmp_path, [
        [("a", "failed", 1)], [("a", "failed", 30)], [("b", "running", 500)], [("b", "running", 501)], [("a", "running", 502)]],
        late="1 minute", keep=timedelta(minutes=100))
    assert short(found) == [
        ("a", 1, "status", "failed"), ("a", 1, "done", "failed"), ("a", 502, "status", "running"), ("b", 500, "status", "running")]


def test_a_job_is_judged_without_a_frame():
    """Rows in, rows out, one read and one write of the state: a frame for each job took most of the time."""
    from pyspark.sql import Row

    class State:
        value, calls = None, []

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

    judge, state, timers = status.StatusChanges(timedelta(days=1)), State(), []
    judge.last, judge.handle = state, type("Handle", (), {"registerTimer": lambda self, at: timers.append(at)})()
    big = 2**53 + 1
    rows = [Row(job_id="a", status=s, us=us, seq=i, progress=None, epoch_current=e, epoch_total=None, loss=None)
            for i, (s, us, e) in enumerate([("running", 2000, big), ("queued", 1000, None), ("running", 3000, 1), ("failed", 4000, 2), ("running", 5000, 3)])]
    found = [(r["event"], r["status"], r["at"], r["epoch_current"]) for r in judge.handleInputRows(("a",), iter(rows), None)]
    assert found == [("status", "queued", 1000, None), ("status", "running", 2000, big), ("status", "failed", 4000, 2), ("done", "failed", 4000, 2)]
    assert state.calls == ["get", "update"] and state.value == ("failed", 4000, 3, True) and timers == [4 + 86_400_000]
    assert list(judge.handleInputRows(("a",), iter(rows), None)) == []


def test_setting_of_the_state_store_is_put_back(spark, tmp_path):
    before = spark.conf.get(status._PROVIDER, None)
    events(spark, tmp_path, [[("a", "running", 1)]])
    assert spark.conf.get(status._PROVIDER, None) == before


def test_messages(spark):
    rows = spark.createDataFrame([("a", "status", START, 1, "running", 0.5, None, 9, None), ("a", "done", START, 2, "failed", 1.0, 1, 2, 0.1)], status.EVENTS)
    assert [r["data"] for r in status.as_messages(rows).orderBy("seq").collect()] == [
        '{"status":"running","progress":0.5,"epoch_current":null,"epoch_total":9,"loss":null}', '{"status":"failed"}']
