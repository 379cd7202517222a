import json
import os

import pytest
from pyspark.sql import functions as F

from vigilspark.functions import features as P
from vigilspark.functions import scalars as S
from vigilspark.operators import aggregates as A
from vigilspark.operators.joins import audit_hashes, case_documents, hash_files
from vigilspark.operators.sets import merge_users
from vigilspark.sources import catalog, readers, sinks


def test_hits_multi_line(spark, tmp_path):
    doc = {"took": 1, "hits": {"total": 2, "hits": [{"_source": {"u": "a", "n": "1"}}, {"_source": {"u": "b", "n": "2.5"}}]}}
    (tmp_path / "one.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "two.json").write_text(json.dumps(doc, indent=2))
    out = readers.read_hits(spark, str(tmp_path))
    assert dict(out.dtypes) == {"u": "string", "n": "double"} and out.count() == 4


def test_tolerant_reads_latin1_and_drops_broken_lines(spark, tmp_path):
    path = tmp_path / "x.log"
    text = "a\t1\ncaf\xe9\t2\nbad\nlong\t3\t4\nc\tnot\n".encode("latin-1") + "\u00fcber\t5\n".encode()
    path.write_bytes(text)
    out = readers.read_log(spark, str(path), "ssh", tolerant=True, schema="w string, n int").collect()
    assert {(r["w"], r["n"]) for r in out} == {("a", 1), ("caf\xe9", 2), ("\u00fcber", 5)}
    with pytest.raises(ValueError):
        readers.read_log(spark, str(path), "ssh", tolerant=True)


def test_log_types(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.csv").write_bytes("user url\njos\xe9 /x\n".encode("latin-1"))
    (tmp_path / "p" / "b.log").write_bytes(b"user url\nann /y\n")
    (tmp_path / "p" / "notes.txt").write_bytes(b"user url\nno /z\n")
    out = readers.read_log(spark, str(tmp_path / "p"), "proxy")
    assert {r["user"] for r in out.collect()} == {"jos\xe9", "ann"}
    with pytest.raises(ValueError):
        readers.read_log(spark, str(tmp_path / "p" / "notes.txt"), "proxy")
    with pytest.raises(ValueError):
        readers.read_data(spark, str(tmp_path), "orc")
    with pytest.raises(ValueError):
        sinks.write_data(out, str(tmp_path / "o"), "json")


def test_ingest_reports_partial_success(spark, tmp_path):
    root = tmp_path / "set_1"
    for kind, name, text in (("dns", "a.csv", "h\t1\nk\t2\n"), ("dns", "b.log", "m\t3\n"), ("proxy", "p.log", "u v\n1 2\n"), ("odd", "x.bin", "?")):
        os.makedirs(root / kind, exist_ok=True)
        (root / kind / name).write_text(text)
    report = {r["log_type"]: r for r in catalog.ingest_dataset(spark, str(root)).collect()}
    assert report["dns"]["row_count"] == 3 and report["proxy"]["row_count"] == 1
    assert report["odd"]["status"] == "failed" and report["odd"]["run_status"] == "completed"
    assert spark.table("set_1_dns").count() == 3
    assert catalog.table_metrics(spark, ["set_1_dns"]).first()["row_count"] == 3


def test_register_replaces(spark, tmp_path):
    for n in (2, 5):
        path = str(tmp_path / f"t{n}")
        spark.range(n).write.parquet(path)
        assert catalog.register_table(spark, path, "vigil_test", "parquet").first()["row_count"] == n
    assert spark.table("vigil_test").count() == 5
    spark.sql("DROP TABLE vigil_test")
    assert os.path.exists(path)


def test_groups(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.csv").write_text("u v\nx 1\n")
    good = {"log_name": "l", "type": "csv", "delimiter": " ", "folder": "logs"}
    group = {"folder": str(tmp_path), "data": [good]}
    assert readers.load_group(spark, group, "l").count() == 1
    with pytest.raises(ValueError):
        readers.load_group(spark, group, "missing")
    with pytest.raises(ValueError):
        readers.load_group(spark, {"folder": str(tmp_path), "data": [good, {"log_name": "e", "type": "es"}]})


def test_model_groups(spark, tmp_path):
    part = {"filename": "m.py", "type": "external", "file_hash": "h"}
    config = {"g1": {"models": [{"model_name": "a", "enabled": True, "components": [part, part]}, {"model_name": "b", "enabled": False}]},
              "g2": {"models": [{"model_name": "known", "enabled": True}]}}
    path = tmp_path / "models.json"
    path.write_text(json.dumps(config, indent=1))
    known = spark.createDataFrame([("known",)], "name string")
    models, parts = readers.flatten_model_groups(spark, str(path), known)
    assert {(r["name"], r["status"], r["version"]) for r in models.collect()} == {("a", "installed", "1.0.0"), ("b", "disabled", "1.0.0")}
    assert parts.count() == 2
    sources = {"source_groups": [{"source_group_name": "s", "mode": "test", "data": [{"log_name": "x", "type": "csv"}]}, {"source_group_name": "", "data": []}]}
    (tmp_path / "scheme.json").write_text(json.dumps(sources, indent=1))
    assert readers.flatten_source_groups(spark, str(tmp_path / "scheme.json")).count() == 1


def test_release_deletes_scratch_tables(spark, monkeypatch):
    from vigilspark import session

    monkeypatch.setattr(session, "_made", [])
    df = session.written(spark.range(3), "gone")
    path = df.inputFiles()[0].removeprefix("file:")
    assert os.path.exists(path) and session.release(spark) == 1 and not os.path.exists(path)


def test_partitioned_sink_leaves_few_files(spark, tmp_path):
    df = spark.range(0, 1000, numPartitions=20).withColumn("day", F.col("id") % 5)
    path = sinks.write_data(df, str(tmp_path / "p"), partition_by=["day"])
    assert len(spark.read.parquet(path).inputFiles()) < 20
    assert spark.read.parquet(path).count() == 1000


def test_export_counts_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 0.5)], "id int, x double")
    counts = sinks.export_documents(df, str(tmp_path / "d")).first()
    assert (counts["success"], counts["failed"]) == (2, 0)
    docs = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "d")).collect()]
    assert sorted(d["x"] is None for d in docs) == [False, True] and all("@timestamp" in d for d in docs)


def test_audit(spark, tmp_path):
    for name in ("a", "b", "extra"):
        (tmp_path / f"{name}.py").write_text(name)
    files = hash_files(spark, str(tmp_path), "*.py")
    good = {r["file"]: r["actual_hash"] for r in files.collect()}
    manifest = spark.createDataFrame([("a.py", good["a.py"]), ("b.py", "0"), ("c.py", "0")], "file string, expected_hash string")
    got = {r["file"]: r["status"] for r in audit_hashes(files, manifest).collect()}
    assert got == {"a.py": "ok", "b.py": "mismatch", "c.py": "missing"}


def test_audited_folders_are_written_and_read_by_many_tasks(spark, tmp_path, monkeypatch):
    """Documents in six files: no task gets a whole language, and a language still counts once."""
    from vigilspark.operators import joins
    from vigilspark.plans.catalog import QUERIES

    rows = [(("de", "en", "x y", None)[i % 4], f"text {i}") for i in range(120)]
    spark.createDataFrame(rows, "lang string, text string").repartition(6).write.option("parquet.block.size", 1024).parquet(
        str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("ASIA",), ("EUROPE",)], "r_name string").write.parquet(str(tmp_path / "region.parquet"))
    listed = []

    def hash_all(*args):
        listed.append(hash_files(*args))
        return listed[-1]

    monkeypatch.setattr(joins, "hash_files", hash_all)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        found = {tuple(r) for r in QUERIES["j12_audit_hashes"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {("copy", "ok", 4), ("swapped", "mismatch", 4), ("gone", "missing", 2)}
    assert listed[0].count() > 2 * 4


def test_coercion_rules(spark):
    df = spark.createDataFrame([("1", "1", "NaN", "1d"), ("x", "2", "2", "2f"), ("3", None, "3", "3")], "a string, b string, c string, d string")
    assert dict(P.coerce_numeric(df).dtypes) == {"a": "double", "b": "double", "c": "double", "d": "string"}
    assert P.coerce_numeric(df).where("c is null").count() == 1
    assert dict(P.coerce_numeric(df, mode="strict").dtypes) == {"a": "string", "b": "double", "c": "string", "d": "string"}
    half = spark.createDataFrame([("1",), ("x",)], "a string")
    assert dict(P.coerce_numeric(half).dtypes) == {"a": "string"}


def test_entity_ids_and_features(spark):
    df = spark.createDataFrame([(5, 2.0), (4, 1.0)], "k int, v double")
    assert {(r["k"], r["entity_id"]) for r in P.with_entity_id(df, ["k"]).collect()} == {(4, "entity_0"), (5, "entity_1")}
    assert P.with_entity_id(df.withColumnRenamed("k", "user_id")).first()["entity_id"] in ("4", "5")
    with pytest.raises(ValueError):
        P.with_entity_id(df)
    with pytest.raises(ValueError):
        P.numeric_features(df.select(F.lit("x").alias("s")))


def test_cases_come_in_pages_by_position(spark):
    cases = spark.createDataFrame([(1, "big"), (2, "none"), (3, "small")], "id int, title string")
    anomalies = spark.range(100).select(F.col("id").cast("int").alias("id"), F.lit(1.5).alias("risk_score"))
    links = anomalies.select(F.lit(1).alias("case_id"), F.col("id").alias("anomaly_id")).union(spark.createDataFrame([(3, 5)], "a int, b int"))
    docs = {(d["id"], d["page"]): [a["id"] for a in d["anomalies"]] for d in case_documents(cases, links, anomalies, 40).collect()}
    assert docs == {(1, 0): list(range(40)), (1, 1): list(range(40, 80)), (1, 2): list(range(80, 100)), (2, 0): [], (3, 0): [5]}


def test_equal_detections_have_ids_of_their_own(spark):
    rows = spark.createDataFrame([("a", 1.0)] * 3 + [("b", 1.0)], "entity_id string, risk_score double")
    ids = [r["id"] for r in P.to_anomalies(rows, "m", "r", F.lit(None).cast("timestamp")).collect()]
    assert len(ids) == len(set(ids)) == 4
    again = [r["id"] for r in P.to_anomalies(rows.repartition(3), "m", "r", F.lit(None).cast("timestamp")).collect()]
    assert sorted(ids) == sorted(again)


def test_newest_log_rows(spark):
    lines = spark.createDataFrame([("2024-01-01 a",), ("2024-01-03 " + "c" * 300,), ("2024-01-02 b",)], "value string")
    got = [(r["timestamp"], len(r["message"])) for r in S.parse_logs(lines, "x", newest=2).collect()]
    assert got == [("2024-01-03", 200), ("2024-01-02", 1)]
    assert {len(r["message"]) for r in S.parse_logs(lines, "x", message_chars=None).collect()} == {1, 300}


def test_labels_and_rounding(spark):
    df = spark.createDataFrame([(None,), (20.0,), (20.5,), (50.0,), (80.0,), (80.5,)], "r double")
    got = [tuple(r) for r in df.select(*[S.severity(F.col("r"), k) for k in ("trend", "entity", "anomaly")]).collect()]
    assert got == [
        ("low", "low", "low"), ("low", "medium", "low"), ("medium", "medium", "low"),
        ("medium", "high", "medium"), ("high", "critical", "high"), ("critical", "critical", "high"),
    ]
    assert spark.range(1).select(S.half_up(F.lit(2.5)), S.half_up(F.lit(-2.5))).first() == (3, -2)


def test_degenerate_aggregates(spark):
    one = spark.createDataFrame([(1.0, True), (1.0, True)], "s double, t boolean")
    assert A.auc(one, "s", "t").first()["auc"] is None
    assert A.confusion(one.withColumn("p", F.lit(False)), "p", "t").first()["precision"] == 0.0
    bins = A.histogram(one, "s", 4).orderBy("bin").collect()
    assert [r["n"] for r in bins] == [0, 0, 2, 0] and bins[0]["left_edge"] == 0.5
    empty = spark.createDataFrame([], "risk_score double, acknowledged boolean")
    assert A.anomaly_kpis(empty).first()["mean_risk"] == 0
    assert A.volume_anomaly(one, 2).count() == 0


def test_curves_without_epoch_or_step(spark):
    rows = [("j", "loss", 3.0, None, None, 1), ("j", "loss", 2.0, None, None, 2), ("j", "f1", 1.0, 7, None, 3)]
    df = spark.createDataFrame(rows, "job_id string, metric_name string, metric_value double, epoch int, step int, at int")
    got = {(r["x"], r["loss"], r["f1"]) for r in A.training_curves(df, ["loss", "f1"], order_by="at").collect()}
    assert got == {(0, 3.0, None), (1, 2.0, None), (7, None, 1.0)}


def test_filters_reach_the_scan(spark, tables):
    from vigilspark.operators.filters import query_cases

    path = tables.path("orders")
    df = spark.read.parquet(path).selectExpr("o_orderkey id", "o_orderstatus status", "o_orderpriority severity", "o_orderdate created_at")
    plan = query_cases(df, status="O")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,O)" in plan and "TakeOrderedAndProject" in plan and "o_totalprice" not in plan


def test_first_listed_model_of_a_name_counts(spark, tmp_path):
    models = lambda text: {"models": [{"model_name": "m", "description": text, "enabled": True, "components": []}]}
    path = tmp_path / "twice.json"
    path.write_text(json.dumps({"z": models("first"), "a": models("second")}))
    rows, _ = readers.flatten_model_groups(spark, str(path))
    assert [(r["model_group"], r["description"]) for r in rows.collect()] == [("z", "first")]


def test_merge_users_keeps_the_least_new_row(spark):
    known = spark.createDataFrame([("a", 9)], "user string, seen int")
    new = spark.createDataFrame([("b", 3), ("b", 1), ("a", 0), ("b", 2)], "user string, seen int").repartition(3)
    assert sorted(map(tuple, merge_users(known, new).collect())) == [("a", 9), ("b", 1)]
