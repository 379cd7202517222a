"""Sources, sinks and feature preparation, as round trips over the given tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import features as P
from ..functions import scalars as S
from ..operators import aggregates as A
from ..session import scratch_path
from ..sources import catalog, readers, sinks
from .analyst import R6
from .base import AS_OF, query


@query("s01_read_tab_log", "SELECT * FROM supplier")
def _(t):
    path = scratch_path(t.spark, "ssh")
    t.supplier.write.option("sep", "\t").csv(path)
    names = dict(zip(["_c0", "_c1", "_c2", "_c3"], t.supplier.columns))
    df = readers.read_log(t.spark, path, "ssh").withColumnsRenamed(names)
    return df.select(*[F.col(f.name).cast(f.dataType) for f in t.supplier.schema])


@query("s01_read_proxy_log", "SELECT p_partkey, p_name, p_brand, p_size, p_retailprice FROM part")
def _(t):
    rows = t.part.select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    path = scratch_path(t.spark, "proxy")
    rows.write.options(sep=" ", header="true", encoding="ISO-8859-1").csv(path)
    df = readers.read_log(t.spark, path, "proxy")
    return df.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema])


@query("s02_read_formats", "SELECT 'json' AS format, * FROM customer UNION ALL SELECT 'parquet', * FROM customer UNION ALL SELECT 'csv', * FROM customer")
def _(t):
    out = None
    for name in readers.FORMATS:
        path = scratch_path(t.spark, name)
        t.customer.write.format(name).options(**({"header": "true"} if name == "csv" else {})).save(path)
        df = readers.read_data(t.spark, path, name, schema=t.customer.schema)
        df = df.select(F.lit(name).alias("format"), *t.customer.columns)
        out = df if out is None else out.unionByName(df)
    return out


@query("s03_tolerant_csv", "SELECT event_id, user_id, value FROM events WHERE event_type <> 'error'")
def _(t):
    fields = [F.col(c).cast("string") for c in ("event_id", "user_id", "value")]
    line = F.concat_ws("\t", *fields)
    broken = F.when(F.col("event_type") == "error", F.concat(line, F.lit("\tx"))).otherwise(line)
    path = scratch_path(t.spark, "ssh") + ".log"
    t.events.select(broken).write.text(path)
    return readers.read_log(
        t.spark, path, "ssh", tolerant=True, schema="event_id long, user_id long, value double"
    )


@query("s04_register_table", "SELECT 'vigil_orders' AS table_name, count(*) AS row_count FROM orders")
def _(t):
    return catalog.register_table(t.spark, t.path("orders"), "vigil_orders", "parquet")


@query("s05_ingest_dataset", """
SELECT 'dns' AS log_type, 'success' AS status, count(*) AS row_count, 'completed' AS run_status FROM supplier
UNION ALL SELECT 'proxy', 'success', count(*), 'completed' FROM part
UNION ALL SELECT 'odd', 'failed', NULL, 'completed' FROM region WHERE r_regionkey = 0""")
def _(t):
    root = scratch_path(t.spark, "dataset")
    t.supplier.write.option("sep", "\t").csv(f"{root}/dns")
    t.part.write.options(sep=" ", header="true", encoding="ISO-8859-1").csv(f"{root}/proxy")
    t.region.select("r_name").write.text(f"{root}/odd")
    return catalog.ingest_dataset(t.spark, root).select("log_type", "status", "row_count", "run_status")


@query("s05_history", """
SELECT id, status, "rows", documents, failed, floor("rows" / 1024 * 100 + 0.5) / 100 AS spark, floor(documents / 1024 * 100 + 0.5) / 100 AS search
FROM (SELECT 'run-1' AS id, 'completed' AS status, s.n + p.n AS "rows", s.n + p.n AS documents, CAST(0 AS BIGINT) AS failed
 FROM (SELECT count(*) AS n FROM supplier) s, (SELECT count(*) AS n FROM part) p)""")
def _(t):
    """Counts observed by an ingest, through the history (A18) and the totals (A19)."""
    root = scratch_path(t.spark, "dataset")
    t.supplier.write.option("sep", "\t").csv(f"{root}/dns")
    t.part.write.options(sep=" ", header="true", encoding="ISO-8859-1").csv(f"{root}/proxy")
    t.region.select("r_name").write.text(f"{root}/odd")
    runs = catalog.ingest_to_tables(t.spark, root, scratch_path(t.spark, "ingested"), "run-1", datetime(2024, 1, 30, 12))
    day = A.ingestion_history(runs, AS_OF).where(F.col("day") == F.lit("2024-01-30").cast("date")).select("spark", "search")
    return A.ingestion_totals(runs).select("*", day.select("spark").scalar().alias("spark"), day.select("search").scalar().alias("search"))


def _group(t):
    root = scratch_path(t.spark, "group")
    t.customer.write.options(sep=" ", header="true").csv(f"{root}/accounts")
    t.orders.write.parquet(f"{root}/orders")
    return {
        "folder": root,
        "data": [
            {"log_name": "accounts", "type": "csv", "delimiter": " ", "location_type": "disk", "folder": "accounts", "id_feature": "c_name"},
            {"log_name": "orders", "type": "parquet", "location_type": "disk", "folder": "orders", "id_feature": "o_custkey"},
        ],
    }


@query("s06_load_group", "SELECT 'accounts' AS log_name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders")
def _(t):
    out = None
    for name, df in readers.load_group(t.spark, _group(t)).items():
        n = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("log_name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("s06_load_group_one", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def _(t):
    df = readers.load_group(t.spark, _group(t), "accounts")
    return df.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_mktsegment")


@query("s07_write_data", "SELECT 'csv' AS format, * FROM part UNION ALL SELECT 'parquet', * FROM part")
def _(t):
    out = None
    for name in sinks.SINK_FORMATS:
        path = sinks.write_data(t.part, scratch_path(t.spark, "sink"), name)
        df = readers.read_data(t.spark, path, name, schema=t.part.schema)
        df = df.select(F.lit(name).alias("format"), *t.part.columns)
        out = df if out is None else out.unionByName(df)
    return out


@query("s08_read_hits", "SELECT event_id, value, event_type FROM events")
def _(t):
    source = F.struct(
        F.col("event_id").cast("string").alias("event_id"), F.col("value").cast("string").alias("value"), "event_type"
    )
    hits = F.array(F.struct(source.alias("_source")))
    responses = t.events.select(F.struct(hits.alias("hits")).alias("hits"))
    path = scratch_path(t.spark, "hits")
    responses.write.json(path)
    df = readers.read_hits(t.spark, path, lines=True)
    return df.select(F.col("event_id").cast("long").alias("event_id"), "value", "event_type")


@query("s09_export_documents", "SELECT event_id, value, event_type, '2024-01-31T00:00:00.000000' AS stamp FROM events")
def _(t):
    path = scratch_path(t.spark, "documents")
    now = F.lit(AS_OF).cast("timestamp_ntz")
    sinks.export_documents(t.events.select("event_id", "value", "event_type"), path, now)
    back = t.spark.read.schema("event_id long, value double, event_type string, `@timestamp` string").json(path)
    return back.withColumnRenamed("@timestamp", "stamp")


@query("s09_export_counts", "SELECT count(*) AS success, CAST(0 AS BIGINT) AS failed FROM orders")
def _(t):
    return sinks.export_documents(t.orders, scratch_path(t.spark, "documents"))


@query("s10_to_anomalies", """
SELECT sha256(concat_ws('|', 'run-1', coalesce(entity_id, 'unknown'), coalesce(entity_type, 'user'), CAST(row_no AS VARCHAR))) AS id,
  'model-1' AS model_id, 'run-1' AS run_id, coalesce(entity_id, 'unknown') AS entity_id, coalesce(entity_type, 'user') AS entity_type,
  timestamp, coalesce(risk_score, 0) AS risk_score, coalesce(anomaly_type, 'unknown') AS anomaly_type, coalesce(details, '{}') AS details,
  false AS acknowledged FROM detections""")
def _(t):
    path = scratch_path(t.spark, "anomalies")
    sinks.append_anomalies(t.detections, path, "model-1", "run-1", F.col("timestamp"), F.col("row_no"))
    return t.spark.read.parquet(path).drop("day")


@query("s11_table_metrics", "SELECT 'vigil_part' AS table_name, count(*) AS row_count FROM part UNION ALL SELECT 'vigil_lineitem', count(*) FROM lineitem")
def _(t):
    t.part.createOrReplaceTempView("vigil_part")
    t.lineitem.createOrReplaceTempView("vigil_lineitem")
    return catalog.table_metrics(t.spark, ["vigil_part", "vigil_lineitem"]).select("table_name", "row_count")


_NAMES = "(SELECT string_agg(column_name, ',' ORDER BY column_name) FROM (DESCRIBE SELECT * FROM {0}))"


@query("s11_table_schema", f"""
SELECT 'vigil_part' AS table_name, {_NAMES.format('part')} AS columns, true AS partitioned, count(*) AS row_count FROM part
UNION ALL SELECT 'vigil_orders', {_NAMES.format('orders')}, true, count(*) FROM orders""")
def _(t):
    """Columns as the metrics name them, and as many partitions as tasks that found rows."""
    t.part.repartition(3).createOrReplaceTempView("vigil_part")
    t.orders.repartition(3).createOrReplaceTempView("vigil_orders")
    found = catalog.table_metrics(t.spark, ["vigil_part", "vigil_orders"])
    fields = F.from_json("schema_json", "fields array<struct<name: string>>")["fields"]["name"]
    return found.select("table_name", F.array_join(F.array_sort(fields), ",").alias("columns"),
                        (F.col("partition_count") == 3).alias("partitioned"), "row_count")


@query("s12_run_sql", "SELECT event_type, count(*) AS n, max(value) AS top FROM events GROUP BY event_type")
def _(t):
    return catalog.run_sql(
        t.spark, "SELECT event_type, count(*) AS n, max(value) AS top FROM {events} GROUP BY event_type", events=t.events
    )


@query("s13_read_any", "SELECT 'parquet' AS kind, * FROM part UNION ALL SELECT 'csv', * FROM part")
def _(t):
    csv = scratch_path(t.spark, "part") + ".csv"
    t.part.write.option("header", "true").csv(csv)
    first = readers.read_any(t.spark, t.path("part")).withColumn("kind", F.lit("parquet"))
    second = readers.read_any(t.spark, csv).withColumn("kind", F.lit("csv"))
    same = [F.col(f.name).cast(f.dataType) for f in t.part.schema]
    return first.select("kind", *same).unionByName(second.select("kind", *same))


@query("s14_flatten_source_groups", """
SELECT concat('group-', CAST(s_suppkey AS VARCHAR)) AS slug, s_name AS log_name, 'csv' AS type FROM supplier WHERE s_nationkey <> 3""")
def _(t):
    slug = F.concat(F.lit("group-"), F.col("s_suppkey").cast("string"))
    sources = F.array(F.struct(F.col("s_name").alias("log_name"), F.lit("csv").alias("type")))
    group = F.struct(slug.alias("source_group_name"), sources.alias("data"))
    path = scratch_path(t.spark, "groups")
    t.supplier.select(F.array(group).alias("source_groups")).write.json(path)
    known = t.supplier.where("s_nationkey = 3").select(slug.alias("slug"))
    found = readers.flatten_source_groups(t.spark, path, known, lines=True)
    return found.select("slug", "log_name", "type")


_MODEL_NAME = "concat('model-', CAST(s_suppkey % 700 AS VARCHAR))"


@query("s14_model_groups", f"""
SELECT name, min_by(model_group, s_suppkey) AS model_group, min_by(status, s_suppkey) AS status, min_by(runtime, s_suppkey) AS runtime,
 '1.0.0' AS version, CAST(2 AS BIGINT) AS components
FROM (SELECT s_suppkey, {_MODEL_NAME} AS name, concat('group-', lpad(CAST(s_suppkey AS VARCHAR), 9, '0')) AS model_group,
  CASE WHEN s_acctbal > 0 THEN 'installed' ELSE 'disabled' END AS status, CASE WHEN s_nationkey = 5 THEN 'python-base' ELSE 'spark' END AS runtime FROM supplier)
WHERE name <> 'model-7' GROUP BY 1""")
def _(t):
    """A model configuration with one group a line, in which names repeat and one is known already."""
    part = lambda name: F.struct(F.lit(name).alias("filename"), F.lit("external").alias("type"))
    name = F.concat(F.lit("model-"), (F.col("s_suppkey") % 700).cast("string"))
    model = F.struct(name.alias("model_name"), (F.col("s_acctbal") > 0).alias("enabled"),
                     F.when(F.col("s_nationkey") != 5, "spark").alias("runtime"), F.array(part("MODEL.py"), part("model.yaml")).alias("components"))
    group = F.concat(F.lit("group-"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"))
    path = scratch_path(t.spark, "models")
    t.supplier.select(F.to_json(F.create_map(group, F.struct(F.array(model).alias("models"))))).write.text(path)
    known = t.supplier.where("s_suppkey % 700 = 7").select(name.alias("name"))
    models, parts = readers.flatten_model_groups(t.spark, path, known, lines=True)
    counts = parts.groupBy("name").agg(F.count(F.lit(1)).alias("components"))
    return models.select("name", "model_group", "status", "runtime", "version").join(counts, "name")


@query("p01_coerce_numeric", """
SELECT id, CAST(amount AS DOUBLE) AS amount, TRY_CAST(mostly AS DOUBLE) AS mostly, rarely, CAST(sparse AS DOUBLE) AS sparse, word FROM raw_text""")
def _(t):
    return P.coerce_numeric(t.raw_text)


@query("p02_coerce_strict", """
SELECT id, CAST(amount AS DOUBLE) AS amount, mostly, CAST(rarely AS DOUBLE) AS rarely, CAST(sparse AS DOUBLE) AS sparse, word FROM raw_text""")
def _(t):
    return P.coerce_numeric(t.raw_text, mode="strict")


@query("p03_numeric_features", "SELECT event_id, 3 AS width, CAST(user_id AS DOUBLE) AS f1, value AS f2 FROM events")
def _(t):
    df = P.numeric_features(t.events, exclude=())
    return df.select("event_id", F.size("features").alias("width"), F.col("features")[1].alias("f1"), F.col("features")[2].alias("f2"))


@query("p04_positional_entity_id", "SELECT concat('entity_', CAST(row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS VARCHAR)) AS entity_id, o_orderkey FROM orders")
def _(t):
    return P.with_entity_id(t.orders, ["o_custkey", "o_orderkey"]).select("entity_id", "o_orderkey")


@query("p05_align_dim", """
SELECT vec_id, len(embedding) AS width, CAST(list_extract(embedding, 5) AS DOUBLE) AS cut_last, CAST(list_extract(embedding, len(embedding)) AS DOUBLE) AS pad_kept,
  0.0e0 AS pad_zero FROM embeddings""")
def _(t):
    wide = F.col("embedding").cast("array<double>")
    n = F.size("embedding")
    cut, pad = S.align_dim(wide, 5), S.align_dim(wide, 1000)
    return t.embeddings.select(
        "vec_id", n.cast("long").alias("width"), F.element_at(cut, -1).alias("cut_last"),
        F.element_at(pad, n).alias("pad_kept"), F.element_at(pad, -1).alias("pad_zero"),
    )


@query("p06_standard_scaler", f"""
SELECT event_id, {R6.format('(value - m) / s')} AS value FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)""")
def _(t):
    spec = [{"name": "value", "transform": "standard_scaler", "transform_params": {"with_mean": True, "with_std": True}}]
    out = P.apply_transform(t.events.select("event_id", "value"), spec)
    return out.withColumn("value", S.round6(F.col("value")))


@query("p07_preprocess", f"""
SELECT id, {R6.format('(x - lo) / (hi - lo)')} AS amount FROM (SELECT id, coalesce(amount, med) AS x, min(coalesce(amount, med)) OVER () AS lo,
  max(coalesce(amount, med)) OVER () AS hi FROM holed, (SELECT quantile_cont(amount, 0.5) AS med FROM holed))""")
def _(t):
    out = P.preprocess(t.holed.select("id", "amount"), {"fill_na": "median", "normalize": True}, ["amount"])
    return out.withColumn("amount", S.round6(F.col("amount")))


@query("p08_split_record", "SELECT p_partkey, array_to_string(string_split(p_name, ' '), '|') AS parts, len(string_split(p_type, '.')) AS n FROM part")
def _(t):
    return t.part.select(
        "p_partkey", F.array_join(S.split_record(F.col("p_name"), " "), "|").alias("parts"),
        F.size(S.split_record(F.col("p_type"), ".")).cast("long").alias("n"),
    )


@query("p09_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", S.sha256(F.col("text")).alias("digest"))


@query("p10_base64", "SELECT doc_id, base64(encode(text)) AS encoded, text AS decoded FROM documents")
def _(t):
    encoded = t.documents.select("doc_id", S.b64(F.col("text")).alias("encoded"))
    return encoded.withColumn("decoded", S.unb64(F.col("encoded")))


@query("p11_normalise_results", """
SELECT row_no, result->>'$.entity_id' AS entity_id, CAST(result->>'$.risk_score' AS DOUBLE) AS risk_score FROM loose_results
WHERE (result->>'$.anomalies') IS NULL AND ((result->>'$.risk_score') IS NOT NULL OR (result->>'$.anomaly') IS NOT NULL)
UNION ALL
SELECT row_no, a->>'$.entity_id', CAST(a->>'$.risk_score' AS DOUBLE) FROM (SELECT row_no, unnest(CAST(json_extract(result, '$.anomalies') AS JSON[])) AS a FROM loose_results)""")
def _(t):
    return P.normalise_results(t.loose_results).select("row_no", "entity_id", "risk_score")


@query("p12_validate", """
SELECT row_no, CASE WHEN entity_id IS NULL THEN 'entity_id missing' WHEN entity_type IS NULL OR entity_type NOT IN ('user', 'device', 'ip', 'other')
 THEN 'entity_type not allowed' WHEN risk_score IS NULL OR risk_score NOT BETWEEN 0 AND 100 THEN 'risk_score out of range' ELSE 'valid' END AS reason FROM detections""")
def _(t):
    valid, rejected = P.validate(t.detections, "anomalies")
    return valid.withColumn("reason", F.lit("valid")).unionByName(rejected).select("row_no", "reason")


@query("p12_validate_cases", "SELECT id FROM cases UNION ALL SELECT id FROM user_feedback")
def _(t):
    valid, rejected = P.validate(t.cases, "cases")
    ok, bad = P.validate(t.user_feedback, "feedback")
    return valid.select("id").unionByName(rejected.select("id")).unionByName(ok.select("id")).unionByName(bad.select("id"))


@query("p12_rejected", """
SELECT part, reason, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (
 SELECT 'cases' AS part, id, CASE WHEN id % 11 = 0 THEN 'title missing' WHEN severity = 'low' THEN 'severity not allowed'
  WHEN status = 'closed' THEN 'status not allowed' ELSE 'valid' END AS reason FROM cases
 UNION ALL SELECT 'feedback', id, CASE WHEN feedback_type = 'needs_review' THEN 'feedback_type not allowed' ELSE 'valid' END FROM user_feedback) GROUP BY 1, 2""")
def _(t):
    """Titles blanked, severities and statuses outside the lists, a feedback type that is null."""
    cases = t.cases.withColumns({
        "title": F.when(F.col("id") % 11 == 0, " ").otherwise(F.col("title")),
        "severity": F.when(F.col("severity") != "low", F.col("severity")),
        "status": F.regexp_replace("status", "closed", "Closed")})
    feedback = t.user_feedback.withColumn("feedback_type", F.when(F.col("feedback_type") != "needs_review", F.col("feedback_type")))
    found = None
    for part, table, df in (("cases", "cases", cases), ("feedback", "feedback", feedback)):
        valid, rejected = P.validate(df, table)
        both = valid.select("id", F.lit("valid").alias("reason")).unionByName(rejected.select("id", "reason"))
        both = both.select(F.lit(part).alias("part"), "id", "reason")
        found = both if found is None else found.unionByName(both)
    return found.groupBy("part", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("p13_severity", """
SELECT id, CASE WHEN r > 80 THEN 'critical' WHEN r > 50 THEN 'high' WHEN r > 20 THEN 'medium' ELSE 'low' END AS trend,
  CASE WHEN r >= 80 THEN 'critical' WHEN r >= 50 THEN 'high' WHEN r >= 20 THEN 'medium' ELSE 'low' END AS entity,
  CASE WHEN r >= 80 THEN 'high' WHEN r >= 50 THEN 'medium' ELSE 'low' END AS anomaly
FROM (SELECT id, coalesce(risk_score, 0) AS r FROM anomalies)""")
def _(t):
    return t.anomalies.select("id", *[S.severity(F.col("risk_score"), k).alias(k) for k in S.SCALES])


@query("p14_login_features", f"""
WITH w AS (SELECT *, time_bucket(INTERVAL '1' DAY, ts, TIMESTAMP '1970-01-01') AS window_start FROM logins),
 first_seen AS (SELECT entity_id, device, time_bucket(INTERVAL '1' DAY, min(ts), TIMESTAMP '1970-01-01') AS window_start FROM logins GROUP BY 1, 2)
SELECT entity_id, window_start, count(*) AS login_count, count(DISTINCT ip) AS unique_ips,
  {R6.format("count(*) FILTER (WHERE failed) * 1.0e0 / count(*)")} AS failed_login_ratio,
  {R6.format("count(*) FILTER (WHERE hour(ts) < 8 OR hour(ts) >= 18) * 1.0e0 / count(*)")} AS off_hours_activity,
  CAST(sum(CAST(bytes AS DECIMAL(18,2))) AS DOUBLE) AS bytes_transferred,
  {R6.format("(epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7")} AS session_duration,
  CASE WHEN EXISTS (SELECT 1 FROM first_seen f WHERE f.entity_id = w.entity_id AND f.window_start = w.window_start) THEN 1 ELSE 0 END AS new_device_flag
FROM w GROUP BY entity_id, window_start""")
def _(t):
    out = P.login_features(t.logins)
    for c in ("failed_login_ratio", "off_hours_activity", "session_duration"):
        out = out.withColumn(c, S.round6(F.col(c)))
    return out


@query("p15_slugify", "SELECT p_partkey, translate(lower(concat(p_name, '_', p_type)), ' _', '--') AS slug FROM part")
def _(t):
    return t.part.select("p_partkey", S.slugify(F.concat_ws("_", "p_name", "p_type")).alias("slug"))


@query("p16_age_label", f"""
SELECT id, CASE WHEN m < 60 THEN concat(CAST(m AS VARCHAR), 'm ago') WHEN m < 1440 THEN concat(CAST(m // 60 AS VARCHAR), 'h ago')
 ELSE concat(CAST(m // 1440 AS VARCHAR), 'd ago') END AS age
FROM (SELECT id, (epoch_ms(TIMESTAMP '{AS_OF}') // 1000 - epoch_us(timestamp) // 1000000) // 60 AS m FROM anomalies)""")
def _(t):
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    return t.anomalies.select("id", S.age_label(F.col("timestamp"), as_of).alias("age"))


@query("l01_parse_logs", r"""
SELECT concat('web_', stamp) AS id, stamp AS timestamp, 'web' AS component,
  CASE WHEN contains(lower(message), 'error') OR contains(lower(message), 'exception') THEN 'error' WHEN contains(lower(message), 'warn') THEN 'warning' ELSE 'info' END AS level,
  substr(message, 1, 200) AS message
FROM (SELECT substr(line, 1, instr(line, ' ') - 1) AS stamp, substr(line, instr(line, ' ') + 1) AS message
 FROM (SELECT unnest(regexp_split_to_array(text, '\r\n|\n|\r')) AS line FROM documents) WHERE instr(line, ' ') > 0)""")
def _(t):
    return S.parse_logs(S.split_lines(t.documents, "text"), "web")
