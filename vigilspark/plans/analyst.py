"""Analyst questions: filters, joins, rollups, counters, rankings and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import filters as Q
from ..operators import joins as J
from ..operators import ranking as W
from ..operators import sets as U
from ..operators.suppress import suppress
from ..session import scratch_path
from .base import AS_OF, NOON, Tables, query

R6 = "floor(({}) * 1e6 + 0.5) / 1e6"


def _entities(t: Tables):
    return A.entity_rollup(t.anomalies)


ENTITIES = """(SELECT entity_id, coalesce(entity_type, 'user') AS entity_type, max(coalesce(risk_score, 0.0)) AS risk_score,
  count(*) AS anomaly_count, min(timestamp) AS first_seen, max(timestamp) AS last_seen
 FROM anomalies WHERE entity_id IS NOT NULL GROUP BY 1, 2)"""

# ------------------------------------------------------------------ filters


@query("f01_query_anomalies", """
SELECT * FROM anomalies WHERE model_id = 1 AND NOT acknowledged AND risk_score >= 50 AND risk_score <= 95
  AND timestamp >= TIMESTAMP '2024-01-05 00:00:00' AND timestamp <= TIMESTAMP '2024-01-25 00:00:00'
ORDER BY timestamp DESC, id LIMIT 100 OFFSET 20""")
def _(t):
    return Q.query_anomalies(
        t.anomalies, limit=100, offset=20, model_id=1, acknowledged=False, min_risk=50.0,
        max_risk=95.0, start="2024-01-05 00:00:00", end="2024-01-25 00:00:00",
    )


@query("f01_count_anomalies", """
SELECT count(*) AS total FROM anomalies WHERE entity_id = 'user-0007' AND risk_score >= 10""")
def _(t):
    return Q.count_anomalies(t.anomalies, entity_id="user-0007", min_risk=10.0)


@query("f02_query_cases", """
SELECT * FROM cases WHERE status = 'open' AND severity = 'high' AND assigned_to = 'analyst-2'
ORDER BY created_at DESC, id LIMIT 100""")
def _(t):
    return Q.query_cases(t.cases, status="open", severity="high", assigned_to="analyst-2")


@query("f03_query_alerts", """
SELECT * FROM alerts WHERE severity = 'critical' AND NOT acknowledged AND rule_id = 7
ORDER BY created_at DESC, id LIMIT 100""")
def _(t):
    return Q.query_alerts(t.alerts, severity="critical", acknowledged=False, rule_id=7)


@query("f04_query_rules", "SELECT * FROM rules WHERE enabled AND rule_type = 'flow'")
def _(t):
    return Q.query_rules(t.rules, enabled=True, rule_type="flow")


@query("f05_query_models", "SELECT * FROM models WHERE status = 'installed' AND enabled ORDER BY id LIMIT 10 OFFSET 2")
def _(t):
    return Q.query_table(t.models, {"status": "installed", "enabled": True, "version": None}, ["id"], 10, 2)


@query("f05_query_jobs", "SELECT * FROM jobs WHERE created_by = 'user-3' ORDER BY created_at DESC, id LIMIT 50")
def _(t):
    return Q.query_table(t.jobs, {"created_by": "user-3"}, ["-created_at", "id"], 50)


@query("f05_query_notifications", "SELECT * FROM notifications WHERE user_id = 3 AND NOT is_read")
def _(t):
    return Q.query_table(t.notifications, {"user_id": 3, "is_read": False}, limit=None)


@query("f06_search_anomalies", """
SELECT * FROM anomalies WHERE contains(lower(entity_id), 'user-00') AND coalesce(risk_score, 0) >= 50
  AND coalesce(risk_score, 0) < 80 AND NOT acknowledged AND model_id = 2""")
def _(t):
    return Q.search_anomalies(t.anomalies, "USER-00", "medium", False, 2)


@query("f06_search_cases", "SELECT * FROM cases WHERE contains(lower(title), 'case 12') AND status = 'closed'")
def _(t):
    return Q.search_cases(t.cases, "Case 12", status="closed")


@query("f06_search_entities", f"""
SELECT * FROM {ENTITIES} WHERE contains(lower(entity_id), '-01') AND entity_type = 'device' AND risk_score >= 80""")
def _(t):
    return Q.search_entities(_entities(t), "-01", "device", "critical")


@query("f06_search_alerts", """
SELECT a.*, r.name AS rule_name FROM alerts a LEFT JOIN rules r ON a.rule_id = r.id
WHERE (contains(lower(message), 'ring') OR contains(lower(entity_id), 'ring') OR contains(lower(r.name), 'ring'))
  AND a.severity = 'low' AND NOT acknowledged""")
def _(t):
    named = J.with_dimension(t.alerts, t.rules, ("rule_id", "id"), {"name": "rule_name"})
    return Q.search_alerts(named, "Ring", severity="low", acknowledged=False)


@query("f06_search_rules", "SELECT * FROM rules WHERE contains(lower(name), 'blue') AND rule_type = 'deviation'")
def _(t):
    return Q.search_rules(t.rules, "BLUE", rule_type="deviation")


@query("f07_search_all", """
SELECT * FROM supplier WHERE contains(lower(CAST(s_suppkey AS VARCHAR)), '7') OR contains(lower(s_name), '7')
  OR contains(lower(CAST(s_nationkey AS VARCHAR)), '7') OR contains(lower(CAST(s_acctbal AS VARCHAR)), '7')""")
def _(t):
    return Q.search_all(t.supplier, "7")


@query("f08_compare", """
SELECT event_id, value > 50 AS gt, value < 50 AS lt, value >= 6.55 AS ge, value <= 6.55 AS le,
  value = 6.55 AS eq, value <> 6.55 AS ne, false AS unknown FROM events""")
def _(t):
    v = F.col("value")
    return t.events.select(
        "event_id", S.compare(v, ">", 50).alias("gt"), S.compare(v, "<", 50).alias("lt"),
        S.compare(v, ">=", 6.55).alias("ge"), S.compare(v, "<=", 6.55).alias("le"),
        S.compare(v, "==", 6.55).alias("eq"), S.compare(v, "!=", 6.55).alias("ne"),
        S.compare(v, "~", 50).alias("unknown"),
    )


@query("f09_since", f"""
SELECT 'day' AS span, count(*) AS n FROM anomalies WHERE timestamp > TIMESTAMP '{AS_OF}' - INTERVAL '24' HOUR
UNION ALL SELECT 'week', count(*) FROM anomalies WHERE timestamp > TIMESTAMP '{AS_OF}' - INTERVAL '7' DAY
UNION ALL SELECT 'today', count(*) FROM anomalies WHERE timestamp >= TIMESTAMP '2024-01-30 00:00:00'""")
def _(t):
    spans = {"day": ("24 hours", AS_OF), "week": ("7 days", AS_OF), "today": ("today", NOON)}
    out = None
    for name, (interval, as_of) in spans.items():
        n = Q.since(t.anomalies, "timestamp", interval, as_of).agg(F.count(F.lit(1)).alias("n"))
        row = n.select(F.lit(name).alias("span"), "n")
        out = row if out is None else out.unionByName(row)
    return out


DETAIL = f"""SELECT e.*, coalesce(f.anomalies, 0) AS anomalies, coalesce(f.unacknowledged, 0) AS unacknowledged,
  f.latest_type, coalesce(c.open_cases, 0) AS open_cases
FROM {ENTITIES} e
LEFT JOIN (SELECT entity_id, coalesce(entity_type, 'user') AS entity_type, count(*) AS anomalies,
    count(*) FILTER (WHERE NOT acknowledged) AS unacknowledged, last(anomaly_type ORDER BY timestamp, id) AS latest_type
  FROM anomalies WHERE entity_id IS NOT NULL GROUP BY 1, 2) f
  ON e.entity_id = f.entity_id AND e.entity_type = f.entity_type
LEFT JOIN (SELECT a.entity_id, coalesce(a.entity_type, 'user') AS entity_type, count(DISTINCT l.case_id) AS open_cases
  FROM case_links l JOIN cases c ON l.case_id = c.id AND c.status <> 'closed' JOIN anomalies a ON a.id = l.anomaly_id
  WHERE a.entity_id IS NOT NULL GROUP BY 1, 2) c
  ON e.entity_id = c.entity_id AND e.entity_type = c.entity_type"""


@query("f10_entity_risk", f"SELECT * FROM ({DETAIL}) WHERE entity_id = 'user-0042'")
def _(t):
    return J.entity_risk(_entities(t), t.anomalies, t.cases, t.case_links, "user-0042")


# ------------------------------------------------------------------ joins


@query("j01_case_anomalies", """
SELECT c.id AS case_id, c.title, c.status, c.severity, l.anomaly_id, a.entity_id AS anomaly_entity_id,
  a.risk_score AS anomaly_risk_score
FROM cases c JOIN case_links l ON l.case_id = c.id JOIN anomalies a ON a.id = l.anomaly_id""")
def _(t):
    return J.case_anomalies(t.cases, t.case_links, t.anomalies).select(
        "case_id", "title", "status", "severity", "anomaly_id", "anomaly_entity_id", "anomaly_risk_score"
    )


@query("j02_case_documents", """
SELECT c.id, c.title, coalesce(page, 0) AS page, count(n) AS n, min(anomaly_id) AS first_id, max(anomaly_id) AS last_id, coalesce(max(risk_score), -1) AS top_risk
FROM cases c LEFT JOIN (SELECT l.case_id, l.anomaly_id, a.risk_score, n, CAST((n - 1) // 2 AS INT) AS page FROM (
   SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY anomaly_id) AS n FROM case_links) l JOIN anomalies a ON a.id = l.anomaly_id) p ON p.case_id = c.id
GROUP BY 1, 2, 3""")
def _(t):
    docs = J.case_documents(t.cases, t.case_links, t.anomalies, 2)
    return docs.select(
        "id", "title", "page", F.size("anomalies").cast("long").alias("n"), F.array_min("anomalies.id").alias("first_id"), F.array_max("anomalies.id").alias("last_id"),
        F.coalesce(F.array_max("anomalies.risk_score"), F.lit(-1.0)).alias("top_risk"),
    )


OPEN = """SELECT DISTINCT a.entity_id FROM case_links l JOIN cases c ON l.case_id = c.id JOIN anomalies a ON a.id = l.anomaly_id
WHERE c.status <> 'closed' AND a.entity_id <> ''"""


@query("j03_entities_with_open_case", OPEN)
def _(t):
    return J.entities_with_open_case(t.cases, t.case_links, t.anomalies)


@query("j04_entities_with_open_high_case", OPEN + " AND c.severity = 'high'")
def _(t):
    return J.entities_with_open_case(t.cases, t.case_links, t.anomalies, "high")


@query("j04_case_flags", f"""
SELECT id, coalesce(entity_id IN ({OPEN}), false) AS has_case,
  coalesce(entity_id IN ({OPEN} AND c.severity = 'high'), false) AS has_high FROM anomalies""")
def _(t):
    flagged = J.with_case_flags(
        t.anomalies, t.cases, t.case_links, t.anomalies, {"has_case": None, "has_high": "high"}
    )
    return flagged.select("id", "has_case", "has_high")


@query("j05_not_recently_alerted", """
SELECT k.* FROM (SELECT id, id % 200 AS rule_id, entity_id, 'high' AS severity FROM anomalies) k
WHERE NOT EXISTS (SELECT 1 FROM alerts a WHERE a.rule_id = k.rule_id AND a.entity_id = k.entity_id
  AND a.severity = k.severity AND a.created_at > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL '48' HOUR)""")
def _(t):
    candidates = t.anomalies.select(
        "id", (F.col("id") % 200).alias("rule_id"), "entity_id", F.lit("high").alias("severity")
    )
    return J.not_recently_alerted(candidates, t.alerts, "2024-01-20 12:00:00", "48 hours")


@query("j06_dimension_lookup", """
SELECT a.id, a.severity, r.name AS rule_name, r.rule_type FROM alerts a LEFT JOIN rules r ON a.rule_id = r.id""")
def _(t):
    named = J.with_dimension(
        t.alerts, t.rules, ("rule_id", "id"), {"name": "rule_name", "rule_type": "rule_type"}
    )
    return named.select("id", "severity", "rule_name", "rule_type")


@query("j07_resolve_model", """
SELECT r.*, v.model_id, v.version AS run_version, m.name AS model_name
FROM model_runs r LEFT JOIN model_versions v ON r.model_version_id = v.id LEFT JOIN models m ON v.model_id = m.id""")
def _(t):
    return J.resolve_model(t.model_runs, t.model_versions, t.models)


@query("j08_sync_jobs", """
SELECT j.id, j.model_run_id,
  CASE WHEN r.id IS NULL THEN j.status WHEN r.status = 'dispatched' THEN 'pending' ELSE r.status END AS status,
  CASE WHEN j.metrics IS NULL AND r.result_summary IS NOT NULL THEN r.result_summary ELSE j.metrics END AS metrics,
  coalesce(r.error_message, j.error_message) AS error_message, j.created_by, j.created_at,
  coalesce(r.started_at, j.started_at) AS started_at, coalesce(r.finished_at, j.completed_at) AS completed_at
FROM jobs j LEFT JOIN model_runs r ON j.model_run_id = r.id""")
def _(t):
    return J.sync_jobs(t.jobs, t.model_runs)


@query("j09_job_logs", """
SELECT job_id, log_id, level, message, created_at, from_run FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at, log_id) AS rn FROM (
    SELECT l.job_id, l.id AS log_id, l.level, l.message, l.created_at, false AS from_run
    FROM job_logs l JOIN jobs j ON l.job_id = j.id
    UNION ALL
    SELECT j.id, m.id, m.level, m.message, m.created_at, true FROM jobs j JOIN model_logs m ON m.model_run_id = j.model_run_id
    WHERE NOT EXISTS (SELECT 1 FROM job_logs l WHERE l.job_id = j.id)))
WHERE rn <= 20""")
def _(t):
    return J.job_logs(t.jobs, t.job_logs, t.model_logs, 20)


@query("j10_entity_detail", DETAIL)
def _(t):
    return J.entity_detail(_entities(t), t.anomalies, t.cases, t.case_links)


@query("j11_feedback_rates", f"""
SELECT model_id, feedback, true_positives, false_positives,
  {R6.format('true_positives * 1.0e0 / nullif(true_positives + false_positives, 0)')} AS true_positive_rate,
  {R6.format('false_positives * 1.0e0 / nullif(true_positives + false_positives, 0)')} AS false_positive_rate
FROM (SELECT a.model_id, count(*) AS feedback, count(*) FILTER (WHERE feedback_type = 'true_positive') AS true_positives,
   count(*) FILTER (WHERE feedback_type = 'false_positive') AS false_positives
  FROM user_feedback f JOIN anomalies a ON a.id = f.anomaly_id GROUP BY 1)""")
def _(t):
    rates = J.feedback_rates(t.anomalies, t.user_feedback)
    for c in ("true_positive_rate", "false_positive_rate"):
        rates = rates.withColumn(c, S.round6(F.col(c)))
    return rates


@query("j11_feedback_of", """
SELECT f.*, a.entity_id, a.anomaly_type FROM user_feedback f JOIN anomalies a ON a.id = f.anomaly_id WHERE a.id = 77""")
def _(t):
    return J.feedback_of(t.anomalies, t.user_feedback, 77)


@query("j12_audit_hashes", """
SELECT part, status, count(*) AS n FROM (SELECT 'copy' AS part, 'ok' AS status FROM (SELECT DISTINCT lang FROM documents)
 UNION ALL SELECT 'swapped', 'mismatch' FROM (SELECT DISTINCT lang FROM documents) UNION ALL SELECT 'gone', 'missing' FROM region) GROUP BY 1, 2""")
def _(t):
    """Two folders of files by language, as many as the writing tasks make; the second holds other contents.

    A language is judged by the worst of its files.
    """
    path = scratch_path(t.spark, "audited")
    for part, text in (("copy", F.col("text")), ("swapped", F.upper("text"))):
        t.documents.select("lang", text.alias("text")).write.partitionBy("lang").parquet(f"{path}/{part}")
    files = J.hash_files(t.spark, path, "*.parquet")
    manifest = files.select(
        "file", F.when(F.col("file").startswith("copy/"), F.col("actual_hash")).otherwise("0").alias("expected_hash")
    ).unionByName(t.region.select(F.concat(F.lit("gone/"), "r_name").alias("file"), F.lit("0").alias("expected_hash")))
    found = J.audit_hashes(files, manifest)
    # The worse of "mismatch", "missing" and "ok" is the lesser text.
    folders = found.groupBy(F.substring_index("file", "/", 2).alias("folder")).agg(F.min("status").alias("status"))
    return folders.groupBy(F.substring_index("folder", "/", 1).alias("part"), "status").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ rollups and counters


@query("a01_entity_rollup", f"SELECT * FROM {ENTITIES}")
def _(t):
    return _entities(t)


@query("a02_merge_entities", f"SELECT * FROM {ENTITIES}")
def _(t):
    cut = Q.moment("2024-01-20 00:00:00")
    older = A.entity_rollup(t.anomalies.where(F.col("timestamp") < cut))
    return A.merge_entities(older, t.anomalies.where(F.col("timestamp") >= cut))


@query("a02_merge_entities_keep_first", f"""
SELECT e.entity_id, e.entity_type, e.risk_score, e.anomaly_count, coalesce(k.first_seen, e.first_seen) AS first_seen, e.last_seen
FROM {ENTITIES} e LEFT JOIN (SELECT entity_id, coalesce(entity_type, 'user') AS entity_type, min(timestamp) AS first_seen
  FROM anomalies WHERE entity_id IS NOT NULL AND timestamp >= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1, 2) k
  ON e.entity_id = k.entity_id AND e.entity_type = k.entity_type""")
def _(t):
    cut = Q.moment("2024-01-20 00:00:00")
    known = A.entity_rollup(t.anomalies.where(F.col("timestamp") >= cut))
    return A.merge_entities(known, t.anomalies.where(F.col("timestamp") < cut), keep_first_seen=True)


@query("a03_home_summary", """
SELECT (SELECT count(*) FROM models) AS total_models, (SELECT count(*) FROM models WHERE enabled) AS active_models,
  (SELECT count(*) FROM anomalies) AS total_anomalies, (SELECT count(*) FROM anomalies WHERE NOT acknowledged) AS unacknowledged_anomalies,
  (SELECT count(*) FROM cases WHERE status = 'open') AS open_cases""")
def _(t):
    return A.home_summary(t.models, t.anomalies, t.cases)


@query("a04_console_kpis", """
SELECT (SELECT count(*) FROM models) AS total_models,
  (SELECT count(*) FROM models WHERE status = 'active' OR enabled) AS active_models,
  (SELECT count(*) FROM anomalies) AS total_anomalies, (SELECT count(*) FROM anomalies WHERE NOT acknowledged) AS unacknowledged_anomalies,
  (SELECT count(DISTINCT entity_id) FROM anomalies) AS monitored_entities,
  (SELECT count(DISTINCT entity_id) FROM anomalies WHERE risk_score > 70) AS high_risk_entities,
  (SELECT count(*) FROM cases WHERE status <> 'closed') AS open_cases""")
def _(t):
    return A.console_kpis(t.models, t.anomalies, t.cases)


@query("a05_risk_trend", f"""
SELECT CAST(d.day AS DATE) AS day, count(*) FILTER (WHERE r > 80) AS critical, count(*) FILTER (WHERE r > 50 AND r <= 80) AS high,
  count(*) FILTER (WHERE r > 20 AND r <= 50) AS medium, count(*) FILTER (WHERE r <= 20) AS low
FROM (SELECT unnest(generate_series(DATE '2024-01-25', DATE '2024-01-31', INTERVAL '1' DAY)) AS day) d
LEFT JOIN (SELECT CAST(timestamp AS DATE) AS day, coalesce(risk_score, 0) AS r FROM anomalies) a ON CAST(d.day AS DATE) = a.day GROUP BY 1""")
def _(t):
    return A.risk_trend(t.anomalies, AS_OF)


@query("a06_anomaly_severity", """
SELECT 'high' AS name, count(*) FILTER (WHERE risk_score >= 80) AS value FROM anomalies
UNION ALL SELECT 'medium', count(*) FILTER (WHERE risk_score >= 50 AND risk_score < 80) FROM anomalies
UNION ALL SELECT 'low', count(*) FILTER (WHERE coalesce(risk_score, 0) < 50) FROM anomalies""")
def _(t):
    return A.anomaly_severity(t.anomalies)


@query("a07_case_breakdown", """
SELECT 'severity' AS section, s.name, count(c.id) AS value FROM (SELECT unnest(['low', 'medium', 'high', 'critical']) AS name) s
  LEFT JOIN cases c ON c.severity = s.name GROUP BY 2
UNION ALL SELECT 'status', status, count(*) FROM cases GROUP BY 2
UNION ALL SELECT 'group', 'open', count(*) FROM cases WHERE status IN ('open', 'investigating')
UNION ALL SELECT 'group', 'critical_high', count(*) FROM cases WHERE severity IN ('critical', 'high')
UNION ALL SELECT 'group', 'resolved', count(*) FROM cases WHERE status IN ('resolved', 'closed')""")
def _(t):
    return A.case_breakdown(t.cases)


@query("a08_anomalies_by_day", """
SELECT CAST(timestamp AS DATE) AS day, count(*) AS total, count(*) FILTER (WHERE risk_score >= 80) AS high
FROM anomalies GROUP BY 1 ORDER BY 1 DESC LIMIT 14""")
def _(t):
    return A.by_day(t.anomalies, "timestamp", {"high": F.col("risk_score") >= 80})


@query("a09_alerts_by_day", """
SELECT CAST(created_at AS DATE) AS day, count(*) AS total, count(*) FILTER (WHERE severity IN ('critical', 'high')) AS critical
FROM alerts GROUP BY 1 ORDER BY 1 DESC LIMIT 14""")
def _(t):
    return A.by_day(t.alerts, "created_at", {"critical": F.col("severity").isin("critical", "high")})


@query("a10_cases_by_day", "SELECT CAST(created_at AS DATE) AS day, count(*) AS total FROM cases GROUP BY 1 ORDER BY 1 DESC LIMIT 14")
def _(t):
    return A.by_day(t.cases, "created_at")


@query("a11_anomaly_kpis", """
SELECT count(*) AS total, count(*) FILTER (WHERE risk_score >= 80) AS high, count(*) FILTER (WHERE NOT acknowledged) AS unacknowledged,
  CAST(floor(CAST(sum(CAST(coalesce(risk_score, 0) AS DECIMAL(18,2))) AS DOUBLE) / count(*) + 0.5) AS BIGINT) AS mean_risk FROM anomalies""")
def _(t):
    return A.anomaly_kpis(t.anomalies)


@query("a12_entity_kpis", f"""
SELECT count(*) AS total, count(*) FILTER (WHERE entity_type = 'user') AS users, count(*) FILTER (WHERE entity_type <> 'user') AS non_users,
  count(*) FILTER (WHERE risk_score >= 70) AS high_risk FROM {ENTITIES}""")
def _(t):
    return A.entity_kpis(_entities(t))


@query("a12_entity_breakdown", f"""
SELECT 'type' AS section, entity_type AS name, count(*) AS value FROM {ENTITIES} GROUP BY 2
UNION ALL SELECT 'risk', b.name, count(e.risk_score) FROM (SELECT unnest(['critical', 'high', 'medium', 'low']) AS name) b
 LEFT JOIN (SELECT risk_score, CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 50 THEN 'high'
   WHEN risk_score >= 20 THEN 'medium' ELSE 'low' END AS name FROM {ENTITIES}) e ON e.name = b.name GROUP BY 2""")
def _(t):
    return A.entity_breakdown(_entities(t))


@query("a13_alert_kpis", """
SELECT count(*) AS total, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high,
  count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low,
  count(*) FILTER (WHERE NOT acknowledged) AS unacknowledged,
  count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-01-30 00:00:00') AS fired_today FROM alerts""")
def _(t):
    return A.alert_kpis(t.alerts, NOON)


@query("a14_rule_kpis", """
SELECT 'rules' AS section, 'total' AS name, count(*) AS value FROM rules
UNION ALL SELECT 'rules', 'active', count(*) FROM rules WHERE enabled
UNION ALL SELECT 'rules', 'triggered_today', count(*) FROM rules
  WHERE id IN (SELECT rule_id FROM alerts WHERE created_at >= TIMESTAMP '2024-01-30 00:00:00')
UNION ALL SELECT 'type', rule_type, count(*) FROM rules GROUP BY 2
UNION ALL SELECT 'alert_severity', severity, count(*) FROM alerts GROUP BY 2""")
def _(t):
    return A.rule_kpis(t.rules, t.alerts, NOON)


@query("a15_system_state", f"""
SELECT (SELECT count(*) FROM anomalies WHERE timestamp > TIMESTAMP '{AS_OF}' - INTERVAL '24' HOUR) AS anomalies_24h,
  (SELECT count(*) FROM models WHERE enabled) AS enabled_models, (SELECT count(*) FROM alerts WHERE NOT acknowledged) AS unacknowledged_alerts,
  (SELECT count(*) FROM cases WHERE status = 'open') AS open_cases, (SELECT count(*) FROM rules WHERE enabled) AS enabled_rules,
  (SELECT count(*) FROM {ENTITIES}) AS entities""")
def _(t):
    return A.system_state(t.anomalies, t.models, t.alerts, t.cases, t.rules, _entities(t), AS_OF)


@query("a16_top_types", f"""
SELECT anomaly_type, count(*) AS n FROM anomalies WHERE timestamp > TIMESTAMP '{AS_OF}' - INTERVAL '7' DAY
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def _(t):
    return A.top_types(t.anomalies, AS_OF)


@query("a17_unacked_by_severity", "SELECT severity, count(*) AS n FROM alerts WHERE NOT acknowledged GROUP BY 1")
def _(t):
    return A.unacked_by_severity(t.alerts)


VOLUMES = """(SELECT id, status, completed_at,
  CAST(details->>'$.spark.ssh.row_count' AS BIGINT) + CAST(details->>'$.spark.dns.row_count' AS BIGINT) AS "rows",
  CAST(details->>'$.elasticsearch.ssh.document_count' AS BIGINT) AS documents,
  CAST(details->>'$.elasticsearch.ssh.failed' AS BIGINT) AS failed FROM ingestion_runs)"""


@query("a18_ingestion_history", f"""
SELECT coalesce(s.day, g.day) AS day, floor(coalesce(r + d, 0) / 1024 * 100 + 0.5) / 100 AS value,
  floor(coalesce(r, 0) / 1024 * 100 + 0.5) / 100 AS spark, floor(coalesce(d, 0) / 1024 * 100 + 0.5) / 100 AS search
FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-25', DATE '2024-01-31', INTERVAL '1' DAY)) AS DATE) AS day) s
FULL JOIN (SELECT CAST(completed_at AS DATE) AS day, CAST(sum("rows") AS DOUBLE) AS r, CAST(sum(documents) AS DOUBLE) AS d FROM {VOLUMES}
  WHERE status = 'completed' AND completed_at >= TIMESTAMP '{AS_OF}' - INTERVAL '7' DAY GROUP BY 1) g ON s.day = g.day""")
def _(t):
    return A.ingestion_history(t.ingestion_runs, AS_OF)


@query("a19_ingestion_totals", f"""SELECT id, status, "rows", documents, failed FROM {VOLUMES}""")
def _(t):
    return A.ingestion_totals(t.ingestion_runs)


@query("a20_log_levels", """
SELECT model_run_id, count(*) AS lines, count(*) FILTER (WHERE level = 'error') AS errors,
  count(*) FILTER (WHERE level = 'warning') AS warnings FROM model_logs GROUP BY 1""")
def _(t):
    return A.log_levels(t.model_logs)


@query("a21_inference_summary", """
SELECT count(*) AS anomaly_count, count(*) FILTER (WHERE coalesce(risk_score, 0) >= 50) AS high_risk FROM anomalies""")
def _(t):
    return A.inference_summary(t.anomalies)


@query("a22_confusion", f"""
SELECT tp, fp, fn, tn, {R6.format('p')} AS precision, {R6.format('r')} AS recall, {R6.format('2 * p * r / (p + r)')} AS f1
FROM (SELECT *, tp * 1.0e0 / (tp + fp) AS p, tp * 1.0e0 / (tp + fn) AS r FROM (
 SELECT count(*) FILTER (WHERE detected AND truth) AS tp, count(*) FILTER (WHERE detected AND NOT truth) AS fp,
  count(*) FILTER (WHERE NOT detected AND truth) AS fn, count(*) FILTER (WHERE NOT detected AND NOT truth) AS tn FROM scored))""")
def _(t):
    out = A.confusion(t.scored, "detected", "truth")
    for c in ("precision", "recall", "f1"):
        out = out.withColumn(c, S.round6(F.col(c)))
    return out


@query("a23_auc", f"""
SELECT p AS positives, n AS negatives, {R6.format('w / (2.0e0 * p * n)')} AS auc FROM (
 SELECT CAST(sum(pos) AS BIGINT) AS p, CAST(sum(neg) AS BIGINT) AS n, CAST(sum(pos * (2 * cum - neg)) AS DOUBLE) AS w FROM (
  SELECT pos, neg, sum(neg) OVER (ORDER BY score) AS cum FROM (
   SELECT score, count(*) FILTER (WHERE truth) AS pos, count(*) FILTER (WHERE NOT truth) AS neg FROM scored GROUP BY 1)))""")
def _(t):
    return A.auc(t.scored, "score", "truth").withColumn("auc", S.round6(F.col("auc")))


def _profile_sql(name: str, dtype: str, expr: str | None, col: str) -> str:
    if expr is None:
        stats = "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max"
    else:
        stats = (
            f"{R6.format(f'avg({expr})')} AS mean, {R6.format(f'stddev_samp({expr})')} AS std, "
            f"min({expr}) AS min, max({expr}) AS max"
        )
    return (
        f"SELECT '{name}' AS name, '{dtype}' AS dtype, {stats}, "
        f"{R6.format(f'count(*) FILTER (WHERE {col} IS NULL) * 1.0e0 / count(*)')} AS null_rate FROM holed"
    )


@query("a24_profile_features", " UNION ALL ".join([
    _profile_sql("id", "bigint", "CAST(id AS DOUBLE)", "id"),
    _profile_sql("amount", "double", "amount", "amount"),
    _profile_sql("weight", "double", "weight", "weight"),
]))
def _(t):
    out = A.profile_features(t.holed)
    for c in ("mean", "std", "null_rate"):
        out = out.withColumn(c, S.round6(F.col(c)))
    return out


def _two(e: str) -> str:
    return f"floor(({e}) * 100 + 0.5) / 100"


def _describe_sql(col: str) -> str:
    return f"""SELECT event_type, '{col}' AS "column", count({col}) AS count, {_two(f'avg({col})')} AS mean,
  {_two(f'stddev_samp({col})')} AS std, {_two(f'min({col})')} AS min, {_two(f'quantile_cont({col}, 0.25)')} AS q25,
  {_two(f'quantile_cont({col}, 0.5)')} AS q50, {_two(f'quantile_cont({col}, 0.75)')} AS q75, {_two(f'max({col})')} AS max
FROM scored_wide GROUP BY 1"""


@query("a25_describe_by", f"""
WITH scored_wide AS (SELECT event_type, value, CAST(user_id AS DOUBLE) AS user_no FROM events)
{_describe_sql('value')} UNION ALL {_describe_sql('user_no')}""")
def _(t):
    wide = t.events.select("event_type", "value", F.col("user_id").cast("double").alias("user_no"))
    return A.describe_by(wide, "event_type", ["value", "user_no"])


@query("a26_histogram", f"""
WITH s AS (SELECT min(score) AS lo, (max(score) - min(score)) / 30 AS w FROM scored),
 b AS (SELECT event_type, CAST(least(floor((score - (SELECT lo FROM s)) / (SELECT w FROM s)), 29) AS INT) AS bin FROM scored),
 spine AS (SELECT event_type, bin FROM (SELECT DISTINCT event_type FROM scored), (SELECT CAST(unnest(generate_series(0, 29)) AS INT) AS bin))
SELECT spine.event_type, spine.bin, {R6.format('(SELECT lo FROM s) + spine.bin * (SELECT w FROM s)')} AS left_edge, count(b.bin) AS n
FROM spine LEFT JOIN b ON b.event_type = spine.event_type AND b.bin = spine.bin GROUP BY 1, 2""")
def _(t):
    return A.histogram(t.scored, "score", 30, "event_type").withColumn("left_edge", S.round6(F.col("left_edge")))


@query("a27_heatmap", "SELECT CAST(dayofweek(ts) + 1 AS INT) AS weekday, " + ", ".join(
    R6.format(
        f"CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (WHERE hour(ts) = {h}) AS DOUBLE) / count(*) FILTER (WHERE hour(ts) = {h})"
    ) + f" AS h{h:02d}" for h in range(24)
) + " FROM events GROUP BY 1")
def _(t):
    out = A.heatmap(t.events, "ts", "value")
    return out.select("weekday", *[S.round6(F.col(c)).alias(c) for c in out.columns[1:]])


@query("a28_profile_dataset", """
SELECT count(*) AS row_count, 6 AS column_count, 'event_id,ts,user_id,event_type,value,props' AS columns FROM events""")
def _(t):
    return A.profile_dataset(t.events)


@query("a29_count_where", """
SELECT 'open anomalies of model 1' AS what, count(*) AS n FROM anomalies WHERE model_id = 1 AND NOT acknowledged
UNION ALL SELECT 'closed cases', count(*) FROM cases WHERE status = 'closed'""")
def _(t):
    first = A.count_where(t.anomalies, model_id=1, acknowledged=False)
    second = A.count_where(t.cases, status="closed")
    return first.select(F.lit("open anomalies of model 1").alias("what"), "n").unionByName(
        second.select(F.lit("closed cases").alias("what"), "n")
    )


@query("a30_compare_runs", """
SELECT id, experiment_id, CAST(metrics->>'$.precision' AS DOUBLE) AS precision, CAST(metrics->>'$.recall' AS DOUBLE) AS recall
FROM experiment_runs""")
def _(t):
    return A.compare_runs(t.experiment_runs)


@query("a30_best_runs", """
SELECT experiment_id, metric, min_by(id, (-value, id)) AS run_id, max(value) AS value FROM (
 SELECT id, experiment_id, 'precision' AS metric, CAST(metrics->>'$.precision' AS DOUBLE) AS value FROM experiment_runs
 UNION ALL SELECT id, experiment_id, 'recall', CAST(metrics->>'$.recall' AS DOUBLE) FROM experiment_runs) GROUP BY 1, 2""")
def _(t):
    return A.best_runs(t.experiment_runs)


@query("a31_training_curves", """
SELECT job_id, CAST(coalesce(epoch, step) AS BIGINT) AS x, max(metric_value) FILTER (WHERE metric_name = 'loss') AS loss,
  max(metric_value) FILTER (WHERE metric_name = 'f1') AS f1, max(metric_value) FILTER (WHERE metric_name = 'auc') AS auc
FROM training_metrics GROUP BY 1, 2""")
def _(t):
    return A.training_curves(t.training_metrics, ["loss", "f1", "auc"])


@query("a32_unread_counts", "SELECT user_id, count(*) FILTER (WHERE NOT is_read) AS unread FROM notifications GROUP BY 1")
def _(t):
    return A.unread_counts(t.notifications)


@query("a33_weighted_risk", """
SELECT entity_id, least(100.0e0, CAST(sum(CAST(coalesce(risk_score, 0) AS DECIMAL(18,2)) * CAST(CASE anomaly_type WHEN 'error' THEN 0.5
  WHEN 'purchase' THEN 0.02 ELSE 0.01 END AS DECIMAL(9,4))) AS DOUBLE)) AS weighted_risk
FROM anomalies WHERE entity_id IS NOT NULL GROUP BY 1""")
def _(t):
    return A.weighted_risk(t.anomalies, {"error": 0.5, "purchase": 0.02}, default=0.01)


@query("a34_volume_anomaly", """
SELECT 'system' AS entity_id, 'data_volume' AS entity_type, 0.7e0 AS risk_score, 'high_data_volume' AS anomaly_type,
  concat('{"row_count":', CAST(count(*) AS VARCHAR), ',"threshold":10000}') AS details FROM lineitem HAVING count(*) > 10000""")
def _(t):
    return A.volume_anomaly(t.lineitem)


@query("a34_volume_anomaly_by_source", """
SELECT event_type AS entity_id, 'data_volume' AS entity_type, 0.7e0 AS risk_score, 'high_data_volume' AS anomaly_type,
  concat('{"row_count":', CAST(count(*) AS VARCHAR), ',"threshold":2000}') AS details FROM events GROUP BY 1 HAVING count(*) > 2000""")
def _(t):
    return A.volume_anomaly(t.events, 2000, "event_type")


# ------------------------------------------------------------------ rankings


@query("w01_top_entities", f"SELECT * FROM {ENTITIES} ORDER BY risk_score DESC, entity_id, entity_type LIMIT 20")
def _(t):
    return W.top_entities(_entities(t), 20)


@query("w02_recent", "SELECT * FROM anomalies ORDER BY timestamp DESC, id LIMIT 10")
def _(t):
    return W.recent(t.anomalies, 10)


@query("w03_latest_version", """
SELECT v.model_id, v.id, v.version, v.installed_at FROM (
 SELECT v.*, row_number() OVER (PARTITION BY v.model_id ORDER BY (v.id = m.default_version_id) IS TRUE DESC, installed_at DESC, v.id DESC) AS rn
 FROM model_versions v LEFT JOIN models m ON v.model_id = m.id) v WHERE rn = 1""")
def _(t):
    default = t.models.select(F.col("id").alias("model_id"), F.col("default_version_id").alias("default_id"))
    return W.latest(t.model_versions, "model_id", "installed_at", default)


@query("w03_last_run", """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY model_version_id ORDER BY created_at DESC, id DESC) AS rn FROM model_runs) WHERE rn = 1""")
def _(t):
    return W.latest(t.model_runs, "model_version_id", "created_at")


@query("w04_activity_feed", """
SELECT * FROM (
 SELECT concat('anomaly-', CAST(id AS VARCHAR)) AS id, 'System' AS actor, concat('Anomaly detected: ', anomaly_type) AS action, timestamp,
  CASE WHEN risk_score > 80 THEN 'error' ELSE 'warning' END AS type FROM anomalies
 UNION ALL SELECT concat('case-', CAST(id AS VARCHAR)), 'Analyst', concat('Case created: ', title), created_at, 'info' FROM cases)
ORDER BY timestamp DESC, id LIMIT 50""")
def _(t):
    return W.activity_feed(t.anomalies, t.cases, 50)


@query("w05_cumulative_risk", """
SELECT id, entity_id, timestamp, CAST(sum(CAST(coalesce(risk_score, 0) AS DECIMAL(18,2))) OVER (PARTITION BY entity_id ORDER BY timestamp, id
  ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cumulative_risk FROM anomalies WHERE entity_id IS NOT NULL""")
def _(t):
    return W.cumulative_risk(t.anomalies)


@query("w06_page", "SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 10 OFFSET 30")
def _(t):
    return Q.page(t.lineitem, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], 10, 30)


@query("w06_deep_page", """
SELECT event_id, ts, user_id, row_number() OVER (ORDER BY ts DESC, event_id) AS place FROM events ORDER BY place LIMIT 60000 OFFSET 500""")
def _(t):
    return Q.page(t.events.select("event_id", "ts", "user_id"), ["-ts", "event_id"], 60000, 500, place="place")


@query("w07_status_transitions", """
SELECT * FROM (SELECT run_id, ts, id, status, lag(status) OVER (PARTITION BY run_id ORDER BY ts, id) AS previous FROM run_status)
WHERE previous IS NULL OR previous <> status""")
def _(t):
    return W.status_transitions(t.run_status)


KEPT = """WITH RECURSIVE c AS (SELECT entity_id, created_at, min(id) AS id FROM alert_candidates GROUP BY 1, 2),
 kept AS (SELECT entity_id, min(created_at) AS created_at FROM c GROUP BY 1
  UNION ALL SELECT k.entity_id, (SELECT min(c.created_at) FROM c WHERE c.entity_id = k.entity_id AND c.created_at >= k.created_at + INTERVAL '1' HOUR) AS created_at
  FROM kept k WHERE k.created_at IS NOT NULL)
SELECT c.id, 0 AS rule_id, c.entity_id, 'high' AS severity, c.created_at FROM kept JOIN c ON c.entity_id = kept.entity_id AND c.created_at = kept.created_at"""


@query("w08_suppress", KEPT)
def _(t):
    return suppress(t.alert_candidates, ["rule_id", "entity_id", "severity"])


@query("w08_suppress_run", """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY rule_id, entity_id, severity ORDER BY created_at, id) AS rn FROM alerts) WHERE rn = 1""")
def _(t):
    return suppress(t.alerts, ["rule_id", "entity_id", "severity"], mode="run")


@query("w09_cap_alerts", """
SELECT * FROM (SELECT id % 4 AS rule_order, id AS anomaly_id, 0 AS alert_node, entity_id, risk_score FROM anomalies)
ORDER BY rule_order, coalesce(risk_score, 0) DESC, anomaly_id LIMIT 3000""")
def _(t):
    fired = t.anomalies.select(
        (F.col("id") % 4).alias("rule_order"), F.col("id").alias("anomaly_id"), F.lit(0).alias("alert_node"), "entity_id", "risk_score"
    )
    return W.within_budget(fired, 3000)


# ------------------------------------------------------------------ sets


@query("u01_extract_users", "SELECT DISTINCT coalesce(entity_id, 'NA') AS user FROM anomalies")
def _(t):
    return U.extract_users(t.anomalies, "entity_id")


@query("u02_merge_users", """
SELECT DISTINCT entity_id AS user FROM alerts UNION SELECT coalesce(entity_id, 'NA') FROM anomalies""")
def _(t):
    return U.merge_users(U.extract_users(t.alerts, "entity_id"), U.extract_users(t.anomalies, "entity_id"))


@query("u03_extract_all", """
SELECT DISTINCT 'events' AS log_name, CAST(user_id AS VARCHAR) AS user FROM events
UNION SELECT 'orders', CAST(o_custkey AS VARCHAR) FROM orders UNION SELECT 'anomalies', coalesce(entity_id, 'NA') FROM anomalies""")
def _(t):
    return U.extract_all({
        "events": (t.events, "user_id"), "orders": (t.orders, "o_custkey"), "anomalies": (t.anomalies, "entity_id"),
    })


@query("u04_union_tagged", """
SELECT 'anomalies' AS origin, id, entity_id, risk_score, CAST(NULL AS VARCHAR) AS severity FROM anomalies
UNION ALL SELECT 'alerts', id, entity_id, NULL, severity FROM alerts""")
def _(t):
    return U.union_tagged({
        "anomalies": t.anomalies.select("id", "entity_id", "risk_score"),
        "alerts": t.alerts.select("id", "entity_id", "severity"),
    })


@query("u05_metric_names", "SELECT DISTINCT unnest(json_keys(metrics)) AS name FROM experiment_runs")
def _(t):
    return U.distinct_keys(t.experiment_runs, F.from_json("metrics", "map<string,double>"))


@query("u05_rules_in_alerts", "SELECT id, name FROM rules WHERE id IN (SELECT rule_id FROM alerts)")
def _(t):
    return U.rules_in_alerts(t.alerts, t.rules)
