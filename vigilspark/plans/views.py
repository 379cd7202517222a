"""Platform tables derived from the given tables.

One SQL text per view, run by Spark here and by the oracle engine as a common
table expression, so both sides start from the same rows. ``{name}`` stands for
a given table. All rows of the given tables take part.
"""

from __future__ import annotations

import re

from .graphs import BAD_PARTS, BAD_THRESHOLD, CHECKED, CYCLE, GRAPHS, RISK_ABOVE, sql_case

VIEWS: dict[str, str] = {
    "anomalies": """
SELECT event_id AS id, CAST(event_id % 3 AS INT) AS model_id, CAST(event_id % 12 AS INT) AS run_id,
  CASE WHEN event_id % 50 = 0 THEN NULL ELSE concat('user-', lpad(CAST(user_id AS STRING), 4, '0')) END AS entity_id,
  CASE WHEN event_type = 'signup' THEN NULL WHEN event_type = 'error' THEN 'device' ELSE 'user' END AS entity_type,
  ts AS timestamp,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE least(CAST(100 AS DOUBLE), value) END AS risk_score,
  CASE WHEN event_type IN ('view', 'click') THEN 'normal' ELSE event_type END AS anomaly_type,
  props AS details, event_id % 4 = 0 AS acknowledged
FROM {events}""",
    "cases": """
SELECT o_orderkey AS id, concat('case ', CAST(o_orderkey AS STRING)) AS title,
  CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'investigating' ELSE 'closed' END AS status,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS severity,
  concat('analyst-', CAST(o_custkey % 5 AS STRING)) AS assigned_to, o_orderdate AS created_at
FROM {orders}""",
    # Every event is linked to a case, strong ones to two.
    "case_links": """
SELECT event_id * 7 AS case_id, event_id AS anomaly_id FROM {events}
UNION ALL SELECT event_id + 1 AS case_id, event_id AS anomaly_id FROM {events} WHERE value >= 200""",
    "user_feedback": """
SELECT event_id AS id, event_id AS anomaly_id,
  CASE event_id % 3 WHEN 0 THEN 'true_positive' WHEN 1 THEN 'false_positive' ELSE 'needs_review' END AS feedback_type,
  concat('analyst-', CAST(user_id % 5 AS STRING)) AS user_id
FROM {events}""",
    "rules": """
SELECT p_partkey AS id, p_name AS name,
  CASE p_size % 3 WHEN 0 THEN 'flow' WHEN 1 THEN 'single-fire' ELSE 'deviation' END AS rule_type,
  p_size <= 40 AS enabled,
  CASE p_size % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity,
  p_partkey % 3 AS model_no, p_size AS shape
FROM {part}""",
    "alerts": """
SELECT event_id AS id, event_id % 200 AS rule_id,
  CASE WHEN value >= 80 THEN 'critical' WHEN value >= 50 THEN 'high' WHEN value >= 20 THEN 'medium' ELSE 'low' END AS severity,
  concat('rule triggered by ', event_type) AS message,
  concat('user-', lpad(CAST(user_id AS STRING), 4, '0')) AS entity_id, 'user' AS entity_type,
  event_id % 5 = 0 AS acknowledged, ts AS created_at
FROM {events}""",
    "alert_candidates": """
SELECT event_id AS id, 0 AS rule_id, concat('user-', CAST(user_id % 5 AS STRING)) AS entity_id,
  'high' AS severity, ts AS created_at
FROM {events}""",
    "models": """
SELECT s_suppkey AS id, s_name AS name, concat('1.', CAST(s_nationkey AS STRING), '.0') AS version,
  CASE s_nationkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'installed' ELSE 'disabled' END AS status,
  s_acctbal > 2000 AS enabled,
  CASE WHEN s_nationkey % 4 = 1 THEN s_suppkey * 20 + 3 END AS default_version_id
FROM {supplier}""",
    "model_versions": """
SELECT p_partkey AS id, CAST((p_partkey - p_partkey % 20) / 20 AS BIGINT) AS model_id,
  concat('1.', CAST(p_size AS STRING), '.0') AS version,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' DAY * p_size AS installed_at
FROM {part}""",
    "model_runs": """
SELECT o_orderkey AS id, o_custkey AS model_version_id,
  CASE WHEN o_orderkey % 3 = 0 THEN 'train' ELSE 'infer' END AS run_type,
  CASE o_orderstatus WHEN 'O' THEN 'dispatched' WHEN 'F' THEN 'succeeded' ELSE 'failed' END AS status,
  CASE WHEN o_orderstatus = 'P' THEN 'boom' END AS error_message,
  CASE WHEN o_orderstatus = 'F' THEN '{{"f1": 0.9}}' END AS result_summary,
  o_orderdate AS created_at,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL '1' MINUTE END AS started_at,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL '5' MINUTE END AS finished_at
FROM {orders}""",
    "jobs": """
SELECT o_orderkey + 1000000000 AS id, CASE WHEN o_orderkey % 40 = 1 THEN NULL ELSE o_orderkey END AS model_run_id,
  'running' AS status, CASE WHEN o_custkey % 6 = 1 THEN '{{"f1": 0.5}}' END AS metrics,
  CASE WHEN o_orderkey % 7 = 0 THEN 'old error' END AS error_message,
  concat('user-', CAST(o_custkey % 5 AS STRING)) AS created_by, o_orderdate AS created_at,
  o_orderdate AS started_at, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate END AS completed_at
FROM {orders}""",
    "model_logs": """
SELECT event_id AS id, user_id * 10 + 1 AS model_run_id,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'warning' ELSE 'info' END AS level,
  concat(event_type, ' ', CAST(event_id AS STRING)) AS message, ts AS created_at
FROM {events}""",
    "job_logs": """
SELECT event_id AS id, user_id * 20 + 1000000001 AS job_id, 'info' AS level, event_type AS message, ts AS created_at
FROM {events}""",
    "ingestion_runs": """
SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, ts AS completed_at,
  concat('{{"spark": {{"ssh": {{"row_count": ', CAST(user_id * 100 AS STRING), '}}, "dns": {{"row_count": ', CAST(event_id AS STRING),
    '}}}}, "elasticsearch": {{"ssh": {{"document_count": ', CAST(user_id * 50 AS STRING), ', "failed": ', CAST(event_id % 3 AS STRING), '}}}}}}') AS details
FROM {events}""",
    "experiment_runs": """
SELECT s_suppkey AS id, s_nationkey AS experiment_id,
  concat('{{"precision": ', CAST(s_suppkey % 10 AS STRING), ', "recall": ', CAST(s_suppkey % 7 AS STRING), '}}') AS metrics
FROM {supplier}""",
    "training_metrics": """
SELECT l_orderkey AS job_id, CASE l_returnflag WHEN 'A' THEN 'loss' WHEN 'N' THEN 'f1' ELSE 'auc' END AS metric_name,
  max(l_quantity) AS metric_value, CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_linenumber END AS epoch, l_linenumber AS step
FROM {lineitem} GROUP BY 1, 2, 4, 5""",
    "notifications": """
SELECT event_id AS id, user_id, event_id % 3 = 0 AS is_read, ts AS created_at FROM {events}""",
    "edges": """
SELECT user_id AS source, event_id % 150 AS target FROM {events}""",
    "scored": """
SELECT event_id AS id, value AS score, value >= 80 AS detected, (event_type = 'purchase' AND value >= 60) AS truth,
  (value - 100) / 200 AS decision, event_type
FROM {events}""",
    "logins": """
SELECT event_id AS id, concat('user-', lpad(CAST(user_id AS STRING), 4, '0')) AS entity_id, ts,
  concat('10.0.0.', CAST(event_id % 17 AS STRING)) AS ip, concat('dev-', CAST(event_id % 23 AS STRING)) AS device,
  event_type = 'error' AS failed, value AS bytes
FROM {events}""",
    "run_status": """
SELECT event_id AS id, user_id AS run_id, ts,
  CASE event_type WHEN 'signup' THEN 'queued' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' ELSE 'running' END AS status
FROM {events}""",
    # Detector output with holes, for the anomaly sink.
    "detections": """
SELECT event_id AS row_no, CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST(user_id AS STRING) END AS entity_id,
  CASE WHEN event_type = 'signup' THEN NULL WHEN event_type = 'click' THEN 'server' ELSE 'user' END AS entity_type,
  CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END AS risk_score,
  CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS anomaly_type, ts AS timestamp,
  CASE WHEN event_type = 'error' THEN NULL ELSE props END AS details
FROM {events}""",
    "loose_results": """
SELECT event_id AS row_no, CASE event_type
  WHEN 'signup' THEN concat('{{"entity_id": "u', CAST(user_id AS STRING), '", "risk_score": ', CAST(user_id % 100 AS STRING), '}}')
  WHEN 'error' THEN concat('{{"anomalies": [{{"entity_id": "a", "risk_score": 1}}, {{"entity_id": "b', CAST(user_id AS STRING), '", "risk_score": 2}}]}}')
  WHEN 'view' THEN '{{"status": "success"}}'
  WHEN 'click' THEN '{{"anomalies": [], "risk_score": 5}}'
  ELSE '{{"entity_id": "p", "anomaly": "yes"}}' END AS result
FROM {events}""",
    "raw_text": """
SELECT event_id AS id, CAST(value AS STRING) AS amount,
  CASE WHEN event_type IN ('view', 'click') THEN 'n/a' ELSE CAST(user_id AS STRING) END AS mostly,
  CASE WHEN event_type = 'view' THEN CAST(user_id AS STRING) END AS rarely,
  CASE WHEN event_type = 'error' THEN NULL ELSE CAST(event_id AS STRING) END AS sparse, event_type AS word
FROM {events}""",
    "holed": """
SELECT event_id AS id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS amount, CAST(user_id AS DOUBLE) AS weight
FROM {events}""",
}

# A small rule table, one rule per nation, that is evaluated over all anomalies.
VIEWS["watch_rules"] = f"""
SELECT n_nationkey AS id, n_name AS name,
  CASE WHEN n_nationkey % 6 = 5 THEN 'single-fire' ELSE 'flow' END AS rule_type, n_regionkey <> 4 AS enabled,
  CASE WHEN n_nationkey % 2 = 0 THEN 'high' ELSE 'low' END AS severity,
  CASE n_nationkey % 3 WHEN 0 THEN 'risk_score > 80' WHEN 1 THEN 'entity_type = ''device'' and risk_score >= 50'
    ELSE 'acknowledged and anomaly_type in (''purchase'', ''error'') and risk_score > 95' END AS condition,
  {sql_case('n_nationkey % 6', GRAPHS, 'n_nationkey % 3')} AS flow_graph
FROM {{nation}}"""
# A rule table that grows with the data, for the checks of whole rule tables.
VIEWS["flow_rules"] = f"""
SELECT p_partkey AS id, CASE WHEN p_size > 45 THEN 'deviation' ELSE 'flow' END AS rule_type, p_size <= 40 AS enabled, p_size % {len(CHECKED)} AS shape,
  p_partkey % 3 AS model_no, {sql_case(f'p_size % {len(CHECKED)}', [text for text, _ in CHECKED], 'p_partkey % 3')} AS flow_graph
FROM {{part}}"""

# One rule per part: thresholds of their own, and three kinds that cannot be evaluated.
VIEWS["many_rules"] = f"""
SELECT p_partkey AS id, 'flow' AS rule_type, true AS enabled, 60 + p_partkey % 40 AS threshold, p_partkey % 10 >= 7 AS faulty,
  replace({sql_case('p_partkey % 10', [RISK_ABOVE] * 7 + [CYCLE, BAD_PARTS, BAD_THRESHOLD], 'p_partkey % 3')}, '#',
    CAST(60 + p_partkey % 40 AS STRING)) AS flow_graph
FROM {{part}}"""

_PLACE = re.compile(r"\{(\w+)\}")


def spark_sql(name: str, sf_dir: str) -> str:
    """The view's query over the parquet files of a folder."""
    sources = {t: f"parquet.`{sf_dir.rstrip('/')}/{t}.parquet`" for t in _PLACE.findall(VIEWS[name])}
    return VIEWS[name].format(**sources)


def oracle(body: str) -> str:
    """An oracle query with the views it names put in front as expressions."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", body)]
    ctes = [
        f"{v} AS ({VIEWS[v].format(**{t: t for t in _PLACE.findall(VIEWS[v])})})" for v in used
    ]
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + f"\nSELECT * FROM (\n{body}\n) AS answer"
