"""Fixed table layouts and allowed values of the platform tables."""

from pyspark.sql import types as T

# The lists accepted by the platform tables.
ENTITY_TYPES = ("user", "device", "ip", "other")
SEVERITIES = ("low", "medium", "high", "critical")
CASE_STATUSES = ("open", "investigating", "resolved", "closed")
FEEDBACK_TYPES = ("true_positive", "false_positive", "needs_review")
RULE_TYPES = ("single-fire", "deviation", "flow")
JOB_STATUSES = ("pending", "running", "succeeded", "failed", "cancelled")
RISK_RANGE = (0.0, 100.0)


_KINDS = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(),
    "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
}


def _table(**cols: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in cols.items()])


ANOMALIES = _table(
    id="string", model_id="string", run_id="string", entity_id="string", entity_type="string",
    timestamp="timestamp", risk_score="double", anomaly_type="string", details="string",
    acknowledged="boolean",
)
ENTITIES = _table(
    entity_id="string", entity_type="string", risk_score="double", anomaly_count="bigint",
    first_seen="timestamp", last_seen="timestamp",
)
CASES = _table(
    id="string", title="string", description="string", status="string", severity="string",
    assigned_to="string", created_at="timestamp", updated_at="timestamp",
)
CASE_ANOMALIES = _table(case_id="string", anomaly_id="string")
RULES = _table(
    id="string", name="string", description="string", rule_type="string", condition="string",
    severity="string", enabled="boolean", flow_graph="string", last_triggered_at="timestamp",
)
ALERTS = _table(
    id="string", rule_id="string", severity="string", message="string", entity_id="string",
    entity_type="string", alert_context="string", acknowledged="boolean", created_at="timestamp",
)
FEEDBACK = _table(
    id="string", anomaly_id="string", feedback_type="string", notes="string", user_id="string",
    created_at="timestamp",
)
MODELS = _table(
    id="string", name="string", version="string", status="string", enabled="boolean",
    default_version_id="string",
)
MODEL_VERSIONS = _table(id="string", model_id="string", version="string", installed_at="timestamp")
MODEL_RUNS = _table(
    id="string", model_version_id="string", run_type="string", status="string",
    error_message="string", result_summary="string", created_at="timestamp",
    started_at="timestamp", finished_at="timestamp",
)
MODEL_LOGS = _table(
    id="string", model_run_id="string", level="string", message="string", created_at="timestamp"
)
JOBS = _table(
    id="string", model_run_id="string", status="string", metrics="string",
    error_message="string", created_at="timestamp", started_at="timestamp",
    completed_at="timestamp",
)
TRAINING_METRICS = _table(
    job_id="string", metric_name="string", metric_value="double", epoch="int", step="int"
)
INGESTION_RUNS = _table(id="string", status="string", completed_at="timestamp", details="string")
EXPERIMENT_RUNS = _table(id="string", experiment_id="string", metrics="string")
NOTIFICATIONS = _table(id="string", user_id="string", is_read="boolean", created_at="timestamp")
ARTIFACTS = _table(
    id="string", model="string", path="string", file_hash="string", format="string",
    created_at="timestamp",
)
# What every detector returns.
DETECTIONS = _table(
    entity_id="string", entity_type="string", risk_score="double", anomaly_type="string",
    timestamp="timestamp", details="string",
)
STEP_STATUS = _table(step_index="int", step_type="string", status="string", message="string")

# Layout of the nested counters stored with an ingestion run.
INGESTION_DETAILS = (
    "spark MAP<STRING, STRUCT<row_count: BIGINT>>, "
    "elasticsearch MAP<STRING, STRUCT<document_count: BIGINT, failed: BIGINT>>"
)
