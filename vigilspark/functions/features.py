"""Coercion, feature preparation and normalisation of detector output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators.scan import null_safe_join, numbered, percentiles

# A plain decimal number. Java also parses "1d" or "0x1p3"; those stay text.
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def as_number(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def coerce_numeric(df: DataFrame, threshold: float = 0.5, mode: str = "majority") -> DataFrame:
    """Turn text columns that hold numbers into doubles.

    ``majority``: more than ``threshold`` of all rows (nulls included) parse;
    the rest become null. ``strict``: every non-null value parses. All columns
    are judged in one pass; only that one row of counts reaches the driver.
    """
    if mode not in ("majority", "strict"):
        raise ValueError(f"unknown mode {mode!r}")
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    quoted = {c: F.col(f"`{c}`") for c in texts}
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(as_number(quoted[c])).alias(f"p{i}") for i, c in enumerate(texts)],
        *[F.count(quoted[c]).alias(f"v{i}") for i, c in enumerate(texts)],
    ).first()

    def numeric(i: int) -> bool:
        parsed, present = counts[f"p{i}"], counts[f"v{i}"]
        if mode == "strict":
            return present > 0 and parsed == present
        return counts["n"] > 0 and parsed > threshold * counts["n"]

    chosen = {c for i, c in enumerate(texts) if numeric(i)}
    return df.select(
        *[
            as_number(quoted[c]).alias(c) if c in chosen else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ("entity_id", "user_id", "id")):
    names = [
        f.name
        for f in df.schema
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]
    if not names:
        raise ValueError("no numeric feature columns")
    return names


def numeric_features(
    df: DataFrame, exclude: tuple[str, ...] = ("entity_id", "user_id", "id"), out: str = "features"
) -> DataFrame:
    """Add an ``array<double>`` of all numeric columns; a null cell becomes zero."""
    cols = [
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in numeric_columns(df, exclude)
    ]
    return df.withColumn(out, F.array(*cols))


def with_entity_id(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """``entity_id`` if present, else ``user_id``, else ``entity_<position>`` in key order."""
    if "entity_id" in df.columns:
        return df.withColumn("entity_id", F.col("entity_id").cast("string"))
    if "user_id" in df.columns:
        return df.withColumn("entity_id", F.col("user_id").cast("string"))
    if not order_by:
        raise ValueError("a positional entity id needs order_by")
    return numbered(df, order_by, "_i").withColumn(
        "entity_id", F.concat(F.lit("entity_"), F.col("_i").cast("string"))
    ).drop("_i")


def apply_transform(df: DataFrame, features: list[dict]) -> DataFrame:
    """Apply declared feature transforms (``standard_scaler``) with one statistics pass."""
    wanted = [f for f in features if f.get("transform")]
    for f in wanted:
        if f["transform"] != "standard_scaler":
            raise ValueError(f"unknown transform {f['transform']!r}")
    if not wanted:
        return df
    stats = df.agg(
        F.struct(
            *[F.avg(f["name"]).alias(f"m{i}") for i, f in enumerate(wanted)],
            *[F.stddev_pop(f["name"]).alias(f"s{i}") for i, f in enumerate(wanted)],
        ).alias("stats")
    )
    out = df.withColumn("_stats", stats.scalar())
    for i, f in enumerate(wanted):
        params = f.get("transform_params") or {}
        value = F.col(f["name"]).cast("double")
        if params.get("with_mean", True):
            value = value - F.col("_stats").getField(f"m{i}")
        if params.get("with_std", True):
            std = F.col("_stats").getField(f"s{i}")
            value = value / F.when(std == 0.0, 1.0).otherwise(std)
        out = out.withColumn(f["name"], value)
    return out.drop("_stats")


def preprocess(df: DataFrame, params: dict, cols: list[str] | None = None) -> DataFrame:
    """``fill_na: median`` and ``normalize: true`` (min-max) over numeric columns."""
    cols = cols or numeric_columns(df)
    fill = params.get("fill_na")
    if fill not in (None, "median"):
        raise ValueError(f"unknown fill_na {fill!r}")
    if fill == "median":
        # All columns become (column, value) rows, so one ordered pass gives every median.
        pairs = [F.struct(F.lit(i).alias("_col"), F.col(c).cast("double").alias("_x")) for i, c in enumerate(cols)]
        mids = percentiles(df.select(F.inline(F.array(*pairs))), "_x", {"mid": 0.5}, by=["_col"])
        medians = mids.agg(F.map_from_entries(F.collect_list(F.struct("_col", "mid"))).alias("m"))
        df = df.withColumn("_mids", medians.scalar())
        for i, c in enumerate(cols):
            df = df.withColumn(c, F.coalesce(F.col(c).cast("double"), F.col("_mids")[i]))
        df = df.drop("_mids")
    if params.get("normalize"):
        stats = df.agg(
            F.struct(
                *[F.min(c).cast("double").alias(f"lo{i}") for i, c in enumerate(cols)],
                *[F.max(c).cast("double").alias(f"hi{i}") for i, c in enumerate(cols)],
            ).alias("stats")
        )
        df = df.withColumn("_stats", stats.scalar())
        for i, c in enumerate(cols):
            lo, hi = F.col("_stats").getField(f"lo{i}"), F.col("_stats").getField(f"hi{i}")
            width = F.when(hi == lo, 1.0).otherwise(hi - lo)
            df = df.withColumn(c, (F.col(c).cast("double") - lo) / width)
        df = df.drop("_stats")
    return df


_RESULT = (
    "entity_id STRING, entity_type STRING, risk_score DOUBLE, anomaly_type STRING, "
    "anomaly STRING, details STRING"
)


def normalise_results(results: DataFrame, col: str = "result") -> DataFrame:
    """Loose detector results (JSON text) to anomaly rows.

    A record that carries ``risk_score`` or ``anomaly`` but no ``anomalies`` list
    is one anomaly itself; a record with neither yields no row.
    """
    parsed = F.from_json(F.col(col), f"{_RESULT}, anomalies ARRAY<STRUCT<{_as_fields(_RESULT)}>>")
    keep = [c for c in results.columns if c != col]
    own = F.struct(*[F.col(f"_r.{n}") for n in T.StructType.fromDDL(_RESULT).names])
    listed = F.get_json_object(F.col(col), "$.anomalies").isNotNull()
    single = F.col("_r.risk_score").isNotNull() | F.col("_r.anomaly").isNotNull()
    return (
        results.withColumn("_r", parsed)
        .withColumn(
            "_a",
            F.when(listed, F.col("_r.anomalies")).when(single, F.array(own)),
        )
        .select(*keep, F.explode("_a").alias("_a"))
        .select(*keep, "_a.*")
        .drop("anomaly")
    )


def _as_fields(ddl: str) -> str:
    return ", ".join(part.strip().replace(" ", ": ", 1) for part in ddl.split(","))


def to_anomalies(
    df: DataFrame, model_id: str, run_id: str, ts: Column | None = None,
    ordinal: Column | None = None,
) -> DataFrame:
    """Detector output to anomaly rows: defaults filled, tagged, with a repeatable id.

    Without ``ordinal`` a row is named by its content and, among equal rows, by its
    number, so that equal detections stay apart.
    """

    if ordinal is None:
        columns = df.columns
        df = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_k"))
        df = df.select(*columns, F.explode(F.sequence(F.lit(1), F.col("_k").cast("int"))).alias("_copy"))
        ordinal = F.concat_ws(".", F.xxhash64(*columns).cast("string"), F.col("_copy").cast("string"))

    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in df.columns else default

    entity = given("entity_id", F.lit("unknown")).cast("string")
    kind = given("entity_type", F.lit("user"))
    stamp = ts if ts is not None else given("timestamp", F.current_timestamp())
    details = given("details", F.lit("{}"))
    key = F.concat_ws("|", F.lit(run_id), entity, kind, ordinal.cast("string"))
    return df.select(
        F.sha2(key, 256).alias("id"),
        F.lit(model_id).alias("model_id"),
        F.lit(run_id).alias("run_id"),
        entity.alias("entity_id"),
        kind.alias("entity_type"),
        stamp.alias("timestamp"),
        given("risk_score", F.lit(0.0)).cast("double").alias("risk_score"),
        given("anomaly_type", F.lit("unknown")).alias("anomaly_type"),
        details.alias("details"),
        F.lit(False).alias("acknowledged"),
    )


def _not_in(name: str, allowed: tuple[str, ...]) -> tuple[Column, str]:
    return (~F.coalesce(F.col(name).isin(*allowed), F.lit(False)), f"{name} not allowed")


def _missing(name: str) -> tuple[Column, str]:
    return (F.coalesce(F.length(F.trim(F.col(name))), F.lit(0)) == 0, f"{name} missing")


def _checks(table: str) -> list[tuple[Column, str]]:
    if table == "anomalies":
        lo, hi = schemas.RISK_RANGE
        return [
            _missing("entity_id"),
            _not_in("entity_type", schemas.ENTITY_TYPES),
            (~F.coalesce(F.col("risk_score").between(lo, hi), F.lit(False)), "risk_score out of range"),
        ]
    if table == "cases":
        return [
            _missing("title"),
            _not_in("severity", schemas.SEVERITIES),
            _not_in("status", schemas.CASE_STATUSES),
        ]
    if table == "rules":
        return [_missing("name"), _not_in("rule_type", schemas.RULE_TYPES)]
    if table == "feedback":
        return [_not_in("feedback_type", schemas.FEEDBACK_TYPES)]
    if table == "jobs":
        return [_not_in("status", schemas.JOB_STATUSES)]
    raise ValueError(f"no checks for table {table!r}")


def with_reason(df: DataFrame, table: str) -> DataFrame:
    """Add the first failed check as ``reason``; null when the row is valid."""
    reason = F
    for failed, text in _checks(table):
        reason = reason.when(failed, text)
    return df.withColumn("reason", reason)


def validate(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Split rows into valid ones and rejected ones (with ``reason``)."""
    judged = with_reason(df, table)
    return (
        judged.where(F.col("reason").isNull()).drop("reason"),
        judged.where(F.col("reason").isNotNull()),
    )


def login_features(
    events: DataFrame,
    window: str = "24 hours",
    entity: str = "entity_id",
    ts: str = "ts",
    ip: str = "ip",
    device: str = "device",
    failed: str = "failed",
    nbytes: str = "bytes",
    office_hours: tuple[int, int] = (8, 18),
) -> DataFrame:
    """Login behaviour per entity and window.

    A new device is one whose first event for the entity lies in the window; the
    first event is found by aggregation, never by scanning an entity's history.
    """
    hour = F.hour(ts)
    off = (hour < office_hours[0]) | (hour >= office_hours[1])
    span = (F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp"))))
    base = (
        events.groupBy(entity, F.window(ts, window).alias("_w"))
        .agg(
            F.count(F.lit(1)).alias("login_count"),
            F.count_distinct(ip).alias("unique_ips"),
            F.avg(F.col(failed).cast("int")).alias("failed_login_ratio"),
            F.avg(off.cast("int")).alias("off_hours_activity"),
            F.sum(F.col(nbytes).cast("decimal(18,2)")).cast("double").alias("bytes_transferred"),
            (span / 6e7).alias("session_duration"),
        )
        .withColumn("window_start", F.col("_w.start"))
        .drop("_w")
    )
    fresh = (
        events.groupBy(entity, device)
        .agg(F.min(ts).alias("_first"))
        .groupBy(entity, F.window("_first", window).alias("_w"))
        .agg(F.count(F.lit(1)).alias("_new"))
        .select(entity, F.col("_w.start").alias("window_start"), "_new")
    )
    flag = F.when(F.col("_new") > 0, 1).otherwise(0)
    return (
        null_safe_join(base, fresh, [entity, "window_start"])
        .withColumn("new_device_flag", flag)
        .drop("_new")
    )
