"""Rollups, counters and chart data, over whole tables.

Every aggregate is a partial/final pair, so a hot key reaches the shuffle as one
row per map task. One-row summaries come from scalar subqueries, not joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.scalars import half_up, severity, severity_labels
from .filters import moment, span
from .scan import null_safe_join, percentiles, running


def _risk() -> Column:
    return F.coalesce(F.col("risk_score"), F.lit(0.0))


def _money(c: Column) -> Column:
    """Two-decimal sum that does not depend on row order."""
    return F.sum(c.cast("decimal(18,2)")).cast("double")


def one_row(frames: dict[str, DataFrame]) -> DataFrame:
    """One row with one column per single-value frame."""
    spark = next(iter(frames.values())).sparkSession
    return spark.range(1).select(*[df.scalar().alias(name) for name, df in frames.items()])


def _counters(groups: list[tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """One row of counters; each table is scanned once for all its counters."""
    spark = groups[0][0].sparkSession
    out, base = [], spark.range(1)
    for i, (df, aggs) in enumerate(groups):
        packed = df.agg(F.struct(*[c.alias(n) for n, c in aggs.items()]).alias("s"))
        base = base.withColumn(f"_g{i}", packed.scalar())
        out += [F.col(f"_g{i}.{n}").alias(n) for n in aggs]
    return base.select(*out)


def _all() -> Column:
    return F.count(F.lit(1))


# ---------------------------------------------------------------- entities


def entity_rollup(anomalies: DataFrame) -> DataFrame:
    return (
        anomalies.where(F.col("entity_id").isNotNull())
        .groupBy("entity_id", F.coalesce("entity_type", F.lit("user")).alias("entity_type"))
        .agg(
            F.max(_risk()).alias("risk_score"),
            _all().alias("anomaly_count"),
            F.min("timestamp").alias("first_seen"),
            F.max("timestamp").alias("last_seen"),
        )
    )


def merge_entities(
    entities: DataFrame, anomalies: DataFrame, keep_first_seen: bool = False
) -> DataFrame:
    """Fold new anomalies into the entity table.

    ``first_seen`` becomes the earliest time known; ``keep_first_seen`` leaves
    that of an already known entity untouched even when a late row is older.
    """
    return merge_profiles(entities, entity_rollup(anomalies), keep_first_seen)


def merge_profiles(entities: DataFrame, rollup: DataFrame, keep_first_seen: bool = False) -> DataFrame:
    """Fold the rollup of new anomalies into the entity table, as ``merge_entities`` does."""
    old = entities.withColumn("_old", F.col("first_seen"))
    new = rollup.withColumn("_old", F.lit(None).cast(entities.schema["first_seen"].dataType))
    first = F.min("first_seen")
    if keep_first_seen:
        first = F.coalesce(F.max("_old"), first)
    return (
        old.unionByName(new)
        .groupBy("entity_id", "entity_type")
        .agg(
            F.max("risk_score").alias("risk_score"),
            F.sum("anomaly_count").alias("anomaly_count"),
            first.alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
        )
    )


def weighted_risk(anomalies: DataFrame, weights: dict[str, float] | DataFrame, default: float = 1.0) -> DataFrame:
    """Weighted sum of risk per entity, capped at 100."""
    rows = anomalies.where(F.col("entity_id").isNotNull())
    if isinstance(weights, DataFrame):
        rows = rows.join(weights.select("anomaly_type", F.col("weight").alias("_w")), "anomaly_type", "left")
        weight = F.coalesce("_w", F.lit(default))
    else:
        weight = F
        for name, value in weights.items():
            weight = weight.when(F.col("anomaly_type") == name, float(value))
        weight = weight.otherwise(F.lit(default)) if weights else F.lit(default)
    return rows.groupBy("entity_id").agg(
        F.least(
            F.lit(100.0),
            F.sum(_risk().cast("decimal(18,2)") * weight.cast("decimal(9,4)")).cast("double"),
        ).alias("weighted_risk")
    )


# ---------------------------------------------------------------- counters


def home_summary(models: DataFrame, anomalies: DataFrame, cases: DataFrame) -> DataFrame:
    return _counters([
        (models, {"total_models": _all(), "active_models": F.count_if(F.col("enabled"))}),
        (anomalies, {
            "total_anomalies": _all(),
            "unacknowledged_anomalies": F.count_if(~F.col("acknowledged")),
        }),
        (cases, {"open_cases": F.count_if(F.col("status") == "open")}),
    ])


def console_kpis(models: DataFrame, anomalies: DataFrame, cases: DataFrame) -> DataFrame:
    active = (F.col("status") == "active") | F.col("enabled")
    return _counters([
        (models, {"total_models": _all(), "active_models": F.count_if(active)}),
        (anomalies, {
            "total_anomalies": _all(),
            "unacknowledged_anomalies": F.count_if(~F.col("acknowledged")),
            "monitored_entities": F.count_distinct("entity_id"),
            "high_risk_entities": F.count_distinct(F.when(_risk() > 70, F.col("entity_id"))),
        }),
        (cases, {"open_cases": F.count_if(F.col("status") != "closed")}),
    ])


def system_state(
    anomalies: DataFrame, models: DataFrame, alerts: DataFrame, cases: DataFrame,
    rules: DataFrame, entities: DataFrame, as_of,
) -> DataFrame:
    recent = F.col("timestamp") > moment(as_of) - span("24 hours")
    return _counters([
        (anomalies, {"anomalies_24h": F.count_if(recent)}),
        (models, {"enabled_models": F.count_if(F.col("enabled"))}),
        (alerts, {"unacknowledged_alerts": F.count_if(~F.col("acknowledged"))}),
        (cases, {"open_cases": F.count_if(F.col("status") == "open")}),
        (rules, {"enabled_rules": F.count_if(F.col("enabled"))}),
        (entities, {"entities": _all()}),
    ])


def anomaly_kpis(df: DataFrame) -> DataFrame:
    return df.agg(
        _all().alias("total"),
        F.count_if(_risk() >= 80).alias("high"),
        F.count_if(~F.col("acknowledged")).alias("unacknowledged"),
        F.coalesce(
            half_up(F.try_divide(_money(_risk()), _all())), F.lit(0)
        ).alias("mean_risk"),
    )


def entity_kpis(df: DataFrame) -> DataFrame:
    return df.agg(
        _all().alias("total"),
        F.count_if(F.col("entity_type") == "user").alias("users"),
        F.count_if(F.coalesce(F.col("entity_type") != "user", F.lit(True))).alias("non_users"),
        F.count_if(_risk() >= 70).alias("high_risk"),
    )


def alert_kpis(df: DataFrame, as_of) -> DataFrame:
    today = F.date_trunc("day", moment(as_of)).cast("timestamp_ntz")
    return df.agg(
        _all().alias("total"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "high").alias("high"),
        F.count_if(F.col("severity") == "medium").alias("medium"),
        F.count_if(F.col("severity") == "low").alias("low"),
        F.count_if(~F.col("acknowledged")).alias("unacknowledged"),
        F.count_if(F.col("created_at") >= today).alias("fired_today"),
    )


def rule_kpis(rules: DataFrame, alerts: DataFrame, as_of) -> DataFrame:
    """Totals per (section, name): rule counters, rules by type, alerts by severity."""
    today = F.date_trunc("day", moment(as_of)).cast("timestamp_ntz")
    # A rule was triggered today when one of its alerts is from today.
    hot = alerts.where(F.col("created_at") >= today).select(F.col("rule_id").alias("id")).distinct()
    triggered = rules.join(hot, "id", "left_semi").agg(_all().alias("value"))
    head = rules.agg(
        _all().alias("total"), F.count_if(F.col("enabled")).alias("active")
    ).select(F.expr("stack(2, 'total', total, 'active', active) AS (name, value)"))
    return _sections({
        "rules": head.unionByName(triggered.select(F.lit("triggered_today").alias("name"), "value")),
        "type": _named(rules, "rule_type"),
        "alert_severity": severity_counts(alerts),
    })


def _named(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(F.col(col).alias("name")).agg(_all().alias("value"))


def distribution(df: DataFrame, col: str) -> DataFrame:
    """Rows per value of a column."""
    return _named(df, col)


def _sections(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for section, df in parts.items():
        named = df.select(F.lit(section).alias("section"), "name", "value")
        out = named if out is None else out.unionByName(named)
    return out


def bucket_counts(df: DataFrame, label: Column, labels: list[str]) -> DataFrame:
    """Rows per label, one output row per listed label even when it has none."""
    counted = df.agg(*[F.count_if(label == name).alias(f"_{i}") for i, name in enumerate(labels)])
    pairs = ", ".join(f"'{name}', _{i}" for i, name in enumerate(labels))
    return counted.select(F.expr(f"stack({len(labels)}, {pairs}) AS (name, value)"))


def severity_counts(df: DataFrame) -> DataFrame:
    return bucket_counts(df, F.col("severity"), list(schemas.SEVERITIES))


def anomaly_severity(anomalies: DataFrame) -> DataFrame:
    return bucket_counts(
        anomalies, severity(F.col("risk_score"), "anomaly"), severity_labels("anomaly")
    )


def entity_breakdown(entities: DataFrame) -> DataFrame:
    """Entities by type and by risk band."""
    return _sections({
        "type": _named(entities, "entity_type"),
        "risk": bucket_counts(
            entities, severity(F.col("risk_score"), "entity"), severity_labels("entity")
        ),
    })


def case_breakdown(cases: DataFrame) -> DataFrame:
    """Cases by severity (zero-filled), by status, and the three console groups."""
    groups = cases.agg(
        F.count_if(F.col("status").isin("open", "investigating")).alias("o"),
        F.count_if(F.col("severity").isin("critical", "high")).alias("c"),
        F.count_if(F.col("status").isin("resolved", "closed")).alias("r"),
    ).select(F.expr("stack(3, 'open', o, 'critical_high', c, 'resolved', r) AS (name, value)"))
    return _sections({
        "severity": severity_counts(cases),
        "status": _named(cases, "status"),
        "group": groups,
    })


def count_where(df: DataFrame, **eq) -> DataFrame:
    """Number of rows whose columns equal the given values, as one row."""
    for name, value in eq.items():
        df = df.where(F.col(name) == F.lit(value))
    return df.agg(_all().alias("n"))


# ---------------------------------------------------------------- time series


def _day_spine(spark, as_of, days: int) -> DataFrame:
    last = F.to_date(moment(as_of))
    return spark.range(1).select(
        F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day")
    )


def risk_trend(anomalies: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Anomalies per severity for each of the last days, today included, zero-filled."""
    last = F.to_date(moment(as_of))
    start = F.date_sub(last, days - 1).cast("timestamp_ntz")
    end = F.date_add(last, 1).cast("timestamp_ntz")
    label = severity(F.col("risk_score"), "trend")
    names = severity_labels("trend")
    counted = (
        anomalies.where((F.col("timestamp") >= start) & (F.col("timestamp") < end))
        .groupBy(F.to_date("timestamp").alias("day"))
        .agg(*[F.count_if(label == n).alias(n) for n in names])
    )
    return _day_spine(anomalies.sparkSession, as_of, days).join(counted, "day", "left").fillna(0, names)


def by_day(df: DataFrame, ts: str, flags: dict[str, Column] | None = None, days: int = 14) -> DataFrame:
    """Rows and flagged rows per day, for the most recent days that have rows."""
    return (
        df.groupBy(F.to_date(ts).alias("day"))
        .agg(_all().alias("total"), *[F.count_if(c).alias(n) for n, c in (flags or {}).items()])
        .orderBy(F.desc("day"))
        .limit(days)
    )


def top_types(anomalies: DataFrame, as_of, days: int = 7, n: int = 5) -> DataFrame:
    return (
        anomalies.where(F.col("timestamp") > moment(as_of) - span(f"{days} days"))
        .groupBy("anomaly_type")
        .agg(_all().alias("n"))
        .orderBy(F.desc("n"), "anomaly_type")
        .limit(n)
    )


def unacked_by_severity(alerts: DataFrame) -> DataFrame:
    return (
        alerts.where(~F.col("acknowledged"))
        .groupBy("severity").agg(_all().alias("n"))
        .orderBy(F.desc("n"), "severity")
    )


# ---------------------------------------------------------------- ingestion, logs, runs


def _ingestion_volumes(runs: DataFrame) -> DataFrame:
    details = F.from_json("details", schemas.INGESTION_DETAILS)

    def total(side: str, field: str) -> Column:
        return F.aggregate(
            F.coalesce(F.map_values(F.col(f"_d.{side}")), F.array()),
            F.lit(0).cast("long"),
            lambda acc, s: acc + F.coalesce(s[field], F.lit(0).cast("long")),
        )

    return runs.withColumn("_d", details).select(
        *runs.columns,
        total("spark", "row_count").alias("rows"),
        total("elasticsearch", "document_count").alias("documents"),
        total("elasticsearch", "failed").alias("failed"),
    )


def ingestion_totals(runs: DataFrame) -> DataFrame:
    return _ingestion_volumes(runs).select("id", "status", "rows", "documents", "failed")


def ingestion_history(runs: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Megabytes per day (1 KiB a row) on the table and the search side."""
    done = runs.where(
        (F.col("status") == "completed")
        & (F.col("completed_at") >= moment(as_of) - span(f"{days} days"))
    )
    counted = (
        _ingestion_volumes(done)
        .groupBy(F.to_date("completed_at").alias("day"))
        .agg(F.sum("rows").alias("r"), F.sum("documents").alias("d"))
    )
    merged = _day_spine(runs.sparkSession, as_of, days).join(counted, "day", "full")

    def mb(c: Column) -> Column:
        return F.floor(F.coalesce(c, F.lit(0)) / 1024 * 100 + 0.5) / 100

    return merged.select(
        "day",
        mb(F.coalesce("r", F.lit(0)) + F.coalesce("d", F.lit(0))).alias("value"),
        mb(F.col("r")).alias("spark"),
        mb(F.col("d")).alias("search"),
    )


def log_levels(logs: DataFrame) -> DataFrame:
    return logs.groupBy("model_run_id").agg(
        _all().alias("lines"),
        F.count_if(F.col("level") == "error").alias("errors"),
        F.count_if(F.col("level") == "warning").alias("warnings"),
    )


def inference_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        _all().alias("anomaly_count"), F.count_if(_risk() >= 50).alias("high_risk")
    )


def volume_anomaly(df: DataFrame, threshold: int = 10_000, source: str | None = None) -> DataFrame:
    """One anomaly per table (or per source) that holds more rows than the threshold."""
    keys = [source] if source else []
    counted = df.groupBy(*keys).agg(_all().alias("row_count"))
    return counted.where(F.col("row_count") > threshold).select(
        F.col(source).cast("string").alias("entity_id") if source else F.lit("system").alias("entity_id"),
        F.lit("data_volume").alias("entity_type"),
        F.lit(0.7).alias("risk_score"),
        F.lit("high_data_volume").alias("anomaly_type"),
        F.to_json(F.struct("row_count", F.lit(threshold).cast("long").alias("threshold"))).alias("details"),
    )


def unread_counts(notifications: DataFrame) -> DataFrame:
    return notifications.groupBy("user_id").agg(F.count_if(~F.col("is_read")).alias("unread"))


# ---------------------------------------------------------------- model quality


def confusion(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    p, t = F.col(predicted), F.col(truth)

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0))

    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return (
        df.agg(
            F.count_if(p & t).alias("tp"),
            F.count_if(p & ~t).alias("fp"),
            F.count_if(~p & t).alias("fn"),
            F.count_if(~p & ~t).alias("tn"),
        )
        .withColumn("precision", share("tp", "fp"))
        .withColumn("recall", share("tp", "fn"))
        .withColumn("f1", F.coalesce(f1, F.lit(0.0)))
    )


def auc(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Exact area under the ROC curve; equal scores count half.

    Rows shrink to one per distinct score, whose negatives are then cumulated
    with a distributed running sum.
    """
    per_score = (
        df.where(F.col(score).isNotNull() & F.col(truth).isNotNull())
        .groupBy(F.col(score).alias("_s"))
        .agg(F.count_if(F.col(truth)).alias("_p"), F.count_if(~F.col(truth)).alias("_n"))
    )
    below = running(per_score, [], ["_s"], sums={"_upto": "_n"})
    # Twice the rank sum stays an integer, so the order of addition cannot matter.
    wins = F.sum((F.col("_p") * (2 * F.col("_upto") - F.col("_n"))).cast("decimal(38,0)"))
    pairs = 2 * F.sum(F.col("_p")).cast("double") * F.sum(F.col("_n")).cast("double")
    return below.agg(
        F.sum("_p").alias("positives"),
        F.sum("_n").alias("negatives"),
        F.try_divide(wins.cast("double"), pairs).alias("auc"),
    )


def _melt(df: DataFrame, cols: list[str], keep: list[str]) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols]
    )
    return df.select(*keep, F.inline(pairs))


def profile_features(df: DataFrame) -> DataFrame:
    """One row per column: type, mean, deviation, range and share of nulls."""
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    rows = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        num = c.cast("double") if f.name in numeric else F.lit(None).cast("double")
        rows.append(
            F.struct(
                F.lit(f.name).alias("name"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.avg(num).alias("mean"),
                F.stddev_samp(num).alias("std"),
                F.min(num).alias("min"),
                F.max(num).alias("max"),
                F.try_divide(F.count_if(c.isNull()), F.count(F.lit(1))).alias("null_rate"),
            )
        )
    return df.agg(F.array(*rows).alias("_rows")).select(F.inline("_rows"))


def describe_by(df: DataFrame, label: str, cols: list[str]) -> DataFrame:
    """Count, mean, deviation, quartiles and range per label and column."""
    long = _melt(df, cols, [label])
    keys = [label, "column"]
    basics = long.groupBy(*keys).agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = percentiles(long, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, keys)
    two = lambda c: (F.floor(F.col(c) * 100 + 0.5) / 100).alias(c)
    return null_safe_join(basics, quartiles, keys).select(
        *keys, "count", *[two(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")]
    )


def histogram(df: DataFrame, col: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """Fixed-width bins over the column's range, the last one closed, empty ones kept."""
    value = F.col(col).cast("double")
    lo_hi = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("s"))
    flat = F.col("_s.lo") == F.col("_s.hi")
    lo = F.when(flat, F.col("_s.lo") - 0.5).otherwise(F.col("_s.lo"))
    width = F.when(flat, 1.0).otherwise(F.col("_s.hi") - F.col("_s.lo")) / bins
    keys = [by] if by else []
    counted = (
        df.where(value.isNotNull())
        .withColumn("_s", lo_hi.scalar())
        .groupBy(*keys, F.least(F.floor((value - lo) / width), F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(_all().alias("n"))
    )
    # Every label gets every bin: zero rows are added to the counts and summed,
    # which needs no join against a spine.
    spine = counted.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = counted.unionByName(spine.withColumn("n", F.lit(0).cast("long")))
    return (
        full.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
        .withColumn("_s", lo_hi.scalar())
        .select(*keys, "bin", (lo + F.col("bin") * width).alias("left_edge"), "n")
    )


def heatmap(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Mean value per weekday (1 = Sunday) and hour, one column per hour."""
    hour = F.hour(ts)
    cell = lambda h: F.when(hour == h, F.col(value))
    return df.groupBy(F.dayofweek(ts).alias("weekday")).agg(
        *[F.try_divide(_money(cell(h)), F.count(cell(h))).alias(f"h{h:02d}") for h in range(24)]
    )


def profile_dataset(df: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Row and column counts, column names and, when given, the size of the files."""
    out = df.agg(_all().alias("row_count")).select(
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(",".join(df.columns)).alias("columns"),
    )
    if files is not None:
        out = out.withColumn("size_bytes", files.agg(F.sum("length")).scalar())
    return out


# ---------------------------------------------------------------- experiments


def _metric_rows(runs: DataFrame) -> DataFrame:
    return runs.select(
        "id", "experiment_id", F.explode(F.from_json("metrics", "map<string,double>")).alias("metric", "value")
    )


def compare_runs(runs: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """One row per run, one column per metric name (found in the data unless given)."""
    grouped = _metric_rows(runs).groupBy("id", "experiment_id")
    return (grouped.pivot("metric", metrics) if metrics else grouped.pivot("metric")).agg(F.max("value"))


def best_runs(runs: DataFrame, lower_is_better: tuple[str, ...] = ("loss",)) -> DataFrame:
    """Best run per experiment and metric; equal values go to the lowest id."""
    rows = _metric_rows(runs)
    sign = F.when(F.col("metric").isin(*lower_is_better), -1.0).otherwise(1.0)
    return rows.groupBy("experiment_id", "metric").agg(
        F.min_by("id", F.struct(-F.col("value") * sign, "id")).alias("run_id"),
        F.min_by("value", F.struct(-F.col("value") * sign, "id")).alias("value"),
    )


def training_curves(
    metrics: DataFrame, names: list[str] | None = None, order_by: str | None = None
) -> DataFrame:
    """Metric values per job and epoch, else step, else position, one column per metric."""
    at = F.coalesce("epoch", "step").cast("long")
    points = metrics.withColumn("x", at)
    if order_by:
        keys = ["job_id", "metric_name"]
        placed = running(
            points.withColumn("_one", F.lit(1).cast("long")), keys, [order_by], sums={"_n": "_one"}
        )
        points = placed.withColumn("x", F.coalesce("x", F.col("_n") - 1)).drop("_one", "_n")
    grouped = points.groupBy("job_id", "x")
    pivoted = grouped.pivot("metric_name", names) if names else grouped.pivot("metric_name")
    return pivoted.agg(F.max("metric_value"))
