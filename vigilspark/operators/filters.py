"""Filtered reads of platform tables. Every predicate reaches the scan."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import contains_ci
from .scan import running

# Above this many leading rows a page is found by numbering the rows in
# parallel instead of merging the leading rows in one place; the rows are the same.
TOP_K_ROWS = 2_000


def moment(value: str | datetime | Column) -> Column:
    """A point in time without zone, as the event columns hold it."""
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp_ntz")


def span(text: str) -> Column:
    """An interval literal such as ``1 hour`` or ``7 days``."""
    return F.expr(f"INTERVAL {text}")


def page(df: DataFrame, order: list[str], limit: int | None, offset: int = 0, place: str | None = None) -> DataFrame:
    """Rows ``offset .. offset+limit`` of a total order (``-name`` sorts downwards), in that order.

    ``place`` names a column for the position of each row, counted from one.
    """
    sort = [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in order]
    if place is None and limit is not None and offset + limit <= TOP_K_ROWS:
        ordered = df.orderBy(*sort)
        return (ordered.offset(offset) if offset else ordered).limit(limit)
    if place is None and limit is None and not offset:
        return df.orderBy(*sort)
    placed = running(df.withColumn("_one", F.lit(1).cast("long")), [], order, sums={"_n": "_one"})
    kept = placed.where(F.col("_n") > offset)
    if limit is not None:
        kept = kept.where(F.col("_n") <= offset + limit)
    kept = kept.orderBy("_n").drop("_one")
    return kept.withColumnRenamed("_n", place) if place else kept.drop("_n")


def query_table(
    df: DataFrame, eq: dict | None = None, order: list[str] | None = None,
    limit: int | None = 100, offset: int = 0,
) -> DataFrame:
    """Equality filters and a page; a filter given as ``None`` is not applied."""
    for name, value in (eq or {}).items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return page(df, order or ["id"], limit, offset)


def filter_anomalies(
    df: DataFrame, model_id=None, entity_id: str | None = None, acknowledged: bool | None = None,
    min_risk: float | None = None, max_risk: float | None = None, start=None, end=None,
) -> DataFrame:
    if model_id is not None:
        df = df.where(F.col("model_id") == F.lit(model_id))
    if entity_id is not None:
        df = df.where(F.col("entity_id") == F.lit(entity_id))
    if acknowledged is not None:
        df = df.where(F.col("acknowledged") == F.lit(acknowledged))
    if min_risk is not None:
        df = df.where(F.col("risk_score") >= F.lit(min_risk))
    if max_risk is not None:
        df = df.where(F.col("risk_score") <= F.lit(max_risk))
    if start is not None:
        df = df.where(F.col("timestamp") >= moment(start))
    if end is not None:
        df = df.where(F.col("timestamp") <= moment(end))
    return df


def query_anomalies(df: DataFrame, limit: int | None = 100, offset: int = 0, **filters) -> DataFrame:
    """Matching anomalies, newest first."""
    return page(filter_anomalies(df, **filters), ["-timestamp", "id"], limit, offset)


def count_anomalies(df: DataFrame, **filters) -> DataFrame:
    """True number of matching anomalies, over all pages."""
    return filter_anomalies(df, **filters).agg(F.count(F.lit(1)).alias("total"))


def query_cases(
    df: DataFrame, status=None, severity=None, assigned_to=None, limit: int | None = 100,
    offset: int = 0,
) -> DataFrame:
    eq = {"status": status, "severity": severity, "assigned_to": assigned_to}
    return query_table(df, eq, ["-created_at", "id"], limit, offset)


def query_alerts(
    df: DataFrame, severity=None, acknowledged=None, rule_id=None, limit: int | None = 100,
    offset: int = 0,
) -> DataFrame:
    eq = {"severity": severity, "acknowledged": acknowledged, "rule_id": rule_id}
    return query_table(df, eq, ["-created_at", "id"], limit, offset)


def query_rules(df: DataFrame, enabled=None, rule_type=None, limit=None, offset: int = 0) -> DataFrame:
    return query_table(df, {"enabled": enabled, "rule_type": rule_type}, ["id"], limit, offset)


def _any_contains(cols: list[str], needle: str | None) -> Column:
    if not needle:
        return F.lit(True)
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(contains_ci(F.col(c).cast("string"), needle), F.lit(False))
    return hit


# Risk bands of the console filters, [low, high).
ANOMALY_BANDS = {"high": (80, None), "medium": (50, 80), "low": (None, 50)}
ENTITY_BANDS = {
    "critical": (80, None), "high": (50, 80), "medium": (20, 50), "low": (None, 20),
}


def _in_band(risk: Column, bands: dict, band: str | None) -> Column:
    if band is None:
        return F.lit(True)
    low, high = bands[band]
    hit = F.lit(True)
    if low is not None:
        hit = hit & (risk >= low)
    if high is not None:
        hit = hit & (risk < high)
    return hit


def search_anomalies(df: DataFrame, text=None, band=None, acknowledged=None, model_id=None) -> DataFrame:
    risk = F.coalesce("risk_score", F.lit(0.0))
    hit = _any_contains(["entity_id"], text) & _in_band(risk, ANOMALY_BANDS, band)
    return query_table(df.where(hit), {"acknowledged": acknowledged, "model_id": model_id}, limit=None)


def search_cases(df: DataFrame, text=None, status=None, severity=None) -> DataFrame:
    found = df.where(_any_contains(["title"], text))
    return query_table(found, {"status": status, "severity": severity}, limit=None)


def search_entities(df: DataFrame, text=None, entity_type=None, band=None) -> DataFrame:
    risk = F.coalesce("risk_score", F.lit(0.0))
    hit = _any_contains(["entity_id"], text) & _in_band(risk, ENTITY_BANDS, band)
    return query_table(df.where(hit), {"entity_type": entity_type}, ["entity_id", "entity_type"], limit=None)


def search_alerts(df: DataFrame, text=None, severity=None, acknowledged=None, rule_name=None) -> DataFrame:
    """``df`` is the alert table with ``rule_name`` looked up."""
    found = df.where(_any_contains(["message", "entity_id", "rule_name"], text))
    eq = {"severity": severity, "acknowledged": acknowledged, "rule_name": rule_name}
    return query_table(found, eq, limit=None)


def search_rules(df: DataFrame, text=None, rule_type=None, enabled=None) -> DataFrame:
    found = df.where(_any_contains(["name"], text))
    return query_table(found, {"rule_type": rule_type, "enabled": enabled}, limit=None)


def search_all(df: DataFrame, text: str) -> DataFrame:
    """Rows in which any column contains the text."""
    return df.where(_any_contains(df.columns, text))


def since(df: DataFrame, ts: str, interval: str, as_of) -> DataFrame:
    """Rows later than ``as_of - interval`` (strict); ``today`` starts at midnight, inclusive."""
    if interval == "today":
        return df.where(F.col(ts) >= F.date_trunc("day", moment(as_of)).cast("timestamp_ntz"))
    return df.where(F.col(ts) > moment(as_of) - span(interval))
