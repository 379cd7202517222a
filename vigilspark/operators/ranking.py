"""Top-k, latest-row, timeline and alert-budget operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import running


def top_entities(entities: DataFrame, n: int = 5) -> DataFrame:
    return entities.orderBy(F.desc("risk_score"), "entity_id", "entity_type").limit(n)


def recent(anomalies: DataFrame, n: int = 10) -> DataFrame:
    return anomalies.orderBy(F.desc("timestamp"), "id").limit(n)


def first_rows(
    df: DataFrame, keys: list[str], order: list[str], n: int, salts: int | None = None
) -> DataFrame:
    """The first ``n`` rows of each key.

    A hot key is cut twice before one task sees it: Spark applies the rank
    filter on the map side, and the salted pass leaves ``salts * n`` rows a key.
    There are as many salts as shuffle partitions unless given.
    """
    salts = salts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(*order), F.lit(salts))
    for extra in (["_salt"], []):
        rank = F.row_number().over(Window.partitionBy(*keys, *extra).orderBy(*order))
        ranked = df.withColumn("_salt", salt).withColumn("_rank", rank)
        df = ranked.where(F.col("_rank") <= n).drop("_rank", "_salt")
    return df


def latest(
    df: DataFrame, key: str, ts: str, default: DataFrame | None = None, tie: str = "id"
) -> DataFrame:
    """Latest row per key. ``default`` (key, default_id) names the row that wins instead.

    A partial aggregate keeps one row per key and map task; nothing is sorted.
    """
    fields = [c for c in df.columns if c != key]
    rank = [F.col(ts), F.col(tie)]
    if default is not None:
        df = df.join(default.select(F.col(key), F.col("default_id").alias("_d")), key, "left")
        chosen = F.coalesce(F.col(tie) == F.col("_d"), F.lit(False))
        rank = [chosen, *rank]
    picked = df.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(*rank)).alias("_row"))
    return picked.select(key, "_row.*")


def activity_feed(anomalies: DataFrame, cases: DataFrame, n: int = 5) -> DataFrame:
    """The newest anomalies and cases in one list."""
    # Actor, action and type labels of the feed.
    first = anomalies.select(
        F.concat(F.lit("anomaly-"), F.col("id").cast("string")).alias("id"),
        F.lit("System").alias("actor"),
        F.concat(F.lit("Anomaly detected: "), F.col("anomaly_type")).alias("action"),
        F.col("timestamp"),
        F.when(F.col("risk_score") > 80, "error").otherwise("warning").alias("type"),
    )
    second = cases.select(
        F.concat(F.lit("case-"), F.col("id").cast("string")).alias("id"),
        F.lit("Analyst").alias("actor"),
        F.concat(F.lit("Case created: "), F.col("title")).alias("action"),
        F.col("created_at").alias("timestamp"),
        F.lit("info").alias("type"),
    )
    return first.unionByName(second).orderBy(F.desc("timestamp"), "id").limit(n)


def cumulative_risk(anomalies: DataFrame) -> DataFrame:
    """Risk of each entity added up over time, null risk counting as zero."""
    rows = anomalies.where(F.col("entity_id").isNotNull()).select(
        "id", "entity_id", "timestamp",
        F.coalesce("risk_score", F.lit(0.0)).cast("decimal(18,2)").alias("risk"),
    )
    return running(rows, ["entity_id"], ["timestamp", "id"], sums={"total": "risk"}).select(
        "id", "entity_id", "timestamp", F.col("total").cast("double").alias("cumulative_risk")
    )


def status_transitions(
    runs: DataFrame, key: str = "run_id", ts: str = "ts", status: str = "status", tie: str = "id"
) -> DataFrame:
    """Rows whose status differs from the previous row of the same run."""
    rows = runs.select(key, ts, tie, status)
    seen = running(rows, [key], [ts, tie], lags={"previous": status})
    return seen.where(F.col("previous").isNull() | (F.col("previous") != F.col(status)))


def budget_places(alerts: DataFrame, order: list[str]) -> DataFrame:
    """Add ``_place``, the position in a total order (``-name`` sorts downwards), counted slice by slice.

    Null numbers in a downward column count as zero.
    """
    ranked = [c[1:] for c in order if c.startswith("-")]
    filled = alerts.withColumns({f"_o_{c}": F.coalesce(c, F.lit(0.0)) for c in ranked}).withColumn("_one", F.lit(1).cast("long"))
    by = [f"-_o_{c[1:]}" if c.startswith("-") else c for c in order]
    return running(filled, [], by, sums={"_place": "_one"}).drop("_one", *[f"_o_{c}" for c in ranked])


def within_budget(alerts: DataFrame, budget: int, order: list[str] | None = None) -> DataFrame:
    """At most ``budget`` alerts, exactly the first of the order: rules in order, riskiest anomalies first."""
    placed = budget_places(alerts, order or ["rule_order", "-risk_score", "anomaly_id", "alert_node"])
    return placed.where(F.col("_place") <= budget).drop("_place")
