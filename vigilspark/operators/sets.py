"""Set operations over users, sources and metric names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def extract_users(df: DataFrame, id_feature: str, out: str = "user") -> DataFrame:
    """Distinct values of the id column; a missing id becomes ``NA``."""
    return df.select(F.coalesce(F.col(id_feature).cast("string"), F.lit("NA")).alias(out)).distinct()


def merge_users(known: DataFrame, new: DataFrame, key: str = "user") -> DataFrame:
    """Known users plus the unseen ones; a user seen again keeps the known row.

    Of several new rows of a user, the least in column order stays.
    """
    single = new.groupBy(key).agg(F.min(F.struct(*new.columns)).alias("_row")).select("_row.*")
    fresh = single.join(known.select(key), key, "left_anti")
    return known.unionByName(fresh, allowMissingColumns=True)


def union_tagged(frames: dict[str, DataFrame], tag: str = "origin") -> DataFrame:
    """All rows of all frames with the name of the frame they came from."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def extract_all(sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Users of every source: name -> (frame, id column)."""
    return union_tagged(
        {name: extract_users(df, col) for name, (df, col) in sources.items()}, "log_name"
    )


def distinct_keys(df: DataFrame, entries: Column, out: str = "name") -> DataFrame:
    """Distinct keys over all values of a map column."""
    return df.select(F.explode(F.map_keys(entries)).alias(out)).distinct()


def rules_in_alerts(alerts: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules that occur in the alerts."""
    seen = alerts.select(F.col("rule_id").alias("id")).distinct()
    return rules.join(seen, "id", "left_semi").select("id", "name")
