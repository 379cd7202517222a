"""Registry of the checked queries and lazy access to their inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import configure
from .views import VIEWS, oracle, spark_sql

# The last full day of the event table is 2024-01-30.
AS_OF = "2024-01-31 00:00:00"
NOON = "2024-01-30 12:00:00"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain_time(df: DataFrame) -> DataFrame:
    """Timestamps without zone, the form of the given tables."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name)
            if isinstance(f.dataType, T.TimestampType)
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


class Tables:
    """``t.events`` is a given table, ``t.anomalies`` a derived one."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.dir}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in VIEWS:
            df = plain_time(self.spark.sql(spark_sql(name, self.dir)))
        else:
            df = self.spark.read.parquet(self.path(name))
        setattr(self, name, df)
        return df


def query(name: str, sql: str | None = None):
    """Register ``fn(t)`` under ``name``, with the SQL that must give the same rows."""

    def add(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain_time(fn(Tables(configure(spark), sf_dir)))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql.strip())
        return fn

    return add
