"""Headline queries, timed end to end; prints one JSON line.

Each query runs once to warm up and then ``BENCH_RUNS`` times (3 by default);
the median counts. Every run computes all rows of the result.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from vigilspark.plans.catalog import ORACLES, QUERIES
from vigilspark.session import local_session, release

HEADLINE = [
    "q01_risky_entities_and_alerts",
    "a01_entity_rollup",
    "f01_query_anomalies",
    "a05_risk_trend",
    "a23_auc",
    "j10_entity_detail",
    "r09_evaluate",
    "r10_fire",
    "w05_cumulative_risk",
    "w08_suppress",
    "p14_login_features",
    "m01_forest_fit",
    "m02_forest_score",
    "m09_pagerank",
    "t02_entity_rollup_stream",
]


def run_once(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def duckdb_seconds(names: list[str], sf_dir: str) -> dict[str, float]:
    """The same questions in SQL on one machine, for orientation."""
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        table = file.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{file}')")
    seconds = {}
    for name in names:
        if name in ORACLES:
            con.execute(ORACLES[name]).fetchall()
            start = time.perf_counter()
            con.execute(ORACLES[name]).fetchall()
            seconds[name] = round(time.perf_counter() - start, 3)
    return seconds


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        run_once(spark, name, sf_dir)
        seconds[name] = round(statistics.median(run_once(spark, name, sf_dir) for _ in range(runs)), 3)
        release(spark)
    compared = duckdb_seconds(list(seconds), sf_dir) if os.environ.get("BENCH_COMPARE", "1") != "0" else {}
    print(json.dumps({
        "metric": "headline_total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "cores": cpus,
        "duckdb": compared,
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
