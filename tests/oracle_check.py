"""Compare registered queries with their SQL on DuckDB, value by value."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(spark, con, sf_dir, name, run, sql):
    """None when equal, else a short description of the difference."""
    df = run(spark, sf_dir)
    got_cols, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    plan = df._jdf.queryExecution().executedPlan().toString()
    for join in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        if join in plan:
            return f"plan has a {join}"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want_cols, want = _rows(cols, cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} rows differ, first {bad[0]}"
    kinds = lambda row: [type(v).__name__ for v in row]
    if got and None not in got[0] and None not in want[0] and kinds(got[0]) != kinds(want[0]):
        return f"types {kinds(got[0])} != {kinds(want[0])}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from vigilspark.plans.catalog import ORACLES, QUERIES
    from vigilspark.session import local_session

    spark = local_session()
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    con = connect(sf)
    wanted = sys.argv[1:]
    failures = 0
    for name, run in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in ORACLES:
                verdict = compare(spark, con, sf, name, run, ORACLES[name])
            else:
                verdict = None
                print(f"  {name}: {len(run(spark, sf).collect())} rows, no SQL")
        except Exception as error:  # report and go on with the next query
            verdict = f"{type(error).__name__}: {str(error)[:600]}"
        failures += verdict is not None
        print(f"{'FAIL' if verdict else 'ok  '} {name} {time.time() - start:.2f}s {verdict or ''}", flush=True)
    print(f"{failures} failures")
