"""Operators whose cost must follow the change or one scan: forest pools, sweeps, reach, file digests, ingest counts."""

import glob
import hashlib
import json
import os
import re
import subprocess
import sys
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilspark.detect import graph as G
from vigilspark.detect.iforest import IsolationForest, forest_arrays, mean_depth, prefix_depths, sweep_forest
from vigilspark.operators import aggregates as A
from vigilspark.operators import joins as J
from vigilspark.sources import catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def vectors(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(f"e{i}", [float(x) for x in row]) for i, row in enumerate(rng.normal(size=(n, 3)))],
                                 "entity_id string, features array<double>")


# ------------------------------------------------------------------ forest


def test_the_pool_is_drawn_without_a_shuffle(spark):
    df = vectors(spark, 400)
    forest = IsolationForest(n_estimators=4, max_samples=32)
    text = plan(forest.samples(df, 400))
    # The only exchange deals the drawn rows to their trees, above the pool.
    assert text.count("Exchange") == 1
    assert text.index("Exchange") < text.index("MapInArrow")


def test_equal_rows_have_their_share(spark):
    rows = [("same", [1.0, 1.0])] * 20_000 + [(f"o{i}", [float(i), 0.0]) for i in range(20_000)]
    df = spark.createDataFrame(rows, "entity_id string, features array<double>").repartition(6)
    drawn = IsolationForest(n_estimators=20).samples(df, 40_000)
    share = drawn.agg(F.avg((F.col("_k") == "same").cast("int"))).first()[0]
    assert 0.42 < share < 0.58


def test_prefix_depths_equal_smaller_forests():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(50, 2))
    from vigilspark.detect.iforest import grow
    import pandas as pd

    frames = []
    for tree in range(9):
        grown = pd.DataFrame(grow(points, 5, np.random.default_rng(tree)), columns=["node", "feature", "split", "left", "right", "path"])
        frames.append(grown.assign(tree=tree))
    trees = forest_arrays(pd.concat(frames))
    found = prefix_depths(points, trees, [9, 2, 5])
    for i, size in enumerate([9, 2, 5]):
        assert np.allclose(found[:, i], mean_depth(points, trees[:size]))


def test_sweep_scans_once_for_any_number_of_configurations(spark, monkeypatch):
    df = vectors(spark, 300)
    jobs = []
    for sizes in ([5], [5, 10, 20, 40]):
        spark.sparkContext.setJobGroup(f"sweep-{len(sizes)}", "sweep")
        configs = [{"n_estimators": n, "contamination": c} for n in sizes for c in (0.05, 0.1, 0.2)]
        runs = sweep_forest(df, configs, max_samples=64).orderBy("id").collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"sweep-{len(sizes)}")))
        for config, run in zip(configs, runs):
            assert abs(json.loads(run["metrics"])["flagged"] - config["contamination"]) < 0.02
    spark.sparkContext.setJobGroup("other", "")
    assert jobs[0] == jobs[1]


# ------------------------------------------------------------------ reach


def reached(pairs, start, k):
    near, todo = {}, {}
    for a, b in pairs:
        todo.setdefault(a, set()).add(b)
        todo.setdefault(b, set()).add(a)
    queue = deque([(start, 0)] if start in todo else [])
    while queue:
        node, hop = queue.popleft()
        if node not in near:
            near[node] = hop
            if hop < k:
                queue.extend((n, hop + 1) for n in todo[node])
    return near


@pytest.mark.parametrize("hub_edges", [200_000, 15])
def test_many_starts(spark, hub_edges):
    rng = np.random.default_rng(7)
    pairs = {(f"n{a}", f"n{b}") for a, b in rng.integers(0, 150, (200, 2))} | {("n0", f"n{i}") for i in range(40)} | {("n5", "n5")}
    edges = G.build_edges(spark.createDataFrame(sorted(pairs), "source string, target string"))
    starts = [f"n{i}" for i in range(0, 150, 2)] + ["nowhere", None]
    found = {(r["start"], r["node"]): r["hop"] for r in G.k_hop_many(edges, starts, 3, hub_edges).collect()}
    want = {(s, n): h for s in starts for n, h in reached(pairs, s, 3).items()}
    assert found == want


def test_a_hop_shuffles_the_frontier_only(spark):
    edges = G.build_edges(spark.createDataFrame([(f"n{i}", f"n{i * i % 97}") for i in range(300)], "source string, target string"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table, keys, nodes = G.adjacency(edges)
        first = spark.createDataFrame([("n1", 1), ("n2", 2)], "node string, mask bigint")
        hops = [G._bucketed(first, ["node"], 8)]
        hops.append(G._in_buckets(G.reach_step(table, keys, nodes, hops), ["node"], 8))
        text = plan(G.reach_step(table, keys, nodes, hops))
        assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
        ranks = nodes.select("node", F.lit(1.0).alias("rank"))
        assert "Exchange" not in plan(ranks.join(nodes, "node"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# ------------------------------------------------------------------ files


def test_digests_of_nested_files(spark, tmp_path):
    os.makedirs(tmp_path / "a b" / "c")
    contents = {"one.bin": b"", "a b/two%.bin": b"x" * 100_000, "a b/c/three.bin": b"y"}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    found = {r["file"]: (r["actual_hash"], r["bytes"]) for r in J.hash_files(spark, str(tmp_path), "*.bin", block=1000).collect()}
    assert {os.path.basename(k): v for k, v in found.items()} == {
        os.path.basename(n): (hashlib.sha256(d).hexdigest(), len(d)) for n, d in contents.items() if d}


SPARSE = """
import resource, sys
sys.path.insert(0, {root!r})
from vigilspark.session import local_session
from vigilspark.operators.joins import hash_files
spark = local_session("2", "sparse")
row = hash_files(spark, {folder!r}).first()
print("digest", row["actual_hash"], row["bytes"])
"""


def test_a_file_larger_than_the_memory(tmp_path):
    """3 GiB, mostly a hole, with 1 GB of memory for the session."""
    size = 3 << 30
    with open(tmp_path / "sparse.bin", "wb") as f:
        f.truncate(size)
        f.seek(size - 4)
        f.write(b"tail")
    want, zeros = hashlib.sha256(), bytes(1 << 24)
    for _ in range(size // len(zeros) - 1):
        want.update(zeros)
    want.update(zeros[:-4] + b"tail")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", SPARSE.format(root=root, folder=str(tmp_path))], capture_output=True, text=True,
                         timeout=600, env=os.environ | {"VIGIL_DRIVER_MEMORY": "1g"})
    os.truncate(tmp_path / "sparse.bin", 0)
    assert f"digest {want.hexdigest()} {size}" in out.stdout, out.stderr[-2000:]


# ------------------------------------------------------------------ ingest


def test_ingest_counts_are_observed(spark, tmp_path):
    os.makedirs(tmp_path / "set" / "ssh")
    os.makedirs(tmp_path / "set" / "proxy")
    os.makedirs(tmp_path / "set" / "odd")
    (tmp_path / "set" / "ssh" / "a.log").write_text("1\tx\n2\ty\n")
    (tmp_path / "set" / "ssh" / "b.log").write_text("3\tz\n")
    (tmp_path / "set" / "proxy" / "p.csv").write_text("h k\n1 2\n")
    (tmp_path / "set" / "odd" / "x.bin").write_text("?")
    runs = catalog.ingest_to_tables(spark, str(tmp_path / "set"), str(tmp_path / "out"), "r")
    row = runs.first()
    details = json.loads(row["details"])
    assert row["status"] == "completed" and len(details["errors"]) == 1
    assert details["spark"] == {"ssh": {"row_count": 3}, "proxy": {"row_count": 1}}
    assert details["elasticsearch"] == {"ssh": {"document_count": 3, "failed": 0}, "proxy": {"document_count": 1, "failed": 0}}
    totals = A.ingestion_totals(runs).first()
    assert (totals["rows"], totals["documents"], totals["failed"]) == (4, 4, 0)
    assert spark.read.parquet(str(tmp_path / "out" / "tables" / "set_ssh")).count() == 3
    assert len(glob.glob(str(tmp_path / "out" / "documents" / "set-ssh" / "*.txt"))) >= 1
    empty = catalog.ingest_to_tables(spark, str(tmp_path / "set" / "ssh"), str(tmp_path / "o2"), "r").first()
    assert empty["status"] == "completed" and json.loads(empty["details"])["spark"] == {}
