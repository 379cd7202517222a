import glob
import os
import re
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from vigilspark.operators.aggregates import entity_rollup, merge_entities
from vigilspark.operators.profiles import generations, manifest, merge_into, read_profiles
from vigilspark.sources.snapshots import bucket_rows, changed_buckets, snapshot_changes, write_snapshot

LAYOUT = "id long, name string, risk double"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_changes_between_snapshots(spark, tmp_path):
    old = [(i, f"n{i}", float(i)) for i in range(200)] + [(None, "nobody", None)]
    new = [r for r in old if r[0] not in (5, 6)] + [(500, None, 1.0)]
    new = [(i, "renamed", v) if i == 9 else (i, n, None) if i == 11 else (i, n, 7.0) if i is None else (i, n, v) for i, n, v in new]
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    write_snapshot(spark.createDataFrame(old, LAYOUT), a, "id", 64)
    write_snapshot(spark.createDataFrame(new, LAYOUT).repartition(5), b, "id", 64)
    assert rows_of(snapshot_changes(spark, a, b, "id")) == sorted([
        ("DELETE", 5, "n5", 5.0), ("DELETE", 6, "n6", 6.0), ("INSERT", 500, None, 1.0), ("UPDATE", 9, "renamed", 9.0),
        ("UPDATE", 11, "n11", None), ("UPDATE", None, "nobody", 7.0)], key=repr)
    assert rows_of(snapshot_changes(spark, a, a, "id")) == []


def test_equal_buckets_are_not_read(spark, tmp_path):
    old = [(i, f"n{i}", float(i)) for i in range(500)]
    new = [(i, n, v + 1 if i == 77 else v) for i, n, v in old]
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    write_snapshot(spark.createDataFrame(old, LAYOUT), a, "id", 32)
    write_snapshot(spark.createDataFrame(new, LAYOUT).repartition(3), b, "id", 32)
    (bucket,) = changed_buckets(spark, a, b)
    assert rows_of(snapshot_changes(spark, a, b, "id")) == [("UPDATE", 77, "n77", 78.0)]
    # With the files of all other buckets unreadable, the result is still there.
    for path in glob.glob(f"{tmp_path}/*/rows/_bucket=*/*.parquet"):
        if f"_bucket={bucket}/" not in path:
            with open(path, "wb") as f:
                f.write(b"not parquet")
            os.unlink(os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc"))
    assert rows_of(snapshot_changes(spark, a, b, "id")) == [("UPDATE", 77, "n77", 78.0)]
    assert len({r["_bucket"] for r in bucket_rows(spark, a, [bucket]).collect()}) == 1


def test_snapshot_of_nothing_and_of_repeated_keys(spark, tmp_path):
    some = spark.createDataFrame([(1, "x", 1.0)], LAYOUT)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    write_snapshot(some.limit(0), a, "id", 4)
    write_snapshot(some, b, "id", 4)
    assert rows_of(snapshot_changes(spark, a, b, "id")) == [("INSERT", 1, "x", 1.0)]
    assert rows_of(snapshot_changes(spark, b, a, "id")) == [("DELETE", 1, "x", 1.0)]
    with pytest.raises(ValueError, match="does not identify"):
        write_snapshot(some.union(some), str(tmp_path / "c"), "id", 4)
    with pytest.raises(ValueError, match="taken"):
        write_snapshot(some.withColumnRenamed("name", "_digest"), str(tmp_path / "d"), "id", 4)


# ------------------------------------------------------------------ profiles


def anomalies(spark, n, seed):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame(pd.DataFrame({
        "entity_id": [None if i % 31 == 0 else f"e{i % 40}" for i in range(n)],
        "entity_type": [None if i % 5 == 0 else "user" for i in range(n)],
        "risk_score": rng.uniform(0, 100, n).round(2),
        "timestamp": [datetime(2024, 1, 1) + timedelta(minutes=int(m)) for m in rng.integers(0, 5000, n)]}))


def files(path):
    return set(glob.glob(f"{path}/data/**/*.parquet", recursive=True))


@pytest.mark.parametrize("keep", [False, True])
def test_merge_equals_the_whole_table(spark, tmp_path, keep):
    path, df, more = str(tmp_path / "p"), anomalies(spark, 300, 1), anomalies(spark, 200, 2)
    merge_into(df, path, buckets=8, keep_first_seen=keep)
    merge_into(more, path, buckets=8, keep_first_seen=keep)
    want = merge_entities(entity_rollup(df), more, keep)
    assert rows_of(read_profiles(spark, path).select(want.columns)) == rows_of(want)


def test_a_delta_leaves_other_buckets_alone(spark, tmp_path):
    path, df = str(tmp_path / "p"), anomalies(spark, 300, 1)
    merge_into(df, path, buckets=16)
    before = files(path)
    touched = merge_into(df.where("entity_id = 'e7'"), path, buckets=16)
    assert len(touched) <= 2
    written = files(path) - before
    assert {int(re.search(r"_bucket=(\d+)", f).group(1)) for f in written} == set(touched)
    assert before <= files(path)
    held = manifest(spark, path, 1)
    assert {b for b, g in held.items() if g == 1} == set(touched) and len(held) > len(touched)


def test_one_generation_is_read_and_old_ones_go(spark, tmp_path):
    path, df = str(tmp_path / "p"), anomalies(spark, 400, 3)
    for i in range(20):
        merge_into(df.where(f"pmod(hash(entity_id, timestamp), 20) = {i}"), path, i, buckets=4)
    assert generations(spark, path) == [18, 19]
    want = entity_rollup(df)
    found = read_profiles(spark, path)
    assert rows_of(found.select(want.columns)) == rows_of(want)
    assert len(found.inputFiles()) == len(manifest(spark, path, 19))
    kept = {(b, g) for n in (18, 19) for b, g in manifest(spark, path, n).items()}
    assert len(files(path)) == len(kept)
    # The last batch runs again after a failure: it does not count twice.
    merge_into(df.where("pmod(hash(entity_id, timestamp), 20) = 19"), path, 19, buckets=4)
    assert rows_of(read_profiles(spark, path).select(want.columns)) == rows_of(want)
    with pytest.raises(ValueError, match="already"):
        merge_into(df, path, 3, buckets=4)


def test_an_unfinished_merge_is_not_seen(spark, tmp_path):
    path, df = str(tmp_path / "p"), anomalies(spark, 100, 4)
    merge_into(df, path, buckets=4)
    want = rows_of(read_profiles(spark, path))
    merge_into(df, path, buckets=4)
    os.unlink(f"{path}/manifest/generation=1/_SUCCESS")
    assert rows_of(read_profiles(spark, path)) == want
    merge_into(df, path, 1, buckets=4)
    assert generations(spark, path) == [0, 1]


def test_no_profiles(spark, tmp_path):
    assert read_profiles(spark, str(tmp_path / "none")).count() == 0
    merge_into(anomalies(spark, 10, 5).limit(0), str(tmp_path / "p"))
    assert read_profiles(spark, str(tmp_path / "p")).count() == 0
