"""One alert per key and interval.

The rule is greedy: an alert is kept when it is at least one interval later than
the last *kept* alert of its key. That depends on the whole past of the key, but
not all of it matters:

* at most one alert is kept per interval-wide bucket, and
* after an empty bucket the past is forgotten.

A key that fits in a task is folded in one sorted pass. For a larger key, each
run of adjacent non-empty buckets stands on its own, and all it needs to know on
entering a bucket is an offset: how far into the bucket the last kept alert still
reaches. Runs are cut into blocks of bounded size. A run of one block is folded
like a small key. In a longer run each block first maps every offset it may be
entered with to the offset it is left with; the maps are chained by joins of
doubling reach, which yields the true entry offset of every block, and then each
block is folded from there. A single bucket too large for one task is answered by
a distributed ordered scan instead. Nothing is dropped and no large key is ever
gathered in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .scan import null_safe_join, running

FOLD_ROWS = 50_000
# A task of a shuffle gets about so many rows at most; more rows make more tasks.
TASK_ROWS = 500_000


def _micros(text: str) -> int:
    amount, unit = text.split()
    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
    return int(float(amount) * seconds * 1_000_000)


def _dealt(df: DataFrame, rows: int, *columns) -> DataFrame:
    """``df`` dealt out so that a task sorts about ``TASK_ROWS`` rows, however large the table is.

    The session's number of shuffle partitions is fixed and adaptive execution only
    lowers it. It is left alone while there is no more than one such task per core.
    """
    tasks = -(-rows // TASK_ROWS)
    return df.repartition(tasks, *columns) if tasks > df.sparkSession.sparkContext.defaultParallelism else df


def first_per_key(candidates: DataFrame, keys: list[str], ts: str, tie: str = "id") -> DataFrame:
    fields = [c for c in candidates.columns if c not in keys]
    picked = candidates.groupBy(*keys).agg(
        F.min_by(F.struct(*fields), F.struct(ts, tie)).alias("_row")
    )
    return picked.select(*keys, "_row.*").select(*candidates.columns)


def suppress(
    candidates: DataFrame,
    keys: list[str],
    ts: str = "created_at",
    interval: str = "1 hour",
    mode: str = "event",
    tie: str = "id",
    fold_rows: int = FOLD_ROWS,
) -> DataFrame:
    """Rows of ``candidates`` that are not suppressed.

    ``mode="run"``: the earliest row per key. ``mode="event"``: event time,
    kept rows at least one interval apart (exactly one interval is kept).
    ``tie`` is a unique row id.
    """
    if mode == "run":
        return first_per_key(candidates, keys, ts, tie)
    if mode != "event":
        raise ValueError(f"unknown mode {mode!r}")
    width = _micros(interval)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    # Only one row per instant can be kept, and only its id is needed.
    points = candidates.groupBy(*keys, micros.alias("_t")).agg(F.min(tie).alias("_id"))
    rows = candidates.count()
    points = written(points.withColumn("_b", F.floor(F.col("_t") / width).cast("long")), "points")
    sizes = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = written(sizes.where(F.col("_n") > fold_rows).select(*keys, F.lit(True).alias("_large")), "large")
    if large.isEmpty():
        kept = _folded(points, keys, width, rows=rows)
    else:
        marked = null_safe_join(points, large, keys)
        kept = _folded(marked.where(F.col("_large").isNull()), keys, width, rows=rows)
        hot = written(marked.where("_large").drop("_large"), "hot")
        kept = kept.unionByName(_by_runs(hot, keys, width, fold_rows))
    ids = _dealt(kept.select(F.col("_id").alias(tie)), rows, tie)
    return _dealt(candidates, rows, tie).join(ids, tie, "left_semi").select(*candidates.columns)


def _by_runs(points: DataFrame, keys: list[str], width: int, fold_rows: int) -> DataFrame:
    """Greedy scan of keys too large for one task, run by run."""
    members, blocks = _blocks(points, keys, fold_rows)
    tagged = null_safe_join(points, members, [*keys, "_b"], "inner")
    kept = _folded(tagged.where(~F.col("_long")), [*keys, "_run"], width)
    longest = blocks.where("_long").agg(F.max("_of").alias("n")).first()["n"]
    if longest:
        long = tagged.where("_long").withColumn("_o", F.col("_t") - F.col("_b") * width)
        kept = kept.unionByName(_chained(long, blocks.where("_long"), keys, width, longest, fold_rows))
    return kept


def _blocks(points: DataFrame, keys: list[str], fold_rows: int) -> tuple[DataFrame, DataFrame]:
    """(buckets with run and block, blocks with their place in the run).

    A block holds buckets of one run, fewer than ``fold_rows`` instants before
    its last bucket; a bucket with more than that is a block of its own.
    """
    buckets = points.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    dense = (F.col("_n") > fold_rows).cast("long")
    placed = running(
        buckets.withColumn("_one", F.lit(1).cast("long")).withColumn("_dense", dense),
        keys, ["_b"], sums={"_rank": "_one", "_upto": "_n", "_denses": "_dense"},
    ).select(
        *keys, "_b", "_n", "_dense",
        # Inside a run the bucket number and its position grow together.
        (F.col("_b") - F.col("_rank")).alias("_run"),
        F.floor((F.col("_upto") - F.col("_n")) / max(fold_rows, 1)).alias("_q"),
        (2 * F.col("_denses") - F.col("_dense")).alias("_d"),
    )
    placed = written(placed, "buckets")
    label = [*keys, "_run", "_q", "_d"]
    blocks = placed.groupBy(*label).agg(
        F.min("_b").alias("_first"), F.max("_b").alias("_last"), F.max("_dense").alias("_dense"),
        F.max_by("_n", "_b").alias("_leaves"),
    )
    counts = blocks.groupBy(*keys, "_run").agg(
        F.count(F.lit(1)).alias("_of"), F.max("_dense").alias("_any")
    )
    blocks = null_safe_join(blocks, counts, [*keys, "_run"], "inner").withColumn(
        "_long", (F.col("_of") > 1) | (F.col("_any") > 0)
    ).drop("_any")
    ordered = running(
        blocks.withColumn("_one", F.lit(1).cast("long")), [*keys, "_run"], ["_first"], sums={"_j": "_one"}
    ).withColumn("_j", F.col("_j") - 1).drop("_one")
    ordered = written(ordered, "blocks")
    members = null_safe_join(
        placed.select(*label, "_b"), ordered.select(*label, "_j", "_first", "_last", "_dense", "_of", "_long"),
        label, "inner",
    ).drop("_q", "_d")
    return members, ordered


def _folded(points: DataFrame, group: list[str], width: int, after: str | None = None, rows: int = 0) -> DataFrame:
    """Greedy scan of groups in one sorted pass; ``after`` is the earliest time that may be kept.

    A task carries only the group at hand and its last kept time, so the work is
    linear and no group is gathered.
    """
    begin = F.col(after) - width if after else F.lit(None).cast("long")
    named = points.select(F.to_json(F.struct(*group)).alias("_key"), "_t", "_id", begin.alias("_begin"))
    named = _dealt(named.repartition("_key"), rows, "_key").sortWithinPartitions("_key", "_t")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last = None, None
        for batch in batches:
            keys, times = batch.column("_key").to_pylist(), batch.column("_t").to_numpy()
            begins = batch.column("_begin")
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            kept: list[int] = []
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                if keys[start] != current:
                    current, last = keys[start], begins[start].as_py()
                at = start if last is None else start + int(np.searchsorted(times[start:end], last + width))
                while at < end:
                    kept.append(at)
                    last = int(times[at])
                    at += 1 + int(np.searchsorted(times[at + 1 : end], last + width))
            yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(kept, pa.int64()))], names=["_id"])

    return named.mapInArrow(scan, T.StructType([points.schema["_id"]]))


def walk(times: np.ndarray, entries: np.ndarray, first: int, last: int, width: int) -> np.ndarray:
    """Offsets a block is left with, for the offsets it may be entered with."""
    times = np.sort(times)
    bucket = times // width
    offset = entries.copy()
    for b in range(first, last + 1):
        inside = times[np.searchsorted(bucket, b) : np.searchsorted(bucket, b, side="right")] - b * width
        at = np.searchsorted(inside, offset)
        found = at < len(inside)
        offset = np.where(found, inside[np.minimum(at, len(inside) - 1)], 0)
    return offset


def _maps(points: DataFrame, entries: DataFrame, blocks: DataFrame, keys: list[str], width: int, fold_rows: int) -> DataFrame:
    """(run, block, entry offset, exit offset) of the blocks that fit in a task.

    The block before may leave very many offsets; they are dealt out in chunks,
    each with a copy of the block's instants.
    """
    run = [*keys, "_run", "_j"]
    before = blocks.select(*keys, "_run", (F.col("_j") + 1).alias("_j"), "_leaves")
    chunks = null_safe_join(
        blocks.where("_dense = 0").select(*run, "_first", "_last"), before, run
    ).select(
        *run, "_first", "_last",
        F.ceil((F.coalesce("_leaves", F.lit(0)) + 1) / max(fold_rows, 1000)).cast("int").alias("_chunks"),
    )
    asked = null_safe_join(entries, chunks, run, "inner").select(
        *run, "_first", "_last", F.pmod(F.xxhash64("_x"), F.col("_chunks")).cast("int").alias("_chunk"),
        F.col("_x").alias("_value"), F.lit(True).alias("_ask"),
    )
    held = null_safe_join(points.select(*run, "_t"), chunks, run, "inner").select(
        *run, "_first", "_last", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_chunk"),
        F.col("_t").alias("_value"), F.lit(False).alias("_ask"),
    )

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ask = pdf["_ask"].to_numpy()
        value = pdf["_value"].to_numpy()
        entry = value[ask]
        out = pdf.loc[ask, run].copy()
        out["_x"] = entry
        out["_next"] = walk(
            value[~ask], entry, int(pdf["_first"].iloc[0]), int(pdf["_last"].iloc[0]), width
        )
        return out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.select(*run).schema)
    return asked.unionByName(held).groupBy(*run, "_chunk").applyInPandas(
        solve, f"{kinds}, _x bigint, _next bigint"
    )


def _answers(points: DataFrame, entries: DataFrame, run: list[str]) -> DataFrame:
    """Like ``_maps`` for single oversized buckets, with the id that is kept.

    The answer to an offset is the first instant at or after it: scan downwards
    and remember the last instant seen.
    """
    zero = F.lit(0).cast("long")
    null_id = F.lit(None).cast(points.schema["_id"].dataType)
    mixed = points.select(
        *run, (-F.col("_o")).alias("_down"), F.lit(0).alias("_ask"),
        F.struct(F.col("_o").alias("o"), F.col("_id").alias("id")).alias("_point"),
    ).unionByName(
        entries.select(
            *run, (-F.col("_x")).alias("_down"), F.lit(1).alias("_ask"),
            F.when(F.lit(False), F.struct(zero.alias("o"), null_id.alias("id"))).alias("_point"),
        )
    )
    scanned = running(mixed, run, ["_down", "_ask"], fills={"_hit": "_point"})
    return scanned.where(F.col("_ask") == 1).select(
        *run, (-F.col("_down")).alias("_x"), F.coalesce(F.col("_hit.o"), zero).alias("_next"),
        F.col("_hit.id").alias("_id"),
    )


def _chained(
    points: DataFrame, blocks: DataFrame, keys: list[str], width: int, longest: int, fold_rows: int
) -> DataFrame:
    """Greedy scan of runs that span several blocks."""
    run = [*keys, "_run", "_j"]
    zero = F.lit(0).cast("long")
    carried = points.where((F.col("_b") == F.col("_last")) & (F.col("_j") + 1 < F.col("_of"))).select(
        *keys, "_run", (F.col("_j") + 1).alias("_j"), F.col("_o").alias("_x")
    )
    fresh = blocks.select(*run, zero.alias("_x"))
    entries = written(carried.unionByName(fresh).distinct(), "entries")
    oversized = blocks.where("_dense > 0").select(*run)
    answers = written(
        _answers(points.where("_dense > 0"), null_safe_join(entries, oversized, run, "inner"), run), "answers"
    )
    maps = _maps(points.where("_dense = 0"), entries, blocks, keys, width, fold_rows)
    step = written(maps.unionByName(answers.drop("_id")), "jump")
    tables, reach = [step], 1
    while reach < longest:
        last = tables[-1]
        head = last.where(F.col("_j") % (2 * reach) == 0)
        tail = last.select(
            *keys, "_run", (F.col("_j") - reach).alias("_j"), F.col("_x").alias("_next"), F.col("_next").alias("_after")
        )
        joined = null_safe_join(head, tail, [*run, "_next"], "inner")
        tables.append(written(joined.select(*run, "_x", F.col("_after").alias("_next")), "jump"))
        reach *= 2
    visited = step.where((F.col("_j") == 0) & (F.col("_x") == 0)).select(*run, "_x")
    for table in reversed(tables):
        landed = null_safe_join(visited, table, [*run, "_x"], "inner").select(
            *keys, "_run", (F.col("_j") + reach).alias("_j"), F.col("_next").alias("_x")
        )
        visited = written(visited.unionByName(landed), "visited")
        reach //= 2
    # Every block now has its one true entry offset.
    inside = null_safe_join(points.where("_dense = 0"), visited, run, "inner")
    after = F.col("_first") * width + F.col("_x")
    folded = _folded(inside.withColumn("_after", after), run, width, "_after")
    exact = null_safe_join(visited, answers, [*run, "_x"], "inner").where(F.col("_id").isNotNull())
    return folded.unionByName(exact.select("_id"))
