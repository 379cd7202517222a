"""Helpers shared by the text operators: batches, digests, words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import configure

# Rows in one Arrow batch; with the byte bound below, long texts make short batches.
BATCH_ROWS = 2_000
BATCH_BYTES = 16 << 20
# The same for operators whose tasks hold several times a batch's texts: words, hashes, passages, ids.
SMALL_ROWS = 512
SMALL_BYTES = 4 << 20
# Words that a table of a task knows at once; a full one starts anew.
WORD_LIMIT = 1 << 17


def prepare(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> SparkSession:
    """Session settings that keep Arrow batches of long texts small."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return spark


def arrow_map(df: DataFrame, schema: str, rows: Callable[[Iterator[dict]], Iterator[dict]]) -> DataFrame:
    """``mapInArrow`` over column dicts: ``rows`` gets ``{column: list}`` per batch and yields the same form."""
    target = T._parse_datatype_string(schema)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        columns = ({name: batch.column(i) for i, name in enumerate(batch.schema.names)} for batch in batches)
        for out in rows(columns):
            yield pa.RecordBatch.from_arrays(
                [v if isinstance(v, pa.Array) else pa.array(v, type=arrow.field(k).type) for k, v in
                 ((name, out[name]) for name in arrow.names)], schema=arrow)

    return df.mapInArrow(run, target)


# One 64-bit mixing step (the public splitmix64 constants), the base of all hashes of ids here.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x + MIX[0]).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * MIX[1]
        x = (x ^ (x >> np.uint64(27))) * MIX[2]
        return x ^ (x >> np.uint64(31))


class WordIds:
    """Numbers words as they appear; starts anew when the table grows past ``limit``."""

    def __init__(self, limit: int = WORD_LIMIT):
        self.limit = limit
        self.ids: dict[bytes, int] = {}

    def number(self, words: list[bytes]) -> np.ndarray:
        if len(self.ids) > self.limit:
            self.ids.clear()
        ids = self.ids
        try:
            return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
        except KeyError:
            for w in words:
                ids.setdefault(w, len(ids))
            return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))


class WordHashes:
    """A stable 64-bit hash for each word, kept in a bounded table."""

    def __init__(self, limit: int = WORD_LIMIT):
        self.limit = limit
        self.seen: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        seen, digest = self.seen, xxhash.xxh3_64_intdigest
        if len(seen) > self.limit:
            seen.clear()
        try:
            return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in words:
                if w not in seen:
                    seen[w] = digest(w)
            return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
