"""Token ids as length-delimited binary records with an offset index.

A shard is a plain sequence of frames, nothing before, between or after them:

    length   unsigned 64-bit, of the payload
    check    unsigned 32-bit, masked checksum of the eight length bytes
    payload  has_id u8 | id width in bytes u8 | row id i64 | n u32 | n ids
    check    unsigned 32-bit, masked checksum of the payload

All numbers are little-endian. A masked checksum is the CRC-32 rotated right by
15 bits plus a constant, so that a checksum stored inside checked data does not
check itself. The index is a separate Parquet table with one row per record
(shard, offset, size, first position of its ids in the whole corpus); it lets a
training job read records in any order. Only shards that the index names
count: a task that dies leaves an unnamed file, its second attempt another name.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import arrow_map, prepare
from .tokens import ByteEncoder, default_path

SHARD_BYTES = 64 << 20
MASK_DELTA = 0xA282EAD8  # the public constant of this frame family, a fixed value
HEAD = "<BBqI"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(row_id: int | None, ids: np.ndarray) -> bytes:
    """One record; ids take two bytes each when all of them fit."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    payload = struct.pack(HEAD, row_id is not None, width, row_id or 0, len(ids)) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(data: memoryview) -> tuple[int | None, np.ndarray]:
    """The record that ``data`` holds exactly; any flipped bit raises ValueError."""
    length = bytes(data[:8])
    (check,) = struct.unpack_from("<I", data, 8)
    (size,) = struct.unpack("<Q", length)
    if check != masked(length) or size != len(data) - 16:
        raise ValueError("damaged record length")
    payload = data[12 : 12 + size]
    (check,) = struct.unpack_from("<I", data, 12 + size)
    if check != masked(payload):
        raise ValueError("damaged record payload")
    has_id, width, row_id, n = struct.unpack_from(HEAD, payload)
    return (row_id if has_id else None), np.frombuffer(payload, f"<u{width}", n, struct.calcsize(HEAD))


def qualified(spark, uri: str) -> str:
    """The folder with the scheme of the file system that Spark takes it to lie on."""
    at = spark._jvm.org.apache.hadoop.fs.Path(uri)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def open_store(uri: str):
    """Filesystem and path of a folder that all executors share; name it with its scheme (see ``qualified``)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


INDEX = "doc_id long, part int, shard string, position long, size long, start long, n_tokens long"


def write_records(
    docs: DataFrame,
    uri: str,
    tokenizer: str | None = None,
    end_id: int | None = 2,
    shard_bytes: int = SHARD_BYTES,
    partitions: int | None = None,
) -> DataFrame:
    """Encode ``text`` of every row and write shards under ``uri``, in ascending ``doc_id``.

    Returns the index, read back from ``uri/index``. Null text is an empty one (its
    record holds only ``end_id``); null ids come first; rows of one id are ordered
    by their text's hash and may lie in several partitions, so a repeated id is no
    hot key. An empty table gives an empty index. Other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    uri = qualified(spark, uri)
    path = tokenizer or default_path()
    order = ["doc_id", "_h", "_p"]
    rows = docs.select(
        F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("_h", F.xxhash64("text")).withColumn("_p", F.spark_partition_id())
    by = [F.col(c).asc_nulls_first() for c in order]
    dealt = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    dealt = dealt.sortWithinPartitions(*by).select("doc_id", "text")

    def write(batches):
        from pyspark import TaskContext

        store, root = open_store(uri)
        store.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        encoder = ByteEncoder(path)
        out, name, at, start = None, "", 0, 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = encoder.ids(text)
                if end_id is not None:
                    ids = np.append(ids, np.uint32(end_id))
                data = frame(doc_id, ids)
                if out is not None and at + len(data) > shard_bytes:
                    out.close()
                    out = None
                if out is None:
                    name, at = f"part-{part:06d}-{uuid.uuid4().hex}.bin", 0
                    out = store.open_output_stream(f"{root}/{name}")
                out.write(data)
                rows.append((doc_id, part, name, at, len(data), start, len(ids)))
                at, start = at + len(data), start + len(ids)
            if out is not None:
                out.flush()
            columns = list(zip(*rows)) or [[]] * 7
            yield dict(zip(("doc_id", "part", "shard", "position", "size", "start", "n_tokens"), columns))
        if out is not None:
            out.close()

    arrow_map(dealt, INDEX, write).write.parquet(f"{uri}/index")
    return read_index(spark, uri)


def read_index(spark, uri: str) -> DataFrame:
    """Every record: where it lies and how many ids come before it in the corpus."""
    index = spark.read.schema(INDEX).parquet(f"{uri}/index")
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    # One row per written partition, so this window is as small as the job's task list.
    before = parts.select("part", (F.sum("_n").over(W.orderBy("part")) - F.col("_n")).alias("_before"))
    return index.join(before, "part").withColumn("start", F.col("start") + F.col("_before")).drop("_before")


def read_records(index: DataFrame, uri: str, digest: bool = False) -> DataFrame:
    """The records that ``index`` names, in any order and from any subset of it.

    Each task opens the shards of its index rows, seeks, checks both checksums
    and gives ``ids`` (or their CRC-32 as unsigned 32-bit integers).
    """
    schema = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<long>")

    uri = qualified(index.sparkSession, uri)

    def read(batches):
        store, root = open_store(uri)
        for batch in batches:
            shard, at, size = (batch[c].to_pylist() for c in ("shard", "position", "size"))
            out, source, name = [], None, None
            for s, a, n in zip(shard, at, size):
                if s != name:
                    if source:
                        source.close()
                    source, name = store.open_input_file(f"{root}/{s}"), s
                source.seek(a)
                row_id, ids = unframe(memoryview(source.read(n)))
                value = zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.astype("i8")
                out.append((row_id, len(ids), value))
            if source:
                source.close()
            doc_id, n_tokens, value = list(zip(*out)) or [[]] * 3
            yield {"doc_id": doc_id, "start": batch["start"], "n_tokens": n_tokens,
                   "ids_crc32" if digest else "ids": value}

    return arrow_map(index.select("shard", "position", "size", "start"), schema, read)


def record_folder(spark) -> str:
    """A fresh folder for shards on the storage that all executors share."""
    return scratch_path(spark, "records")
