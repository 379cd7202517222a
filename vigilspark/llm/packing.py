"""Best-fit packing with certified bin counts.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt into
partitions by hash; each partition packs its own by best-fit decreasing and
computes lower bounds from dual-feasible functions. Where the bound equals the
bin count, the partition is certified: nothing can improve it alone. Partitions
with a gap hand in the documents of their unfilled bins; these are dealt anew,
together, and packed again, as long as that saves bins.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import SMALL_BYTES, SMALL_ROWS, arrow_map, prepare
from .tokens import ByteEncoder, default_path

CAPACITY = 2048
#: Items that one task packs in the first round; an exchange may hold twice as many.
PART_ITEMS = 65_536
ROUNDS = 4

PIECE = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECE}, part int, bin int, offset long, used long, bins long, bound long"


def document_pieces(
    docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY
) -> DataFrame:
    """Pieces of every document (``text`` plus ``end_id``), the first one shorter when it does not divide."""
    path = tokenizer or default_path()

    def cut(batches):
        encoder = ByteEncoder(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = np.append(encoder.ids(text or ""), np.uint32(end_id)).astype("<u4")
                ends = range(len(ids), 0, -capacity)
                for piece, end in enumerate(reversed(ends)):
                    first = max(0, end - capacity)
                    rows.append((doc_id, piece, first, end - first, zlib.crc32(ids[first:end].tobytes())))
            columns = list(zip(*rows)) or [[]] * 5
            yield dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), columns))

    out = arrow_map(
        docs.select(F.col("doc_id").cast("long"), "text"),
        "doc_id long, piece int, start long, length long, ids_crc32 long",
        cut,
    )
    return out.select(F.monotonically_increasing_id().alias("uid"), "*")


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs; ``counts[s]`` items of size ``s``.

    Two dual-feasible families and their composition: f drops items below a
    threshold and counts those above its complement as whole bins; u rounds a
    size down to a multiple of 1/k after stretching by k+1. Integers throughout.
    """
    sizes = np.arange(capacity + 1, dtype=np.int64)
    counts = counts.astype(np.int64)
    best = 0
    present = sizes[counts > 0]
    thresholds = np.unique(np.append(present[present <= capacity // 2], 0))
    weighted = np.cumsum(counts * sizes)
    number = np.cumsum(counts)
    for e in thresholds:
        middle = weighted[capacity - e] - (weighted[e - 1] if e else 0)
        whole = number[capacity] - number[capacity - e]
        best = max(best, whole + -(-int(middle) // capacity))
    for k in range(1, 11):
        stretched = (k + 1) * sizes
        # value of u in units of 1 / (k * capacity)
        u = np.where(stretched % capacity == 0, k * sizes, (stretched // capacity) * capacity)
        weighted, unit = np.cumsum(counts * u), k * capacity
        for e in thresholds:
            middle = weighted[capacity - e] - (weighted[e - 1] if e else 0)
            whole = number[capacity] - number[capacity - e]
            best = max(best, whole + -(-int(middle) // unit))
    return int(best)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; bins of equal room are kept together, a bit set names the rooms in use."""
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, made = 0, 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        fitting = used >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            target = rooms[room].pop()
            if not rooms[room]:
                used &= ~(1 << room)
        else:
            room, target, made = capacity, made, made + 1
        bins[i], offsets[i] = target, capacity - room
        left = room - size
        if left:
            rooms[left].append(target)
            used |= 1 << left
    return bins, offsets


def _pack(items: DataFrame, parts: int, seed: int, capacity: int) -> DataFrame:
    def pack(pdf):
        pdf = pdf.sort_values("uid", ignore_index=True)
        lengths = pdf["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        made = int(bins.max()) + 1
        return pdf.assign(
            bin=bins, offset=offsets, used=np.bincount(bins, lengths).astype(np.int64)[bins], bins=made,
            bound=lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity),
        )

    part = F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(parts)).cast("int")
    return items.withColumn("part", part).groupBy("part").applyInPandas(pack, PACKED)


def pack_pieces(
    pieces: DataFrame, capacity: int = CAPACITY, part_items: int = PART_ITEMS, rounds: int = ROUNDS
) -> DataFrame:
    """Sequence and offset of each piece; pieces that fill a sequence alone are not packed further.

    ``certified`` says whether the piece's last partition met its lower bound.
    Every partition holds a hash share of the pieces, so equal or hot documents
    spread; its size is bounded by ``part_items`` (twice that after an exchange).
    """
    pieces = written(pieces, "pieces")
    whole = pieces.filter(F.col("length") >= capacity)
    items = pieces.filter(F.col("length") < capacity)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    done = [whole.select(*columns, F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
                         F.lit(True).alias("certified"))]

    def settled(packed: DataFrame, turn: int) -> DataFrame:
        number = F.lit(turn).cast("long") * (1 << 58) + F.col("part").cast("long") * (1 << 20) + F.col("bin")
        return packed.select(*columns, (-1 - number).alias("sequence_id"), "offset",
                             (F.col("bins") == F.col("bound")).alias("certified"))

    def measure(packed: DataFrame):
        first = F.col("offset") == 0
        released = (F.col("bins") > F.col("bound")) & (F.col("used") < capacity)
        return packed.agg(
            F.count_if(first & released).alias("bins"), F.count_if(released).alias("items"),
            F.count_distinct(F.when(F.col("bins") > F.col("bound"), F.col("part"))).alias("gaps"),
            F.count_if(first).alias("all_bins"),
        ).first()

    total = items.count()
    packed = written(_pack(items, max(1, -(-total // part_items)), 0, capacity), "packed")
    for turn in range(rounds):
        now = measure(packed)
        open_bins = (F.col("bins") > F.col("bound")) & (F.col("used") < capacity)
        if turn + 1 == rounds or now["gaps"] < 2 or now["items"] == 0:
            break
        pool = packed.filter(open_bins).select("uid", *columns)
        again = written(_pack(pool, max(1, -(-now["items"] // (2 * part_items))), turn + 1, capacity), "packed")
        if measure(again)["all_bins"] >= now["bins"]:
            break
        done.append(settled(packed.filter(~open_bins), turn))
        packed = again
    else:
        turn = rounds - 1
    done.append(settled(packed, turn))
    out = done[0]
    for frame in done[1:]:
        out = out.unionByName(frame)
    return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY,
                   part_items: int = PART_ITEMS) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    Null text is an empty one and still holds its end token; null or repeated ids
    are kept as they are; other columns are ignored; an empty table gives no rows.
    """
    prepare(docs.sparkSession, SMALL_ROWS, SMALL_BYTES)
    return pack_pieces(document_pieces(docs, tokenizer, end_id, capacity), capacity, part_items)
