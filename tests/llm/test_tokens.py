"""Byte-level ids, packing and binary records against the tokenizers library and brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilspark.llm import binary_output, packing
from vigilspark.llm.plans import QUERIES
from vigilspark.llm.tokens import ByteEncoder, default_path

from conftest import SF

ODD = [None, "", " ", "a", "a", "  two  spaces\n\n \ttab ", "<|endoftext|>x", "é🙂ﬁ１  \x1c z", "x" * 40_000, "don't I'll  "]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def odd_documents(spark):
    rows = [(i if i != 5 else None, t, "n", 1) for i, t in enumerate(ODD)] + [(3, "a", "n", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, part string, bin int")


def test_same_ids_as_the_library(library):
    encoder = ByteEncoder(default_path())
    letters = ["a", "the", " ", "  ", "\n", "\t", "é", "1", "23", "'s", "!", "#$", "🙂", "<|endoftext|>", "中", "\x1c", "\xa0"]
    rng = random.Random(1)
    for text in ODD + ["".join(rng.choices(letters, k=rng.randint(1, 30))) for _ in range(2_000)]:
        assert list(encoder.ids(text or "")) == library(text)


@pytest.mark.parametrize("run", [" ", "\n", "a \n"])
def test_very_long_runs(library, run):
    text = "start " + run * 2_000_000 + " end <|endoftext|>"
    assert ByteEncoder(default_path()).ids(text).tolist() == library(text)


def check_packing(rows, texts, library, capacity):
    rebuilt, sequences = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        rebuilt.setdefault(r.doc_id, []).append(r)
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    for doc_id, text in texts.items():
        ids = library(text) + [0]
        pieces = sorted(rebuilt[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert all(r.length == capacity for r in pieces[1:]) and len(pieces) == -(-len(ids) // capacity)
        for r in pieces:
            assert r.ids_crc32 == crc(ids[r.start : r.start + r.length])
        assert sum(r.length for r in pieces) == len(ids)
    return len(sequences)


def test_packing_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = QUERIES["op5_best_fit_packing"](spark, SF).collect()
    used = check_packing(rows, texts, library, 2048)
    counts = np.bincount([min(r.length, 2048) for r in rows], minlength=2049)
    assert used <= 1.01 * packing.lower_bound(counts, 2048) + 1


def test_packing_odd_rows(spark, library):
    docs = odd_documents(spark)
    rows = packing.pack_documents(docs, capacity=64).collect()
    assert sum(r.length for r in rows) == sum(len(library(t)) + 1 for t in ODD + ["a"])
    assert packing.pack_documents(docs.limit(0)).count() == 0
    assert {r.doc_id for r in rows if r.doc_id is None} == {None}


def test_exchange_keeps_every_piece(spark):
    sizes = [700, 690, 680, 400, 350, 300, 990, 10] * 60
    items = spark.createDataFrame([(i, i, 0, 0, s, 7) for i, s in enumerate(sizes)], packing.PIECE)
    rows = packing.pack_pieces(items, 1000, part_items=20).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(sizes)))
    by = {}
    for r in rows:
        by[r.sequence_id] = by.get(r.sequence_id, 0) + r.length
    assert max(by.values()) <= 1000
    bound = packing.lower_bound(np.bincount(sizes, minlength=1001), 1000)
    assert bound <= len(by) <= bound * 1.1 + 2


@pytest.mark.parametrize("seed", range(6))
def test_bound_never_exceeds_the_best_packing(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 20) for _ in range(7)]

    def best(rest, rooms):
        if not rest:
            return len(rooms)
        options = [best(rest[1:], rooms[:i] + [room - rest[0]] + rooms[i + 1 :])
                   for i, room in enumerate(rooms) if room >= rest[0]]
        return min(options + [best(rest[1:], rooms + [20 - rest[0]])])

    optimum = best(sorted(sizes, reverse=True), [])
    bins, _ = packing.best_fit_decreasing(np.array(sizes), 20)
    assert packing.lower_bound(np.bincount(sizes, minlength=21), 20) <= optimum <= bins.max() + 1


def test_records_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    rows = {r.doc_id: r for r in QUERIES["op9_binary_records"](spark, SF).collect()}
    start = 0
    for d in docs:
        ids = library(d.text) + [2]
        r = rows[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_records_odd_rows_small_shards_and_shuffled_reads(spark, library):
    docs, uri = odd_documents(spark), binary_output.record_folder(spark)
    index = binary_output.write_records(docs, uri, shard_bytes=200)
    assert index.select("shard").distinct().count() > 1
    some = index.orderBy(F.desc("position")).filter("n_tokens < 100")
    got = sorted((repr(r.doc_id), list(r.ids)) for r in binary_output.read_records(some, uri).collect())
    ids = [(i if i != 5 else None, library(t) + [2]) for i, t in enumerate(ODD)] + [(3, library("a") + [2])]
    assert got == sorted((repr(i), x) for i, x in ids if len(x) < 100)
    starts = sorted((r.start, r.n_tokens) for r in index.collect())
    assert [s for s, _ in starts] == list(np.cumsum([0] + [n for _, n in starts])[:-1])
    empty = binary_output.record_folder(spark)
    assert binary_output.read_records(binary_output.write_records(docs.limit(0), empty), empty).count() == 0


def test_damage_is_found():
    data = bytearray(binary_output.frame(7, np.array([1, 70_000], np.uint32)))
    row_id, ids = binary_output.unframe(memoryview(data))
    assert row_id == 7 and list(ids) == [1, 70_000]
    for at in (3, 9, 20, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            binary_output.unframe(memoryview(bad))


def test_folders_are_qualified_by_spark(spark, tmp_path):
    assert binary_output.qualified(spark, str(tmp_path)) == f"file://{tmp_path}"
    assert binary_output.qualified(spark, f"file://{tmp_path}/x") == f"file://{tmp_path}/x"
    store, root = binary_output.open_store(binary_output.qualified(spark, str(tmp_path)))
    assert root == str(tmp_path) and store.type_name == "local"
