"""Importance resampling against a brute-force version."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SF

from vigilspark.llm import importance
from vigilspark.llm.plans import QUERIES


def features(text):
    plain = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", plain)
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
    return [zlib.crc32(f.encode()) % 10000 for f in words + pairs], len(words)


def brute(docs, target):
    found = [features(t) for _, t in docs]
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for buckets, _ in found:
        np.add.at(s, buckets, 1)
    for text in target:
        np.add.at(t, features(text)[0], 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10000) / ((a + 1) * (t.sum() + 10000)))) for a, b in zip(s, t)]
    rows = []
    for (doc_id, _), (buckets, words) in zip(docs, found):
        weight = math.floor(sum(gain[b] for b in buckets) / len(buckets)) if buckets else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(buckets), weight, score, None, words])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, r in enumerate(able[: 25 * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    out = QUERIES["op13_importance_resampling"](spark, SF)
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint"] * 5
    assert got(out) == brute(docs, target)


def test_compose_equals_crc():
    rng = random.Random(1)
    words = [rng.randbytes(rng.choice([1, 2, 7, 64, 300, 70_000])) for _ in range(60)]
    left = np.array([zlib.crc32(w) for w in words[:-1]], np.uint32)
    right = np.array([zlib.crc32(w) for w in words[1:]], np.uint32)
    joined = importance.compose(left, right, np.array([len(w) for w in words[1:]]))
    assert joined.tolist() == [zlib.crc32(a + b) for a, b in zip(words, words[1:])]


@pytest.mark.parametrize("limit", [40, 4 << 20])
def test_dictionary_that_starts_anew(limit):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["Aé", "b-c", "ß9", "zz" * 200, "the", f"w{rng.random()}"]) for _ in range(rng.randrange(60)))
             for _ in range(50)]
    dictionary = importance.WordDictionary(limit)
    for at in range(0, 50, 10):
        some = texts[at : at + 10]
        for text, words in zip(some, importance.word_payloads([t.encode() for t in some], dictionary)):
            assert sorted(importance.feature_buckets(words)) == sorted(features(text)[0])


def test_long_text_is_cut_at_delimiters(monkeypatch):
    monkeypatch.setattr(importance, "PIECE", 50)
    text = " ".join(f"word{i}" for i in range(400)) + " " + "x" * 900 + " end"
    words = next(importance.word_payloads([text.encode()], importance.WordDictionary()))
    assert sorted(importance.feature_buckets(words)) == sorted(features(text)[0])


def test_odd_rows(spark):
    long = " ".join(f"w{i % 37}" for i in range(30_000))
    rows = [(1, None), (2, ""), (None, "a b " * 15), (None, "a b " * 15), (3, " \t!?"), (4, long), (4, long), (5, "Word"), (6, "ÀÉ x " * 30)]
    docs = spark.createDataFrame([(a, b, 0, "q", 1.0) for a, b in rows], "doc_id long, text string, _row int, _able string, rank double")
    target = spark.createDataFrame([("w1 w2",), (None,)], "text string")
    assert got(importance.importance(docs, target)) == brute(rows, ["w1 w2", None])
    drawn = importance.resample(docs, target)
    assert drawn.columns == docs.columns and drawn.count() == 1
    assert importance.importance(docs.limit(0), target).count() == 0
    assert importance.importance(docs, target.limit(0)).count() == len(rows)
