"""Fingerprints against a plain version, and likeness against exact shares of common shingles."""

import hashlib
import random
import re
import struct

import numpy as np
import xxhash
from conftest import SF

from vigilspark.llm import fingerprints as fp
from vigilspark.llm.plans import QUERIES


def chain(numbers):
    h = 42
    for x in numbers:
        h = xxhash.xxh64_intdigest(x, seed=h)
    return h


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def plain(text):
    """Bins filled one shingle at a time, then densified by the stated tries."""
    hashes = [chain([struct.pack("<Q", chain([w.encode()])) for w in s]) for s in shingles(text)]
    if not hashes:
        return ""
    bins = {}
    for h in hashes:
        # Bins are numbered in the order of signed hashes.
        at = ((h >> 56) + 128) % 256
        bins[at] = min(bins.get(at, 1 << 64), h & ((1 << 56) - 1))
    out = []
    for i in range(256):
        tries = [i] + [(a * (i + 1) + b) % fp.PRIME % 256 for a, b in fp.FACTORS]
        ranked = sorted(bins, key=lambda j: (fp._signed(chain([struct.pack("<i", i), struct.pack("<i", j)])) & -256) | j)
        donor = next((t for t in tries if t in bins), ranked[0])
        out.append("0123456789abcdef"[bins[donor] & 15])
    return "".join(out)


def near(a, b):
    if not a or not b:
        return float(a == b)
    equal = sum(x == y for x, y in zip(a, b)) / 256
    return min(max((equal - 1 / 16) / (1 - 1 / 16), 0.0), 1.0)


def brute(rows):
    docs = {(i, t or "") for i, t in rows}
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, hashlib.md5(f"{'~' if d[0] is None else d[0]}:{d[1]}".encode()).hexdigest()))
    after = dict(zip(order, order[1:] + order[:1]))
    out = []
    for i, t in rows:
        text, other = t or "", after[(i, t or "")][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        a, b, c = plain(text), plain(edited), plain(other)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, near(a, b), near(a, c)))
    return sorted(out, key=repr)


def got(df):
    cols = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def same(found, want):
    assert [r[:5] for r in found] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in found], [r[5:] for r in want], atol=1e-12)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = got(QUERIES["op11_fingerprints"](spark, SF))
    same(found, brute(rows))
    # Estimates lie around the exact shares.
    texts, errors = dict(rows), []
    ids = sorted(texts)
    for doc_id, *_, near_next in found:
        other = texts[ids[(ids.index(doc_id) + 1) % len(ids)]]
        a, b = shingles(texts[doc_id]), shingles(other)
        errors.append(near_next - (len(a & b) / len(a | b) if a | b else 1.0))
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.2


def test_likeness_is_unbiased(spark):
    rng = random.Random(4)
    for n in (12, 60, 900):
        rows, want = [], []
        for i in range(60):
            words = [f"w{rng.random()}" for _ in range(n)]
            cut = rng.randrange(n // 2, n)
            other = words[:cut] + [f"x{rng.random()}" for _ in range(n - cut)]
            a, b = shingles(" ".join(words)), shingles(" ".join(other))
            rows.append((" ".join(words), " ".join(other)))
            want.append(len(a & b) / len(a | b))
        df = spark.createDataFrame(rows, "a string, b string")
        df = fp.fingerprint(fp.fingerprint(df, "a", "pa"), "b", "pb")
        found = [r[0] for r in df.select(fp.likeness(df["pa"], df["pb"])).collect()]
        assert abs(np.mean(np.subtract(found, want))) < 0.03, n
        assert np.abs(np.subtract(found, want)).mean() < (0.12 if n == 12 else 0.06), n


def test_odd_rows(spark):
    long = " ".join(f"word{i % 5000}" for i in range(60_000))
    rows = [(None, "first é𝒳 of all"), (None, None), (1, ""), (1, ""), (2, "One two"), (2, "one two three four five six."), (2, "One two"),
            (3, long), (4, " \t\n "), (5, "ÀÉ ß " * 40), (6, long)]
    docs = spark.createDataFrame([(*r, 1, "k", 3) for r in rows], "doc_id long, text string, key int, prev_key string, packed int")
    found = got(fp.compare_edited(docs))
    same(found, brute(rows))
    by_text = {}
    for (i, t), r in zip(sorted(rows, key=repr), sorted(found, key=repr)):
        by_text.setdefault(r[1], set()).add(r[3]) if t == long else None
    assert len(by_text[len(long)]) == 1
    assert got(fp.compare_edited(docs.limit(0))) == []
    one = spark.createDataFrame([(9, "a b c d e f g h")], "doc_id long, text string")
    same(got(fp.compare_edited(one)), brute([(9, "a b c d e f g h")]))
