"""The n-gram join against all pairs."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from vigilspark.llm import ngram_join
from vigilspark.llm.plans import QUERIES

from conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_force(rows, percent=80):
    """doc_id -> (set size, least id reachable), from every pair."""
    sets = {}
    for i, text in rows:
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = frozenset(tuple(words[k : k + 5]) for k in range(max(len(words) - 4, min(1, len(words)))))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, key string")


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found(QUERIES["op2_ngram_jaccard_join"](spark, SF)) == brute_force(rows)


@pytest.mark.parametrize("counters, block, verify_cost", [(1 << 21, 4096, 40.0), (1 << 6, 1, 40.0), (1 << 12, 7, 1e6)])
def test_groups_passages_and_chains(spark, monkeypatch, counters, block, verify_cost):
    """Near copies of each other, chains, a shared passage, and short texts, whatever the estimates say."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "VERIFY_COST", verify_cost)
    rng = random.Random(block)
    fresh = lambda n: [f"w{rng.randrange(10_000)}" for _ in range(n)]
    base, passage, texts = fresh(90), fresh(40), []
    for _ in range(30):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(90)] = fresh(1)[0]
        texts.append(copy)
    chain = fresh(80)
    for _ in range(25):
        chain = chain[2:] + fresh(2)
        texts.append(chain)
    texts += [fresh(rng.randint(5, 30)) + passage + fresh(rng.randint(0, 20)) for _ in range(25)]
    texts += [passage, passage + ["end"], fresh(3), ["One", "TWO"], ["one", "two"], ["é"], ["É"]]
    texts += [texts[i] for i in rng.choices(range(len(texts)), k=10)]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert found(ngram_join.join_documents(frame(spark, rows), counters=counters)) == brute_force(rows)


def test_exactly_at_the_threshold(spark):
    words = [f"v{i}" for i in range(44)]
    # 40 shingles; with the last 4 or 5 words replaced 36 or 35 are common: 36/44 and 35/45.
    rows = [(1, " ".join(words)), (2, " ".join(words[:40] + list("abcd"))), (3, " ".join(words[:39] + list("efghi")))]
    assert found(ngram_join.join_documents(frame(spark, rows))) == brute_force(rows)
    edge = [f"v{i}" for i in range(13)]  # 9 shingles, 8 of them common with ten: 8/10
    rows = [(7, " ".join(edge)), (9, " ".join(edge[:12] + ["x"])), (8, " ".join(edge[:12]))]
    assert found(ngram_join.join_documents(frame(spark, rows))) == brute_force(rows)


def test_odd_rows(spark):
    long_text = " ".join(f"u{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a"), (4, "a"), (5, "a"), (None, "a"), (6, long_text), (7, long_text + " z"),
            (8, "b c d e f"), (8, "other words than before here")]
    out = ngram_join.join_documents(frame(spark, rows)).collect()
    got = sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in out)
    assert got == sorted([("1", 0, "1"), ("2", 0, "2"), ("3", 0, "3"), ("4", 1, "4"), ("4", 1, "4"), ("5", 1, "4"),
                          ("None", 1, "None"), ("6", 29_996, "6"), ("7", 29_997, "6"), ("8", 1, "8"), ("8", 1, "8")])
    kept = sorted(repr(r.doc_id) for r in ngram_join.keep_one(frame(spark, rows)).collect())
    # The two texts of id 8 do not link, so both stay.
    assert kept == sorted(map(repr, [1, 2, 3, 4, None, 6, 8, 8]))
    empty = frame(spark, rows).limit(0)
    assert ngram_join.join_documents(empty).count() == ngram_join.keep_one(empty).count() == 0


def test_keep_one_leaves_one_row_of_every_component(spark):
    """Repeated ids over different texts, one id on a third of the rows, clashing column names."""
    rng = random.Random(12)
    bases = [[f"b{k}w{i}" for i in range(40)] for k in range(12)]
    texts = [" ".join(b) for b in bases] + [" ".join(b[:39] + ["end"]) for b in bases] + ["", None, " \n"]
    rows = [(rng.choice([1, 2, 3, 8, 9, None, 7, 7, 7]), rng.choice(texts)) for _ in range(150)] + [(3, texts[0]), (8, texts[0]), (8, texts[5])]
    wide = [(i, t, f"{n}", n % 3, n, n, n, n, "k", n) for n, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(wide, "doc_id long, text string, _id string, _n int, _c int, _r int, id int, comp int, mark string, row int").repartition(7)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    kept = [tuple(r) for r in kept.collect()]
    assert set(kept) <= set(wide) and len(set(kept)) == len(kept)
    lone = [r for r in wide if r[0] is None or not (r[1] or "").split()]
    base = lambda r: r[1].split()[0]
    groups = {}
    for r in wide:
        if r not in lone:
            groups.setdefault(base(r), []).append(r)
    found = [r for r in kept if r not in lone]
    assert sorted(r for r in kept if r in lone) == sorted(lone) if all(r[0] is not None for r in lone) else len(kept) - len(found) == len(lone)
    assert sorted(map(base, found)) == sorted(groups)
    for r in found:
        assert r[0] == min(x[0] for x in groups[base(r)])


def test_keep_one_with_a_hot_id_of_equal_rows(spark):
    text = " ".join(f"h{i}" for i in range(30))
    rows = [(5, text)] * 3000 + [(6, text), (5, "another text that stays whole here")] + [(i, f"lone text number {i} with words") for i in range(100, 200)]
    kept = ngram_join.keep_one(frame(spark, rows)).collect()
    assert len(kept) == 102 and sum(r["doc_id"] == 5 for r in kept) == 2


def test_filter_is_filled_where_its_bits_lie():
    at = np.random.default_rng(1).integers(0, 1 << 20, 5_000)
    flags = np.zeros(1 << 20, np.uint8)
    flags[at] = 1
    packed = np.zeros(1 << 17, np.uint8)
    ngram_join.set_bits(packed, at)
    assert (packed == np.packbits(flags)).all()


def test_tasks_get_small_batches(spark):
    """Tasks of these operators hold several times a batch, so a batch is short."""
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(["a", "b", "c", "d"], k=30)), 1) for i in range(1_500)], "doc_id long, text string, at int")
    ngram_join.keep_one(docs).count()

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    assert docs.repartition(1).mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0] <= 512
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


def test_the_driver_runs_few_jobs(spark):
    """Every job costs the driver a block of heap and a thread, however small the table is."""
    texts = [" ".join(f"w{i // 3 * 40 + k}" for k in range(40)) + (f" x{i}" if i % 3 else "") for i in range(90)]
    spark.sparkContext.setJobGroup("few_jobs", "few_jobs")
    try:
        assert ngram_join.keep_one(frame(spark, list(enumerate(texts)))).count() == 30
    finally:
        spark.sparkContext.setJobGroup("after", "after")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few_jobs")) <= 45
