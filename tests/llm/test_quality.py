"""Quality rules and classifier against brute force and held-out labels."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from vigilspark.llm import quality_classifier as qc
from vigilspark.llm import quality_rules as qr
from vigilspark.llm.plans import QUERIES

from conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF_LABELS = "/root/testdata/sf0.01"  # the smallest size with enough labels to judge a model


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) for k in range(3) if windows[tuple(words[i : i + 3])] > 1}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def odd(spark):
    texts = [None, "", " \n\t", "a b c a b c a b c", "é\x1cx  y 中文|#", "x\n\nx\r\nx\n", "w " * 30_000, "same", "same"]
    rows = [(i if i != 2 else None, t, 0.5, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, score double, kept string")


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def auc(pairs):
    good, bad = ([s for s, q in pairs if q == k] for k in (1, 0))
    return np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])


def test_statistics(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd(spark), allowMissingColumns=True)
    want = Counter((d.doc_id, *counts(d.text)) for d in docs.collect())
    got = qr.document_statistics(docs).select("doc_id", *qr.COUNTS)
    assert Counter(map(tuple, got.collect())) == want


def test_rules_query(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_LABELS}/labels.parquet").collect()}
    rows = QUERIES["op1_quality_rules"](spark, SF_LABELS).collect()
    assert len(rows) == spark.read.parquet(f"{SF_LABELS}/documents.parquet").count()
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    judged = [(r.score, labels[r.doc_id]) for r in rows if held_out(r.doc_id) and r.doc_id in labels and not r.base_failed]
    assert auc(judged) > 0.97
    assert np.mean([(s >= 0.5) for s, q in judged if q == 1]) > 0.97


def test_trees_keep_their_directions():
    rng = np.random.default_rng(3)
    x = rng.random((3_000, 3))
    y = (np.sin(9 * x[:, 0]) + 2 * x[:, 1] - x[:, 2] + rng.normal(0, 0.3, 3_000) > 0.6).astype(float)
    model = qr.BoostedTrees(constraints=(0, 1, -1)).fit(x, y)
    base = rng.random((200, 3))
    grid = np.linspace(0, 1, 40)
    for j, sign in ((1, 1), (2, -1)):
        walks = np.stack([model.score(np.where(np.arange(3) == j, g, base)) for g in grid])
        assert (sign * np.diff(walks, axis=0) >= -1e-12).all()
    free = np.stack([model.score(np.where(np.arange(3) == 0, g, base)) for g in grid])
    assert (np.diff(free, axis=0) < -1e-6).any() and (np.diff(free, axis=0) > 1e-6).any()
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.85


def one_by_one(model, row):
    total = model.base
    for t in range(model.trees):
        node = 0
        for _ in range(model.depth):
            node = 2 * node + 1 + int(row[model.feature[t, node]] > model.threshold[t, node])
        total += model.rate * model.value[t, node]
    return 1 / (1 + np.exp(-total))


def test_vectorised_scoring_walks_each_tree():
    rng = np.random.default_rng(4)
    x = rng.random((300, 4))
    model = qr.BoostedTrees(trees=9).fit(x, (x[:, 0] > x[:, 1]).astype(float))
    assert np.allclose(model.score(x[:50]), [one_by_one(model, row) for row in x[:50]])


def test_classifier_query(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_LABELS}/labels.parquet").collect()}
    rows = QUERIES["op7_quality_classifier"](spark, SF_LABELS).collect()
    assert len(rows) == spark.read.parquet(f"{SF_LABELS}/documents.parquet").count()
    for r in rows:
        assert r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    assert auc([(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]) > 0.95


def test_gradients_by_differences():
    rng = np.random.default_rng(5)
    x, number, y = rng.random((9, qc.WIDTH)), np.array([2, 1, 4, 2]), np.array([1.0, 0, 1, 0])
    model = qc.GatedAttention(5, 4)
    model.p = {k: v.astype(float) for k, v in model.p.items()}
    loss = lambda: -np.mean(np.log(np.where(y == 1, f := model.forward(x, number)["y"], 1 - f)))
    for key, d in model.gradients(x, number, y).items():
        at = tuple(rng.integers(0, s) for s in model.p[key].shape)
        before = model.p[key][at]
        model.p[key][at] = before + 1e-5
        up = loss()
        model.p[key][at] = before - 1e-5
        assert abs((up - loss()) / 2e-5 - d[at]) < 1e-6
        model.p[key][at] = before


def test_held_out_labels_are_not_learned(spark):
    docs, labels = (spark.read.parquet(f"{SF_LABELS}/{t}.parquet") for t in ("documents", "labels"))
    twisted = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - quality, quality) quality")
    a, b = qc.fit_classifier(docs, labels, rounds=2), qc.fit_classifier(docs, twisted, rounds=2)
    assert all((a.p[k] == b.p[k]).all() for k in a.p)


@pytest.mark.parametrize("fit", ["labels", "none"])
def test_odd_rows(spark, fit):
    docs = odd(spark)
    labels = spark.createDataFrame(
        [(0, 0), (1, 0), (3, 1), (None, 1), (4, None), (6, 0), (7, 1), (7, 0)] if fit == "labels" else [], "doc_id long, quality int")
    rules, scores = qr.judge(docs, labels), qc.classify(docs, labels)
    assert rules.count() == scores.count() == docs.count()
    assert not [r for r in rules.collect() if r.kept and r.n_words < 50]
    assert all(0 <= r.score <= 1 for r in scores.collect())
    assert qr.judge(docs.limit(0), labels).count() == qc.classify(docs.limit(0), labels).count() == 0
    assert qr.keep(docs, labels).columns == qc.keep(docs, labels).columns == docs.columns
    assert qr.keep(docs, labels).count() == rules.filter("kept").count()


def test_every_passage_of_a_sampled_text_counts(spark):
    """Texts differ only in one passage, far behind 64 others."""
    plain, odd_one = "the same plain words " * 25, "XX99 YY88 ZZ77 QQ66 " * 25
    rows = [(i, plain * 70 + (odd_one if i % 2 else plain) + plain * 20, i % 2) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1 - r[2]) for r in rows], "doc_id long, quality int")
    found = qc.classify(docs, labels).collect()
    assert auc([(r.score, 1 - r.doc_id % 2) for r in found]) > 0.99


def test_blocks_of_passages():
    number = np.array([3, 4, 1, 90, 2, 2])
    assert [b.tolist() for b in qc._blocks(number, 8)] == [[0, 1, 2], [3], [4, 5]]
    assert list(qc._blocks(np.zeros(0, int), 8)) == []


def test_rules_of_a_filtered_table_learn_from_the_whole(spark):
    """All documents of label 0 are gone; the rules still judge as they do on the whole table."""
    docs, labels = (spark.read.parquet(f"{SF_LABELS}/{t}.parquet") for t in ("documents", "labels"))
    good = docs.join(labels.filter("quality = 1"), "doc_id", "left_semi")
    whole = {r.doc_id for r in qr.keep(docs, labels).select("doc_id").collect()}
    left = {r.doc_id for r in qr.keep(good, labels, fit_on=docs).select("doc_id").collect()}
    assert left == whole & {r.doc_id for r in good.collect()}
    with pytest.warns(UserWarning, match="only the base rules"):
        qr.keep(good, labels)
