"""The pipeline's stages against their operators and brute force."""

import re
import zlib

import numpy as np
import pytest
from test_ngram_join import brute_force

import corpus_pipeline as cp
from vigilspark.llm import quality_classifier, quality_rules
from vigilspark.llm.tokens import ByteEncoder, default_path

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What goes into and comes out of each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = (docs, after)
        docs = after
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns_and_order(steps):
    assert [n for n, _ in cp.STAGES] == list(steps)
    for before, after in list(steps.values())[:-1]:
        assert after.dtypes == before.dtypes


def test_filters_follow_their_operators(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before, after = steps["quality_classifier"]
    assert ids(after) == ids(quality_classifier.classify(before, labels).filter("predicted = 1"))
    assert after.count() > 0.7 * before.count()
    # The rules judge as on the whole table, whatever the classifier has left of its labels.
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    before, after = steps["quality_rules"]
    assert ids(after) == ids(quality_rules.judge(whole, labels).filter("kept")) & ids(before)


def test_clean_documents_stay(spark, steps):
    good = ids(spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1"))
    before, after = steps["quality_classifier"][0], steps["quality_rules"][1]
    long_enough = {r.doc_id for r in before.collect() if len((r.text or "").split()) >= 50}
    assert len(good & long_enough & ids(after)) > 0.97 * len(good & long_enough)


def test_one_of_each_group(steps):
    before, after = steps["ngram_jaccard_join"]
    groups = brute_force([(r.doc_id, r.text) for r in before.collect()])
    assert ids(after) == {least for _, least in groups.values()}
    assert after.count() == len(ids(after))


def test_secrets_are_gone(steps):
    before, after = steps["secret_scan"]
    texts = {r.doc_id: r.text for r in after.collect()}
    for r in before.collect():
        assert texts[r.doc_id] == re.sub(r'(?i)(token = ")[0-9a-f]{40}"', r'\1[SECRET]"', r.text)
    assert {r.n_chars for r in after.collect()} == {len(t) for t in texts.values()}


def test_packing_holds_every_token(steps):
    before, after = steps["best_fit_packing"]
    encoder, pieces = ByteEncoder(default_path()), {}
    for r in after.collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for r in before.collect():
        whole = np.append(encoder.ids(r.text), np.uint32(0)).astype("<u4")
        own = sorted(pieces[r.doc_id], key=lambda p: p.piece)
        assert [p.ids_crc32 for p in own] == [zlib.crc32(whole[p.start : p.start + p.length].tobytes()) for p in own]
        assert sum(p.length for p in own) == len(whole)
    assert pieces.keys() == ids(before)


def test_run_gives_the_same_rows(spark, steps):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    want = steps["best_fit_packing"][1].select(*columns).collect()
    assert sorted(map(tuple, cp.run(spark, SF).select(*columns).collect())) == sorted(map(tuple, want))
