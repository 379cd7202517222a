"""Secret scan: places, verdicts and redaction."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from vigilspark.llm import secret_scan as ss
from vigilspark.llm.plans import QUERIES

from conftest import SF

KEY = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


@pytest.fixture(scope="module")
def forest(spark):
    return ss.fit_forest(ss.labelled_findings(spark))


def test_held_out_findings(spark, forest):
    later = ss.labelled_findings(spark, 9_000).exceptAll(ss.labelled_findings(spark))
    got = ss.judge(later, forest).agg(
        F.avg(F.when(F.col("label") == 1, F.col("confirmed").cast("double"))).alias("found"),
        F.avg(F.when(F.col("label") == 0, F.col("confirmed").cast("double"))).alias("false")).first()
    assert got.found > 0.95 and got.false < 0.06


def test_query_finds_every_planted_token_and_nothing_else(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op4_secret_scan"](spark, SF).collect()
    for r in rows:
        text = docs[r.doc_id][r.start : r.start + r.length]
        assert hashlib.sha256(text.encode()).hexdigest() == r.secret_sha256
    want = sorted((i, m.start(1)) for i, t in docs.items() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t or ""))
    assert sorted((r.doc_id, r.start) for r in rows if r.confirmed) == want


def test_places_match_a_plain_search(spark):
    texts = [f'password: hunter2secret! {KEY} x', f"é🙂 token='{KEY}' {KEY}", "no candidates", None, "", f"{KEY}", "\x01 " + KEY + "\x01",
             "a" * 200_000 + " " + KEY]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, start string")
    got = sorted((r.doc_id, r.start, r.candidate) for r in ss.find_candidates(docs).collect())
    assert all(texts[i][s : s + len(c)] == c for i, s, c in got)
    assert [(i, s) for i, s, _ in got] == [(0, 10), (0, 25), (1, 10), (1, 52), (5, 0), (6, 2), (7, 200_001)]


def test_redaction(spark):
    texts = [f'a token = "{KEY}" and commit {KEY} b', f"{KEY}", None, "", f'x token = "{KEY}"', f'x token = "{KEY}"', "plain\x01words"]
    rows = [(i if i != 4 else None, t, i, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid int, score string")
    out = ss.redact(docs)
    got = {r.uid: r.text for r in out.collect()}
    assert out.columns == docs.columns and len(got) == len(texts)
    assert got[0] == f'a token = "[SECRET]" and commit {KEY} b'
    assert got[4] == got[5] == 'x token = "[SECRET]"'
    assert [got[i] for i in (2, 3, 6)] == [None, "", "plain\x01words"]
    assert ss.redact(docs.limit(0)).count() == ss.scan(docs.limit(0)).count() == 0
    assert ss.scan(docs).filter("confirmed").count() == 3


def test_labels_decide(spark):
    mine = ss.labelled_findings(spark).withColumn("label", 1 - F.col("label"))
    docs = spark.createDataFrame([(1, f'a token = "{KEY}" b')], "doc_id long, text string")
    assert [r.confirmed for r in ss.scan(docs, mine).collect()] == [False]


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op4_secret_scan"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_values_of_unquoted_names(spark, forest):
    wanted = {f"TOKEN={KEY}": KEY, "DB_PASSWORD_PROD=wJalrXUtnFEMI7K7MDENGbPxRfiCY&3": "wJalrXUtnFEMI7K7MDENGbPxRfiCY&3",
              "AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG/bPxRfiCYz9Qk2LmT": "wJalrXUtnFEMI/K7MDENG/bPxRfiCYz9Qk2LmT",
              "PORT=8080\nGITHUB_TOKEN=ghp_x7Kq2mVb9TzRw4LpYc8NsJd3HfGa6Xe1\nLEVEL=debug\n": "ghp_x7Kq2mVb9TzRw4LpYc8NsJd3HfGa6Xe1",
              f"see /v1/api/token={KEY}": KEY, f"GIT_COMMIT={KEY}": None}
    docs = spark.createDataFrame(list(enumerate(wanted)), "doc_id long, text string")
    found = ss.judge(ss.find_candidates(docs), forest)
    assert {r.doc_id: r.candidate for r in found.filter("confirmed").collect()} == {
        i: v for i, v in enumerate(wanted.values()) if v}
    assert [r.text for r in ss.redact(docs).orderBy("doc_id").collect()] == [
        t.replace(v, "[SECRET]") if v else t for t, v in wanted.items()]


def test_padding_is_part_of_a_run_and_an_assignment_is_not(spark):
    texts = ["x dGhpcyBpcyBzb21lIHRleHQxMg== y", '"dGhpcyBpcyBzb21lIHRleHQxMg=="', "LONG_SETTING_NAME_2=short", f"BUILD={KEY}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r.doc_id, r.candidate) for r in ss.find_candidates(docs).collect()) == [
        (0, "dGhpcyBpcyBzb21lIHRleHQxMg=="), (1, "dGhpcyBpcyBzb21lIHRleHQxMg=="), (2, "LONG_SETTING_NAME_2"), (3, KEY)]


def test_every_form_of_assignment_is_found(spark, forest):
    secret = {'password     = "Tr0ub4dor&3"': "Tr0ub4dor&3", "password\t= Tr0ub4dor&3": "Tr0ub4dor&3", "password => 'Tr0ub4dor&3'": "Tr0ub4dor&3",
              'passphrase = "Tr0ub4dor&3"': "Tr0ub4dor&3", "access_key: Ab3dEf7hIj2": "Ab3dEf7hIj2", "DB_PASSWORD_PROD=Tr0ub4dor&3": "Tr0ub4dor&3",
              "postgres://app:Tr0ub4dor@db": "Tr0ub4dor", 'password := "Tr0(ub4;dor"': "Tr0(ub4;dor"}
    other = ["password = settings.DB_PASSWORD", 'password: "${DB_PASSWORD}"', "token: required", "author: Johnson-Smith"]
    docs = spark.createDataFrame(list(enumerate([*secret, *other])), "doc_id long, text string")
    found = ss.judge(ss.find_candidates(docs), forest).collect()
    assert {r.doc_id: r.candidate for r in found if r.doc_id < len(secret)} == dict(enumerate(secret.values()))
    assert sorted(r.doc_id for r in found if r.confirmed) == list(range(len(secret)))


def test_long_runs_of_names_end(spark):
    texts = ["token" * 40_000 + " x", "pass " * 40_000, "a." * 100_000 + "=", "://" * 60_000, " " * 200_000 + "token" + " " * 200_000]
    assert ss.find_candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == 0
