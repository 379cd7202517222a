"""Piece ids and decoded texts against the sentencepiece library."""

import hashlib
import random

import pytest

from vigilspark.llm import piece_codec
from vigilspark.llm.plans import QUERIES

from conftest import SF

LETTERS = ["a", "b", "e", "t", "h", "in", "er", "the", " ", "  ", "   ", "▁", "\n", "\t", "é", "ß", "中", "🙂", "\x00", "1",
           "00", ".", "..", "==", "----", "$", "ing", "on", "tion", "I", "'s", "(", ");", "http://", "</s>", "ﬁ"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_path())


@pytest.fixture(scope="module")
def codec():
    return piece_codec.PieceCodec(piece_codec.read_vocabulary(piece_codec.default_path()))


def test_random_texts(library, codec):
    rng = random.Random(5)
    for _ in range(8_000):
        some = rng.sample(LETTERS, rng.randint(1, len(LETTERS)))
        text = "".join(rng.choices(some, k=rng.randint(1, rng.choice([3, 10, 40]))))
        ids = library.encode(text)
        assert codec.encode(text) == ids
        assert codec.decode(ids) == library.decode(ids)
    for text in ["", " ", "x" * 50_000, " " * 1_000, "a\n" * 5_000]:
        assert codec.encode(text) == library.encode(text)


def test_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in QUERIES["op3_piece_codec"](spark, SF).collect()}
    for d in docs.collect():
        ids = library.encode(d.text)
        hashes = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        assert tuple(rows[d.doc_id]) == (d.doc_id, len(ids), *hashes)


def test_odd_rows(spark, library):
    rows = [(1, None, 0), (None, "a b", 0), (2, "", 1), (2, "", 1), (3, " Ünïcode 🙂\n", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    want = sorted((repr(i), library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t, _ in rows)
    got = piece_codec.encode_documents(docs)
    assert sorted((repr(r.doc_id), list(r.ids), r.decoded) for r in got.collect()) == want
    assert piece_codec.encode_documents(docs.limit(0)).count() == 0
    assert {r.n_tokens for r in piece_codec.digest_documents(docs).collect()} == {len(x) for _, x, _ in want}
