"""Documents drawn in proportion to how much they resemble a target, by hashed word features.

Features are words and pairs of adjacent words. A dictionary of the distinct words
at hand, each bounded by delimiters, carries a word's CRC and length; one scan of
an Aho-Corasick automaton over a text emits them in order, and the CRC of a pair
is composed from those of its two words, so no pair is ever built as a string.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import numbered
from ..session import written
from .common import arrow_map, prepare

BUCKETS = 10_000
#: Texts are scanned in pieces of this many bytes, cut at delimiters.
PIECE = 1 << 20
#: Words above this length have their CRC taken directly instead of filling the automaton.
LONG_WORD = 256
#: Bytes of words after which a task's dictionary starts anew.
DICTIONARY_BYTES = 4 << 20

_DELIMITER = b" "
_LETTERS_AND_DIGITS = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Lower-cases A-Z and turns every ASCII byte that is neither letter nor digit into the delimiter.
_PLAIN = bytes(b if b in _LETTERS_AND_DIGITS else 0x20 for b in range(256)).lower()
_LONG = re.compile(rb"([^ ]{%d,})" % (LONG_WORD + 1))


def _shift_tables() -> np.ndarray:
    """For each j, the effect of 2**j appended zero bytes on a CRC, one table per byte of it."""
    table = np.zeros(256, np.uint32)
    for b in range(256):
        c = b
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        table[b] = c
    entries = np.arange(256, dtype=np.uint32)
    one = np.stack([entries << np.uint32(8 * k) for k in range(4)])
    one = (one >> np.uint32(8)) ^ table[one & np.uint32(0xFF)]
    tables = [one]
    for _ in range(31):
        tables.append(_applied(tables[-1], tables[-1]))
    return np.stack(tables)


def _applied(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    byte = np.uint32(0xFF)
    return (table[0][crc & byte] ^ table[1][(crc >> np.uint32(8)) & byte]
            ^ table[2][(crc >> np.uint32(16)) & byte] ^ table[3][crc >> np.uint32(24)])


_SHIFTS = _shift_tables()


def compose(left: np.ndarray, right: np.ndarray, right_length: np.ndarray) -> np.ndarray:
    """CRC-32 of each pair of strings put together, from the CRCs of both and the length of the second."""
    out = left.astype(np.uint32)
    longest = int(right_length.max()) if len(right_length) else 0
    for j in range(longest.bit_length()):
        at = np.flatnonzero((right_length >> j) & 1)
        out[at] = _applied(_SHIFTS[j], out[at])
    return out ^ right


class WordDictionary:
    """An automaton over delimiter-bounded words whose payloads point to their CRC, CRC with a blank, and length."""

    def __init__(self, limit: int = DICTIONARY_BYTES):
        self.limit = limit
        self._empty()

    def _empty(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.words: set[bytes] = set()
        self.size = 0
        self.payloads = np.zeros((0, 3), np.int64)

    def learn(self, words: set[bytes]) -> None:
        """Make sure that ``words`` are known."""
        fresh = words - self.words
        if not fresh:
            return
        if self.size + sum(map(len, fresh)) > self.limit:
            self._empty()
            fresh = words
        known, rows = len(self.payloads), []
        for i, word in enumerate(sorted(fresh)):
            crc = zlib.crc32(word)
            rows.append((crc, zlib.crc32(_DELIMITER, crc), len(word)))
            self.automaton.add_word(f" {word.decode('latin-1')} ", known + i)
        self.automaton.make_automaton()
        self.words |= fresh
        self.size += sum(map(len, fresh))
        self.payloads = np.concatenate([self.payloads, np.array(rows, np.int64)])

    def scan(self, piece: bytes) -> np.ndarray:
        """The payloads of all words of ``piece``, in order."""
        if not self.words:
            return self.payloads
        # Every word between two delimiters is in the dictionary, so each match is a word.
        found = np.fromiter(map(itemgetter(1), self.automaton.iter(f" {piece.decode('latin-1')} ")), np.int64)
        return self.payloads[found]


def plain_pieces(text: bytes | None) -> list[bytes]:
    """The text in lower case with blanks for delimiters, cut at blanks into bounded pieces; overlong words apart."""
    plain, out, at = (text or b"").translate(_PLAIN), [], 0
    while at < len(plain):
        end = at + PIECE
        if end < len(plain):
            end = plain.find(_DELIMITER, end)
            end = len(plain) if end < 0 else end
        out += [p for p in _LONG.split(plain[at:end]) if p.strip()]
        at = end
    return out


def word_payloads(texts: list[bytes | None], dictionary: WordDictionary) -> Iterator[np.ndarray]:
    """For each text the CRC, CRC with a blank, and length of all its words."""
    cut = [plain_pieces(t) for t in texts]
    words: set[bytes] = set()
    for pieces in cut:
        for piece in pieces:
            if _LONG.fullmatch(piece) is None:
                words.update(piece.split())
    dictionary.learn(words)
    for pieces in cut:
        parts = []
        for piece in pieces:
            if _LONG.fullmatch(piece):
                crc = zlib.crc32(piece)
                parts.append(np.array([[crc, zlib.crc32(_DELIMITER, crc), len(piece)]], np.int64))
            else:
                parts.append(dictionary.scan(piece))
        yield np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)


def feature_buckets(words: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all words and of all pairs of adjacent words."""
    crc, blank, length = words[:, 0].astype(np.uint32), words[:, 1].astype(np.uint32), words[:, 2]
    pairs = compose(blank[:-1], crc[1:], length[1:])
    return (np.concatenate([crc, pairs]) % np.uint32(buckets)).astype(np.int64)


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def hashed(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Add ``features``: the buckets of ``text``'s features in order, as packed unsigned integers."""
    kind = _kind(buckets)

    @F.pandas_udf("binary")
    def hash_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dictionary = WordDictionary()
        for batch in batches:
            yield pd.Series([feature_buckets(words, buckets).astype(kind).tobytes()
                             for words in word_payloads(batch.tolist(), dictionary)], dtype=object)

    return texts.withColumn("features", hash_texts(F.col("text").cast("binary")))


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many ``features`` of all rows fall into each bucket; tasks send one sum per bucket."""
    kind = _kind(buckets)

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for packed in batch["features"].to_pylist():
                total += np.bincount(np.frombuffer(packed, kind), minlength=buckets)
        held = np.flatnonzero(total)
        yield {"bucket": held.astype(np.int32), "n": total[held]}

    parts = arrow_map(features.select("features"), "bucket int, n long", count)
    out = np.zeros(buckets, np.int64)
    # At most one row per bucket comes back, whatever the size of the corpus.
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the smoothed log ratio of target to source frequency, in thousandths, rounded down."""
    k, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float((int(t) + 1) * (s_all + k)) / float((int(s) + 1) * (t_all + k))))
                     for s, t in zip(source, target)], np.int64)


def scored(docs: DataFrame, target: DataFrame, seed: int = 7, buckets: int = BUCKETS, rows: bool = False) -> DataFrame:
    """``doc_id, n_features, weight, score`` of every row, and the row itself as ``doc`` if asked for.

    Texts are scanned once; counting and scoring both read the written buckets.
    """
    doc = [F.struct("*").alias("doc")] if rows else []
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *doc)
    table = written(hashed(named, buckets).drop("text"), "features")
    gain, kind = gains(bucket_counts(table, buckets), bucket_counts(hashed(target.select("text"), buckets), buckets)), _kind(buckets)

    @F.pandas_udf("long")
    def weigh(features: pd.Series) -> pd.Series:
        found = (gain[np.frombuffer(packed, kind)] for packed in features)
        return pd.Series([int(g.sum()) // len(g) if len(g) else 0 for g in found], dtype="int64")

    mark = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(mark.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    n = (F.octet_length("features") / np.dtype(kind).itemsize).cast("long")
    out = table.select("doc_id", n.alias("n_features"), weigh("features").alias("weight"), *(["doc"] if rows else []))
    return out.withColumn("score", F.col("weight") + noise.cast("long"))


def _ranked(table: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Add ``rank`` to a written table of scores: places of the drawn rows, null for the others."""
    able = F.col("n_features") >= 2 * least_words - 1 if least_words else F.lit(True)
    # The row number keeps equal rows apart, so that no range holds more than its share.
    placed = table.withColumn("_able", able.cast("int")).withColumn("_row", F.monotonically_increasing_id())
    drawn = percent * placed.filter("_able = 1").count() // 100
    placed = numbered(placed, ["-_able", "-score", "doc_id", "_row"], "_at")
    rank = F.when((F.col("_able") == 1) & (F.col("_at") < drawn), F.col("_at") + 1)
    return placed.withColumn("rank", rank.cast("long")).drop("_able", "_row", "_at")


def importance(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7,
               buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for every row of ``docs``.

    Of the rows with ``least_words`` words, ``percent`` % with the highest scores are drawn and
    ranked; ties go to the smaller ``doc_id``. A null or empty text has no features and weight 0;
    a null id is hashed as an empty string and comes first among ties. Repeated rows are drawn
    each for itself. Other columns are ignored; empty tables give no rows; an empty target or
    source only leaves the smoothing.
    """
    prepare(docs.sparkSession)
    return _ranked(written(scored(docs, target, seed, buckets), "scores"), percent, least_words).select(
        "doc_id", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7,
             buckets: int = BUCKETS) -> DataFrame:
    """The drawn rows of ``docs`` with their own columns, whatever those are called."""
    prepare(docs.sparkSession)
    table = scored(docs, target, seed, buckets, rows=True).withColumn("_key", F.monotonically_increasing_id())
    table = written(table, "scores")
    drawn = _ranked(table.drop("doc"), percent, least_words).filter("rank is not null").select("_key")
    return table.select("_key", "doc").join(drawn, "_key").select("doc.*")
