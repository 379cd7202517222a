"""Document fingerprints by one-permutation MinHash, in Spark's own functions only.

Each shingle is hashed once; the top bits choose a bin and every bin keeps its
least hash. A bin that no shingle fell into takes the value of another one, chosen
by its own sequence of hashed tries (optimal densification), so that equal bins
still mean common shingles. Only the low bits of each value are kept, packed into
long integers; chance agreement of those bits is taken out of the likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import running
from ..session import written
from .common import prepare

WORDS = 5
#: 2**8 bins, 4 bits kept of each.
BIN_BITS, BITS = 8, 4
BINS = 1 << BIN_BITS
PER_LONG = 64 // BITS
LOW = (1 << BITS) - 1
#: The lowest bit of every packed value.
ONES = sum(1 << (BITS * i) for i in range(PER_LONG))
BLANKS = " \t\n\x0b\f\r"

#: Tries of an empty bin before all full bins are ranked for it.
TRIES = 10
#: A prime above the number of bins, and multipliers and offsets of the tries below it.
PRIME = 65_537
FACTORS = [(40_503 * t % PRIME or 1, 30_011 * t * t % PRIME) for t in range(1, TRIES + 1)]

_SHIFT = 64 - BIN_BITS
#: The greatest hash of each bin stands for "no shingle".
_REST = (1 << _SHIFT) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _long(x: int) -> Column:
    return F.lit(_signed(x)).cast("long")


def shingle_hashes(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the hashes of the word shingles of ``text``; fewer words are one shingle, no words none."""
    bare = F.btrim(F.lower(text), F.lit(BLANKS))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    df = df.withColumn("_hashes", F.transform(words, lambda w: F.xxhash64(w)))
    n = F.size("_hashes")
    each = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*[F.get("_hashes", i + j) for j in range(WORDS)]))
    found = F.when(n >= WORDS, each).when(n > 0, F.array(F.xxhash64("_hashes"))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, found).drop("_hashes")


def _tried(values: str, full: str, i: Column) -> Column:
    """The value for bin ``i``: its own, else that of its first full try, else of the full bin ranked first for it."""
    tries = [F.get(values, (F.lit(a) * (i + 1) + F.lit(b)) % PRIME % BINS) for a, b in FACTORS]
    rank = F.array_min(F.transform(full, lambda j: F.xxhash64(i, j).bitwiseAND(F.lit(-BINS)).bitwiseOR(j.cast("long"))))
    return F.coalesce(F.get(values, i), *tries, F.get(values, rank.bitwiseAND(F.lit(BINS - 1)).cast("int")))


def fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the packed fingerprint of ``text`` as an array of long integers; null where it has no words."""
    df = shingle_hashes(df, text, "_shingles")
    ends = F.transform(F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1)),
                       lambda b: F.shiftleft(b.cast("long"), _SHIFT).bitwiseOR(_long(_REST)))
    df = df.withColumn("_sorted", F.sort_array(F.concat("_shingles", ends))).drop("_shingles")
    # In sorted order a bin starts where the top bits change, so this leaves one value per bin.
    least = F.filter("_sorted", lambda x, i: (i == 0) | (F.shiftright(x, _SHIFT) != F.shiftright(F.get("_sorted", i - 1), _SHIFT)))
    values = F.transform(least, lambda x: F.when(x.bitwiseAND(_long(_REST)) != _long(_REST), x.bitwiseAND(_long(LOW))))
    df = df.withColumn("_values", values).drop("_sorted")
    every = F.sequence(F.lit(0), F.lit(BINS - 1))
    # A column that the next step names once would be computed anew for every bin inside its
    # lambda; this one is named twice, so it is computed once per row.
    df = df.withColumn("_full", F.filter(every, lambda i: F.get("_values", i).isNotNull()))
    packed = F.transform(
        F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1)),
        lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(PER_LONG - 1)), _long(0),
                              lambda acc, t: F.shiftleft(acc, BITS).bitwiseOR(_tried("_values", "_full", w * PER_LONG + t))))
    return df.withColumn(out, F.when(F.size("_full") > 0, packed)).drop("_values", "_full")


def as_text(packed: Column) -> Column:
    """A fingerprint as hexadecimal digits, one per bin; an empty string for a text without words."""
    digits = F.transform(packed, lambda w: F.lower(F.lpad(F.hex(w), PER_LONG * BITS // 4, "0")))
    return F.coalesce(F.array_join(digits, ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles: the share of equal bins without that of chance.

    Two texts without words are alike, one of them is unlike any text with words.
    """

    def differing(x: Column) -> Column:
        shift = 1
        while shift < BITS:
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
            shift *= 2
        return F.bit_count(x.bitwiseAND(_long(ONES)))

    unequal = F.aggregate(F.zip_with(a, b, lambda x, y: differing(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n)
    chance = 2.0**-BITS
    share = ((1.0 - unequal / BINS) - chance) / (1.0 - chance)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(
        F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))


def following(keyed: DataFrame) -> DataFrame:
    """``key, prev_key, prev_half`` of every distinct document, in a circle by ascending id, then key."""
    ids = written(keyed.groupBy("doc_id", "key").agg(F.max(F.expr("length(text) div 2")).alias("half")), "ids")
    last = ids.agg(F.max_by(F.struct("key", "half"), F.struct("doc_id", "key")).alias("last")).first()["last"]
    before = running(ids, [], ["doc_id", "key"], lags={"prev_key": "key", "prev_half": "half"})
    end = (last["key"], last["half"]) if last else (None, None)
    return before.select(
        "key", F.coalesce("prev_key", F.lit(end[0])).alias("prev_key"),
        F.coalesce("prev_half", F.lit(end[1]).cast("long")).cast("int").alias("prev_half"))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and the likeness of both and of the next document.

    The edited text has the last half of the code points replaced by the first as many of the
    next document: that of the next larger id, after the last the first. Documents of one id
    with different texts follow by digest; rows equal in id and text are one document with one
    successor, and each has its own row in the result. A null text is empty; a null id comes
    first. Texts without words have an empty fingerprint. Other columns are ignored, whatever
    their names; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    mark = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), F.lit(":"), F.col("text"))
    keyed = named.withColumn("key", F.md5(mark.cast("binary")))
    links = written(following(keyed), "links")
    # Each document sends the previous one as much of its beginning as that one needs. Both joins
    # take the same columns of ``keyed``, so its texts are shuffled once.
    heads = keyed.join(links, "key").groupBy("key").agg(
        F.first("prev_key").alias("prev_key"), F.first("doc_id").alias("next_id"),
        F.first(F.expr("substring(text, 1, prev_half)")).alias("head"))
    heads = heads.select(F.col("prev_key").alias("key"), F.col("key").alias("next_key"), "next_id", "head")
    n = F.length("text")
    both = keyed.join(heads, "key").select(
        "doc_id", "key", "next_key", "next_id", "text", n.cast("long").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), n - F.expr("length(text) div 2").cast("int")), "head").alias("edited"))
    both = both.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    both = fingerprint(fingerprint(both, "text", "packed"), "edited", "edited_packed")
    found = written(both.select("doc_id", "key", "next_key", "next_id", "n_chars", "edited_sha256", "packed", "edited_packed"), "fingerprints")
    others = found.groupBy(F.col("key").alias("next_key")).agg(F.first("packed").alias("next_packed"))
    own, edited, after = F.col("packed"), F.col("edited_packed"), F.col("next_packed")
    return found.join(others, "next_key").select(
        "doc_id", "n_chars", "edited_sha256", as_text(own).alias("fingerprint"), as_text(edited).alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"), likeness(own, after).alias("near_next"), "next_id")
