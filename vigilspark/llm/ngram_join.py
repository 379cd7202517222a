"""Similarity join on word n-grams with adaptive multi-match prefixes.

Documents that share a set of shingles form one class; the join runs on classes.
All shingles have one global order, rare ones first, from a counter array over
the whole corpus. If two sets overlap enough, the first |x| - t + l shingles of
each share at least l, for every l; t is the least overlap that x may have with
a partner. The smaller set of a pair must overlap even more, so in that role it
needs a shorter prefix. Each class picks its own l: where its prefix meets frequent shingles
a longer prefix that asks for more common shingles is cheaper than verifying
every candidate of a short one. A pair must share min(l_x, l_y) prefix shingles.

Candidates are not enumerated list by list. First every posting list only pairs
its members with one hub; verified links join classes into components, and only
lists that still hold several components are enumerated, across components. A
group of near copies thus costs a star, not all pairs, and no link between
different components is lost.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written
from .common import SMALL_BYTES, SMALL_ROWS, WordHashes, arrow_map, mix, prepare

WORDS = 5
PERCENT = 80
#: Counters of the frequency sketch: 8 MB, whatever the corpus; a power of two.
COUNTERS = 1 << 21
#: Bits of a membership filter at most (16 MB); beyond its load it lets more rows pass, never fewer.
FILTER_BITS = 1 << 27
#: Prefix extensions to choose from, and the cost of verifying a candidate in visited postings.
STEPS = (1, 2, 3, 4, 6, 8)
VERIFY_COST = 40.0
#: Members of a posting list that one task pairs with a hub; frequent shingles are split into blocks.
BLOCK = 4_096
FACTOR = np.uint64(0x9FB21C651E98DF25)  # any odd number


def shingle_set(text: str | None, words: WordHashes, size: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles of ``text``, A-Z lower-cased; a shorter text is one shingle."""
    hashes = words.hashes((text or "").encode().lower().split())
    n = len(hashes)
    if not n:
        return hashes
    span = min(n, size)
    with np.errstate(over="ignore"):
        total = hashes[: n - span + 1].copy()
        for k in range(1, span):
            total *= FACTOR
            total += hashes[k : n - span + 1 + k]
        total += np.uint64(size - span) * FACTOR
    return np.unique(mix(total))


def set_key(shingles: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def tree_merge(df: DataFrame, union: bool = False) -> np.ndarray | None:
    """Sum (or union) of the packed arrays in column ``v``, sixteen to one per level; the driver gets one array."""

    def merge(batches):
        total = None
        for batch in batches:
            for v in batch["v"]:
                part = np.frombuffer(zlib.decompress(v.as_py()), np.uint8 if union else np.uint32)
                if total is None:
                    total = part.copy()
                else:
                    np.bitwise_or(total, part, out=total) if union else np.add(total, part, out=total)
        if total is not None:
            yield {"v": [zlib.compress(total.tobytes(), 1)]}

    parts = df.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // 16)
        df = arrow_map(df.repartition(parts), "v binary", merge)
    rows = df.collect()
    if not rows:
        return None
    return np.frombuffer(zlib.decompress(rows[0]["v"]), np.uint8 if union else np.uint32)


def frequency_sketch(docs: DataFrame, size: int, counters: int = COUNTERS) -> np.ndarray:
    """How many documents hold a shingle, by the low bits of its hash; every document counts."""

    def count(batches):
        words, total = WordHashes(), np.zeros(counters, np.uint32)
        for batch in batches:
            for text in batch["text"].to_pylist():
                # One text at a time; nothing as long as the counters is made for a batch.
                np.add.at(total, (shingle_set(text, words, size) & np.uint64(counters - 1)).astype(np.intp), np.uint32(1))
        if total.any():
            yield {"v": [zlib.compress(total.tobytes(), 1)]}

    total = tree_merge(arrow_map(docs.select("text"), "v binary", count))
    return np.zeros(counters, np.uint32) if total is None else total


def choose_prefix(
    shingles: np.ndarray, sketch: np.ndarray, usual: float, percent: int
) -> tuple[np.ndarray, int, np.ndarray, int]:
    """Prefix in global order, the matches it asks for, each member's estimated frequency above the usual load,
    and how many of the set's shingles are no more frequent than usual."""
    n = len(shingles)
    counts = sketch[(shingles & np.uint64(len(sketch) - 1)).astype(np.int64)]
    order = np.lexsort((shingles, counts))
    least = -(-percent * n // 100)
    excess = np.maximum(counts[order].astype(float) - usual, 0.0)
    visits = np.cumsum(excess)
    best, match = None, 1
    for step in STEPS:
        if step > least:
            break
        visited = visits[n - least + step - 1]
        cost = visited + VERIFY_COST * visited / step + step
        if best is None or cost < best:
            best, match = cost, step
    end = n - least + match
    return shingles[order[:end]], match, excess[:end], int((excess == 0).sum())


SETS = "doc_id long, mark long, n long, key long, match int, rare int, prefix array<long>, blocks array<int>"


def prefixes(docs: DataFrame, shared: Broadcast, size: int, percent: int) -> DataFrame:
    """Class and prefix of every row, from the broadcast frequency sketch, which has a fixed size."""
    sketch = shared.value
    load = float(sketch.sum(dtype=np.int64)) / len(sketch)
    usual = load + 4 * load**0.5 + 1
    del sketch

    def run(batches):
        words = WordHashes()
        for batch in batches:
            rows = []
            for doc_id, mark, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "mark", "text"))):
                shingles = shingle_set(text, words, size)
                if not len(shingles):
                    rows.append((doc_id, mark, 0, None, 0, 0, [], []))
                    continue
                prefix, match, excess, rare = choose_prefix(shingles, shared.value, usual, percent)
                blocks = 1 + (excess / BLOCK).astype(np.int32)
                rows.append((doc_id, mark, len(shingles), set_key(shingles), match, rare, prefix.view(np.int64),
                             blocks if blocks.max() > 1 else []))
            yield dict(zip(("doc_id", "mark", "n", "key", "match", "rare", "prefix", "blocks"), list(zip(*rows)) or [[]] * 8))

    return arrow_map(docs, SETS, run)


def star_postings(classes: DataFrame, percent: int) -> DataFrame:
    """Postings of shingles that several classes share, each with the hub of its list or block.

    The hub is the class with the least share of rare shingles (then the least key):
    the text that near copies were made from has none of their changes.

    ``f`` packs a class's facts: set size, matches asked for, and whether the posting
    belongs to the shorter prefix that it has as the smaller set of a pair.
    """
    salt = F.when(F.size("blocks") > 0, F.pmod(F.xxhash64("key"), F.col("blocks")[F.col("i")])).otherwise(F.lit(0))
    split = F.when(F.size("blocks") > 0, F.col("blocks")[F.col("i")] > 1).otherwise(F.lit(False))
    # Overlap with a set of the same size: 2p / (100 + p) of it, rounded up.
    equal = F.expr(f"n - (({2 * percent} * n + {99 + percent}) div {100 + percent}) + match")
    facts = (F.col("n") * 16 + F.col("match")) * 2 + (F.col("i") < equal).cast("long")
    rank = F.floor(F.col("rare") * 255 / F.col("n"))
    postings = classes.select("key", "n", "match", "rare", "blocks", F.posexplode("prefix").alias("i", "h")).select(
        "h", salt.cast("int").alias("salt"), "key", "i", facts.cast("int").alias("f"), rank.cast("short").alias("r"), split.alias("wide")
    )
    postings = postings.repartition("h", "salt").sortWithinPartitions("h", "salt", "r", "key")

    def hubs(batches):
        last = None  # the list at hand: (h, salt), its hub, and whether the hub itself is out already
        hub, hub_f, hub_i, shown = 0, 0, 0, True
        for batch in batches:
            h, salt, key, f, i = (batch[c].to_numpy() for c in ("h", "salt", "key", "f", "i"))
            wide = batch["wide"].to_numpy(zero_copy_only=False)
            if not len(h):
                continue
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])
            fresh[0] = (h[0], salt[0]) != last
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(h)), -1))
            of, of_f = np.where(first < 0, hub, key[first]), np.where(first < 0, hub_f, f[first])
            # The first of a list counts once a second member follows.
            out = ~fresh | wide
            out[:-1] |= fresh[:-1] & ~fresh[1:]
            rows = {"h": h[out], "key": key[out], "i": i[out], "f": f[out], "hub": of[out], "hub_f": of_f[out], "wide": wide[out]}
            if not fresh[0] and not shown:
                held = {"h": h[0], "key": hub, "i": hub_i, "f": hub_f, "hub": hub, "hub_f": hub_f, "wide": False}
                rows = {k: np.append(v, held[k]) for k, v in rows.items()}
            start = np.flatnonzero(fresh)
            if len(start):
                at = start[-1]
                hub, hub_f, hub_i, shown = int(key[at]), int(f[at]), int(i[at]), bool(at < len(h) - 1 or wide[at])
            else:
                shown = True
            last = (h[-1], salt[-1])
            yield {k: v.astype(np.int32) if k in ("f", "hub_f", "i") else v for k, v in rows.items()}

    return arrow_map(postings, "h long, key long, i int, f int, hub long, hub_f int, wide boolean", hubs)


def set_bits(packed: np.ndarray, at: np.ndarray) -> None:
    """Set the bits numbered ``at``, the highest of a byte first, where they lie."""
    np.bitwise_or.at(packed, at >> 3, (128 >> (at & 7)).astype(np.uint8))


def membership(ids: DataFrame, number: int, column: str, docs: DataFrame) -> tuple[DataFrame, Broadcast]:
    """Rows of ``docs`` whose ``column`` may be in any column of ``ids``: a bit set of bounded size, only to spare a shuffle.

    ``ids`` holds ``number`` ids, one at least; repeated ones only make the bit set larger. It is
    returned as well; destroy it once the rows have been used.
    """
    bits = 1 << 12
    while bits < min(FILTER_BITS, 12 * number):
        bits *= 2

    def places(x: np.ndarray) -> np.ndarray:
        mixed = mix(x.astype(np.int64).view(np.uint64))
        return np.stack([mixed & np.uint64(bits - 1), (mixed >> np.uint64(32)) & np.uint64(bits - 1)]).astype(np.int64)

    def fill(batches):
        total = np.zeros(bits >> 3, np.uint8)
        for batch in batches:
            for some in batch.values():
                set_bits(total, places(some.to_numpy()).ravel())
        if total.any():
            yield {"v": [zlib.compress(total.tobytes(), 1)]}

    packed = tree_merge(arrow_map(ids, "v binary", fill), union=True)
    shared = docs.sparkSession.sparkContext.broadcast(packed)  # at most FILTER_BITS / 8 bytes

    @F.pandas_udf("boolean")
    def may_hold(x):
        import pandas as pd

        at = places(x.to_numpy())
        return pd.Series(((shared.value[at >> 3] >> (7 - (at & 7))) & 1).all(axis=0))

    return docs.filter(F.col(column).isNotNull()).filter(may_hold(F.col(column))), shared


def verify(pairs: DataFrame, number: int, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of the ``number`` stored pairs (a, b, of classes; a_rep, b_rep, a document of each) those whose whole texts link."""
    if not number:
        return pairs.select("a", "b")
    texts, shared = membership(pairs.select("a_rep", "b_rep"), 2 * number, "doc_id", docs)
    both = pairs.join(texts.select(F.col("doc_id").alias("b_rep"), F.col("text").alias("b_text")), "b_rep").join(
        texts.select(F.col("doc_id").alias("a_rep"), F.col("text").alias("a_text")), "a_rep"
    ).select("a", "b", "a_text", "b_text")

    def run(batches):
        words = WordHashes()
        kept_text, kept = None, shingle_set(None, words, size)
        for batch in batches:
            out = []
            for a, b, a_text, b_text in zip(*(batch[c].to_pylist() for c in ("a", "b", "a_text", "b_text"))):
                if a_text != kept_text:
                    kept_text, kept = a_text, shingle_set(a_text, words, size)
                other = shingle_set(b_text, words, size)
                # A repeated id may bring a row of another class along.
                if set_key(kept) != a or set_key(other) != b:
                    continue
                common = len(np.intersect1d(kept, other, assume_unique=True))
                if 100 * common >= percent * (len(kept) + len(other) - common):
                    out.append((a, b))
            a, b = list(zip(*out)) or [[], []]
            yield {"a": a, "b": b}

    links = written(arrow_map(both, "a long, b long", run).distinct(), "links")
    shared.destroy()
    return links


#: Links that one task joins by itself before the star rounds.
LOCAL_LINKS = 200_000


def components(links: DataFrame, most: int) -> DataFrame:
    """``key, comp`` for every linked class, stored; comp is the least key that links reach.

    Tasks first shrink their share of the links to a forest of stars; then large
    and small stars alternate until all edges lead to the least member. One share
    alone is complete at once. Each round reads the last one from the shared folder.
    Links are only counted if there may be ``most`` and that is more than one share.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v")
    shares = 1 if most <= LOCAL_LINKS else max(1, -(-edges.count() // LOCAL_LINKS))

    def shrink(batches):
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while root.setdefault(top, top) != top:
                top = root[top]
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        for batch in batches:
            for a, b in zip(batch["u"].to_pylist(), batch["v"].to_pylist()):
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        nodes = [x for x in root if find(x) != x or shares == 1]
        for at in range(0, len(nodes), 50_000):
            some = nodes[at : at + 50_000]
            yield {"u": some, "v": [find(x) for x in some]}

    edges, before = written(arrow_map(edges.repartition(shares), "u long, v long", shrink), "edges"), None
    if shares == 1:
        return edges.select(F.col("u").alias("key"), F.col("v").alias("comp"))
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.union(down).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return written(edges.select(F.col("u").alias("key"), F.col("v").alias("comp")).union(
        edges.select(F.col("v").alias("key"), F.col("v").alias("comp")).distinct()
    ), "components")


def linked_classes(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, counters: int = COUNTERS):
    """Set size and class of every row, and the component of every class that has a link."""
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(frequency_sketch(rows, size, counters))
    sets = written(prefixes(rows.withColumn("mark", F.xxhash64("text")), shared, size, percent), "sets")
    shared.destroy()
    classes = sets.filter("n > 0 and doc_id is not null").groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("match").alias("match"), F.first("rare").alias("rare"),
        F.first("prefix").alias("prefix"), F.first("blocks").alias("blocks"),
    )
    postings = written(star_postings(classes, percent), "postings")
    # Of a class: its least id, and the least mark among the rows of that id.
    first = sets.filter("n > 0 and doc_id is not null").groupBy("key").agg(F.min(F.struct("doc_id", "mark")).alias("r"))
    facts = written(first.select("key", F.col("r.doc_id").alias("rep"), F.col("r.mark").alias("mark")), "classes")
    n = {s: F.shiftright(F.col(f"{s}_f"), 5) for s in "ab"}
    asked = {s: F.shiftright(F.col(f"{s}_f"), 1).bitwiseAND(15) for s in "ab"}
    close = 100 * F.least(n["a"], n["b"]) >= percent * F.greatest(n["a"], n["b"])

    def candidates(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b with a_f, b_f) that meet in enough prefix shingles, with a document of each class."""
        counted = pairs.filter(close).groupBy("a", "b").agg(
            F.count("*").alias("met"), F.max("a_f").alias("a_f"), F.max("b_f").alias("b_f"))
        enough = counted.filter(F.col("met") >= F.least(asked["a"], asked["b"])).select("a", "b")
        for side in "ab":
            enough = enough.join(facts.select(F.col("key").alias(side), F.col("rep").alias(f"{side}_rep")), side)
        return enough

    def pair(left: str, left_f: str, right: str, right_f: str) -> list:
        """The two classes in order of their keys."""
        swap = F.col(left) > F.col(right)
        return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b"),
                F.when(swap, F.col(right_f)).otherwise(F.col(left_f)).alias("a_f"),
                F.when(swap, F.col(left_f)).otherwise(F.col(right_f)).alias("b_f")]

    star = postings.filter("hub != key").select(*pair("hub", "hub_f", "key", "f"))
    wide = postings.filter("wide").select("h", "hub", "hub_f").distinct()
    tops = wide.groupBy("h").agg(F.min(F.struct("hub", "hub_f")).alias("top"))
    tops = wide.join(tops, "h").select("hub", "hub_f", F.col("top.hub").alias("key"), F.col("top.hub_f").alias("f"))
    star = star.union(tops.filter("hub != key").select(*pair("hub", "hub_f", "key", "f")))
    checked = written(candidates(star), "stars")
    most = checked.count()
    links = verify(checked, most, rows, size, percent)

    # Lists that still hold several components, and what enumerating them would cost.
    for turn in range(3):
        comps = components(links, most)
        named = postings.select("h", "key", "i", "f").join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
        open_lists = _worth_enumerating(named, percent)
        smaller = F.col("f").bitwiseAND(1) == 1
        per = open_lists.groupBy("h").agg(F.count("*").cast("double").alias("m"), F.count_if(smaller).alias("s"))
        cost = per.agg(F.coalesce(F.sum(F.col("m") * F.col("s")), F.lit(0.0)).alias("pairs"), F.coalesce(F.sum("m"), F.lit(0.0)).alias("m")).first()
        if turn == 2 or cost["pairs"] <= 16 * cost["m"]:
            break
        # Another star, around another member of each list, joins more components first.
        order = F.xxhash64("key", F.lit(turn))
        centre = open_lists.groupBy("h").agg(F.min(F.struct(order.alias("o"), "key", "f", "comp")).alias("c"))
        star = open_lists.join(centre, "h").filter("comp != c.comp").select(
            "key", "f", F.col("c.key").alias("hub"), F.col("c.f").alias("hub_f"))
        fresh = written(candidates(star.select(*pair("hub", "hub_f", "key", "f"))).join(checked, ["a", "b"], "left_anti"), "stars")
        number = fresh.count()
        links = written(links.union(verify(fresh, number, rows, size, percent)), "links")
        checked, most = checked.union(fresh), most + number

    of_rows = sets.select("doc_id", "mark", "n", "key")
    if not cost["pairs"]:
        return of_rows, facts, comps  # no class may be the smaller one of a pair that is left

    lists = open_lists.groupBy("h").agg(F.count("*").alias("m"), F.min(F.shiftright("f", 1).bitwiseAND(15)).alias("low"))
    small = open_lists.filter(smaller).join(lists, "h")
    asks = F.shiftright("f", 1).bitwiseAND(15)
    # Of its t lists a class must share at least ``need`` with a partner, so one of any t - need + 1
    # lists finds the partner: the shortest ones are searched.
    of_key = W.partitionBy("key")
    ranked = small.withColumn("_t", F.count("*").over(of_key)).withColumn(
        "_need", F.least(F.max(asks).over(of_key), F.min("low").over(of_key))
    ).withColumn("_r", F.row_number().over(of_key.orderBy("m", "h")))
    searched = ranked.filter(F.col("_r") <= F.col("_t") - F.col("_need") + 1)
    x = searched.select("h", F.col("key").alias("a"), F.col("comp").alias("a_comp"), F.col("f").alias("a_f"), F.col("i").alias("a_i"))
    y = open_lists.select("h", F.col("key").alias("b"), F.col("comp").alias("b_comp"), F.col("f").alias("b_f"), F.col("i").alias("b_i"))
    ordered = (n["a"] < n["b"]) | ((n["a"] == n["b"]) & (F.col("a") < F.col("b")))
    # Both postings must lie in the prefixes that a pair of these two sizes needs.
    spare = F.least(asked["a"], asked["b"]) - _overlap(n["a"], n["b"], percent)
    inside = (F.col("a_i") < n["a"] + spare) & (F.col("b_i") < n["b"] + spare)
    across = x.join(y, "h").filter(ordered & close & inside & F.expr("a_comp != b_comp"))
    across = across.select("a", "b", F.least(asked["a"], asked["b"]).alias("need")).distinct()
    # A class's lists are no more than its prefix, so they travel as one array.
    as_smaller = open_lists.filter(smaller).groupBy(F.col("key").alias("a")).agg(F.collect_set("h").alias("a_h"))
    as_larger = open_lists.groupBy(F.col("key").alias("b")).agg(F.collect_set("h").alias("b_h"))
    met = across.join(as_smaller, "a").join(as_larger, "b").filter(F.size(F.array_intersect("a_h", "b_h")) >= F.col("need"))
    rest = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(checked, ["a", "b"], "left_anti")
    for side in "ab":
        rest = rest.join(facts.select(F.col("key").alias(side), F.col("rep").alias(f"{side}_rep")), side)
    rest = written(rest, "pairs")
    number = rest.count()
    if number:
        links = links.union(verify(rest, number, rows, size, percent))
        comps = components(links, most + number)
    return of_rows, facts, comps


def _overlap(m, n, percent: int):
    """Shingles that sets of sizes ``m`` and ``n`` must have in common to link, rounded up."""
    return F.ceil(percent * (m + n) / (100 + percent))


def _worth_enumerating(lists: DataFrame, percent: int, rounds: int = 2) -> DataFrame:
    """Postings without those that are in no candidate pair.

    A pair must meet min(l_x, l_y) times inside the prefixes of its two sizes. Per
    list the smallest set bounds how deep a larger one's prefix can be needed. What
    lies before a match without being shared bounds the overlap; and a class with
    fewer postings left than it and all it meets ask for goes.
    """
    asked, n = F.shiftright("f", 1).bitwiseAND(15), F.shiftright("f", 5)
    smaller = F.col("f").bitwiseAND(1) == 1
    for _ in range(rounds):
        per = lists.groupBy("h").agg(
            F.min(asked).alias("low"), F.min(F.when(smaller, n)).alias("least_n"), F.min("comp").alias("_a"), F.max("comp").alias("_b"),
        ).filter("_a != _b and least_n is not null").select("h", "low", "least_n")
        partner = F.greatest(F.col("least_n"), F.ceil(percent * n / 100))
        need = _overlap(partner, n, percent)
        held = lists.select("h", "key", "i", "f", "comp").join(per, "h").withColumn("_need", need)
        held = held.filter(smaller | (F.col("i") < n - F.col("_need") + asked))
        # A shingle before this one in the class's order that is in no open list is matched by
        # no partner that matches this one; too many of them leave too little to overlap.
        rank = F.row_number().over(W.partitionBy("key").orderBy("i")) - 1
        held = held.withColumn("_left", n - (F.col("i") - rank)).filter(F.col("_left") >= F.col("_need"))
        alike = smaller & (F.col("_left") >= _overlap(n, n, percent))
        held = written(held.withColumn("f", F.when(alike, F.col("f")).otherwise(F.col("f").bitwiseAND(F.lit(-2)))).drop("_need", "_left"), "open")
        short = held.groupBy("key").agg(
            F.least(F.max(asked), F.min("low")).alias("need"), F.count("*").alias("all"), F.count_if(smaller).alias("as_smaller"))
        kept = held.join(short, "key").filter("all >= need")
        # Below the need as the smaller set, the class stays in its lists as the larger one only.
        flag = F.when(F.col("as_smaller") >= F.col("need"), F.col("f")).otherwise(F.col("f").bitwiseAND(F.lit(-2)))
        lists = kept.select("h", "key", "i", flag.alias("f"), "comp")
    return written(lists, "open")


def join_documents(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, counters: int = COUNTERS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row.

    Null, empty and blank texts have an empty set and are linked with nothing;
    their component is their own id. A text of fewer than ``size`` words is one
    shingle. Rows with a null id take no part and have a null component; equal
    rows share a class. Other columns are ignored; an empty table gives no rows.
    """
    prepare(docs.sparkSession, SMALL_ROWS, SMALL_BYTES)
    sets, facts, comps = linked_classes(docs, size, percent, counters)
    of_class = written(_component_ids(facts, comps), "classes")
    lone = sets.filter("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    rest = sets.filter("n > 0 and doc_id is not null").join(of_class, "key")
    return rest.select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(lone)


def _component_ids(facts: DataFrame, comps: DataFrame) -> DataFrame:
    """``key, comp, component_id`` of every class."""
    named = facts.select("key", "rep").join(comps, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    return named.join(least, "comp").select("key", "comp", "component_id")


def keep_one(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component, with its own columns; rows without words or id all stay.

    Rows are judged one by one, also if ids repeat: of a component's rows the one of the least
    ``doc_id`` stays, among those the one of the least hash of its text, then of all its columns.
    Every component thus keeps exactly one row. Columns may have any names, also those used here.
    """
    prepare(docs.sparkSession, SMALL_ROWS, SMALL_BYTES)
    named = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").alias("words"))
    lone = F.col("id").isNull() | (F.btrim(F.coalesce("words", F.lit("")), F.lit(" \t\n\x0b\f\r")) == "")
    _, facts, comps = linked_classes(docs, size, percent)
    first = facts.join(comps, "key", "left").groupBy(F.coalesce("comp", "key").alias("comp")).agg(F.min(F.struct("rep", "mark")).alias("r"))
    heads = written(first.select("comp", F.col("r.rep").alias("id"), F.col("r.mark").alias("mark")), "heads")
    alike = named.filter(~lone).withColumn("mark", F.xxhash64("words")).join(heads, ["id", "mark"])
    # Rows of one id and text are folded where they lie before they move.
    kept = alike.groupBy("comp").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.select("row.*").unionAll(named.filter(lone).select("row.*"))
