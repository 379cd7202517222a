"""Conversation repair against a search over all edit strings and a plain reading of the contract."""

import hashlib
import heapq
import random
import re
import zlib

from conftest import SF

from vigilspark.llm import turn_repair
from vigilspark.llm.plans import QUERIES


def cheapest(rows):
    """(cost, audit, repaired) by uniform-cost search ordered by cost and audit; rows are (role, text, fault)."""
    heap, done = [(0, "", 0, "", [])], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, out
        may = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        for name in ("user", "assistant"):
            if name[0] in may:
                heapq.heappush(heap, (cost + 5, audit + "I", i, name[0], out + [(name, "")]))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, out))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if role and role[0] in may:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], out + [(role, text)]))
                for name in ("user", "assistant"):
                    if name[0] in may:
                        heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, name[0], out + [(name, text)]))


def brute(rows):
    """The contract, read row by row; rows are (conv_id, turn, role, text)."""
    out = []
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            d = zlib.crc32(name.encode()) % 20
            if d:
                text = {1: "", 2: re.sub("[.!?]", "", text)}.get(d, text)
                kept += [(turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{r[1]}\n{r[2]}".encode()).hexdigest()))
        turns = {t for t, _, _ in kept if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        seen, faults = set(), []
        for _, role, text in kept:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else
                          "truncated" if solid[-1] not in ".!?" else "none")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audit, fixed = cheapest([(r, t, f) for (_, r, t), f in zip(kept, faults)])
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("conv_id", *turn_repair.FACTS, "audit", "repaired_sha256").collect()), key=repr)


def rows_of(df):
    return [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]


def test_whole_table(spark):
    out = QUERIES["op12_turn_repair"](spark, SF)
    assert got(out) == brute(rows_of(spark.read.parquet(f"{SF}/conversations.parquet")))


def test_audits_equal_search():
    rng = random.Random(3)
    faults = ["none", "none", "none", "truncated", "blank"]
    for _ in range(600):
        rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), "x", rng.choice(faults)) for _ in range(rng.randrange(14))]
        kinds = {"s": turn_repair.SYSTEM, "u": turn_repair.USER, "a": turn_repair.ASSISTANT}
        code = {"none": 0, "truncated": 4, "blank": 8}
        codes = bytes(kinds.get(r[:1], 0) + code[f] for r, _, f in rows)
        assert turn_repair.audit(codes) == cheapest(rows)[:2], rows


def random_rows(seed, conversations, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "half", " \t", "", None, "Why?", "é…"]
    return [(c, rng.choice([None, *range(most)]), rng.choice(["system", "user", "assistant", "tool", None, ""]), rng.choice(texts))
            for c in [None, *range(conversations)] for _ in range(rng.randrange(1, most))]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "z", 2) for r in rows],
                                 "conv_id long, turn long, role string, text string, row int, body string, block int")


def test_odd_rows_and_blocks(spark):
    rows = random_rows(5, 12, 40)
    turns = frame(spark, rows)
    want = brute(rows)
    for block in (3, turn_repair.BLOCK):
        assert got(turn_repair.repair_digest(turn_repair.damage(turns), turns, block)) == want


def test_one_hot_conversation(spark):
    rng = random.Random(6)
    rows = [(1, i // 2, rng.choice(["user", "assistant"]), rng.choice(["Same.", f"Text {i}.", f"open {i}"])) for i in range(3000)]
    rows += [(2, i, ["user", "assistant"][i % 2], f"t{i}.") for i in range(6)]
    turns = frame(spark, rows)
    assert got(turn_repair.repair_digest(turn_repair.damage(turns), turns, 64)) == brute(rows)


def test_repaired_turns_follow_the_grammar(spark):
    turns = frame(spark, random_rows(8, 10, 30))
    fixed = turn_repair.repair(turns)
    by_conv = {}
    for conv, turn, role, _ in sorted(rows_of(fixed), key=lambda r: (repr(r[0]), r[1])):
        by_conv.setdefault(conv, []).append((turn, role[0]))
    for turns in by_conv.values():
        assert [t for t, _ in turns] == list(range(len(turns)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r for _, r in turns))
    digest = turn_repair.repair_digest(fixed)
    assert all(r.cost == r.illegal == r.gaps == 0 for r in digest.collect() if set(r.audit) <= {"K"})


def test_dropped_and_empty(spark):
    gone = next(c for c in range(1000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in (0,)))
    turns = frame(spark, [(gone, 0, "user", "Hi.")])
    nothing = hashlib.sha256(b"").hexdigest()
    assert got(turn_repair.repair_digest(turn_repair.damage(turns), turns)) == [(gone, 0, 0, 0, 0, 0, 0, "", nothing)]
    assert got(turn_repair.repair_digest(turns.limit(0), turns.limit(0))) == []
