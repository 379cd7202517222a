"""Cheapest repair of conversations, reconstructed in linear space.

Between rows a conversation is in one of four states: nothing yet, after a system
turn, after a user turn, after an assistant turn. Hirschberg's division keeps only
the costs of those states: a forward vector from the start and a backward vector
from the end meet mid-way, the crossing is chosen, and both halves are solved by
themselves. Conversations are cut into blocks of bounded length; a block's costs
from each state to each state are found apart from the others, so a conversation of
any length is spread over tasks, and crossings between blocks are chosen in the
same way as those inside a block.

Audit letters: D delete, I insert, K keep, R change the role. From a given state a
letter leads to one state only, and strings that reach different states with the
same rows are never prefixes of each other. So a rank per state, without the
strings themselves, tells which crossing gives the least audit.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scan import null_safe_join, running
from ..session import written
from .common import arrow_map, prepare

START, SYSTEM, USER, ASSISTANT = range(4)
KEEP, TRUNCATED, MUST_GO = range(3)
DELETE_COST, INSERT_COST, ROLE_COST, TRUNCATED_COST = 2, 5, 1, 5
#: Rows of one conversation that one task works on.
BLOCK = 4_096
FAR = 1 << 40
SPACES = " \t\n\x0b\f\r"

#: State after the next user or assistant turn; the grammar leaves one choice.
_TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Inserts that close a conversation, by its state after the last row.
CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
_END = [INSERT_COST * len(CLOSING[s]) for s in range(4)]


def _after(state: int, kind: int) -> int | None:
    """The state after a turn of ``kind`` (a state number, or 0 for another role), if it may follow."""
    if kind == SYSTEM:
        return SYSTEM if state == START else None
    return kind if kind and _TURN[state] == kind else None


def _steps(kind: int, fault: int) -> list[list[tuple[int, int, str]]]:
    """For each state: reachable states over one row with its cost and least audit."""
    out = []
    for entry in range(4):
        best: dict[int, tuple[int, str]] = {}
        state = entry
        for inserts in range(3):
            spent, letters = INSERT_COST * inserts, "I" * inserts
            found = [(state, spent + DELETE_COST, letters + "D")]
            if fault != MUST_GO:
                spent += TRUNCATED_COST * (fault == TRUNCATED)
                found.append((_after(state, kind), spent, letters + "K"))
                found.append((_TURN[state], spent + ROLE_COST, letters + "R"))
            for to, cost, audit in found:
                if to is not None and (cost, audit) < best.get(to, (FAR, "")):
                    best[to] = (cost, audit)
            state = _TURN[state]
        out.append([(to, *best[to]) for to in sorted(best)])
    return out


#: By row code: kind of role + 4 x fault.
STEPS = [_steps(code % 4, code // 4) for code in range(12)]


def forward(codes: bytes, entry: int) -> tuple[list[int], list[int]]:
    """From ``entry``: least cost to each state after ``codes``, and the rank of the least audit among states."""
    cost, rank = [FAR] * 4, [0] * 4
    cost[entry] = 0
    for code in codes:
        best: list[tuple | None] = [None] * 4
        for state, steps in enumerate(STEPS[code]):
            if cost[state] < FAR:
                for to, price, audit in steps:
                    here = (cost[state] + price, rank[state], audit)
                    if best[to] is None or here < best[to]:
                        best[to] = here
        order = sorted(b[1:] for b in best if b)
        cost = [b[0] if b else FAR for b in best]
        rank = [order.index(b[1:]) if b else 0 for b in best]
    return cost, rank


def backward(codes: bytes, end: list[int]) -> list[int]:
    """Least cost from each state over ``codes`` to the end, given the costs after it."""
    for code in reversed(codes):
        end = [min(price + end[to] for to, price, _ in STEPS[code][state]) for state in range(4)]
    return end


def crossing(cost: list[int], rank: list[int], rest: list[int]) -> int:
    """Where the two vectors meet: the cheapest state, of equal ones that of the least audit."""
    return min(range(4), key=lambda s: (cost[s] + rest[s], rank[s]))


def reconstruct(codes: bytes, entry: int, leave: int) -> str:
    """The least of the cheapest audits over ``codes`` from one state to another."""
    if len(codes) == 1:
        return next(audit for to, _, audit in STEPS[codes[0]][entry] if to == leave)
    mid = len(codes) // 2
    rest = backward(codes[mid:], [0 if s == leave else FAR for s in range(4)])
    at = crossing(*forward(codes[:mid], entry), rest)
    return reconstruct(codes[:mid], entry, at) + reconstruct(codes[mid:], at, leave)


def audit(codes: bytes) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    if not codes:
        return 0, ""
    cost, rank = forward(codes, START)
    leave = crossing(cost, rank, _END)
    return cost[leave] + _END[leave], reconstruct(codes, START, leave) + CLOSING[leave]


def _breaks(a: int, b: int) -> bool:
    return (a % 4, b % 4) not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER))


# ------------------------------------------------------------------ rows


def turn_rows(turns: DataFrame) -> DataFrame:
    """The four columns of a turn; a null role or text counts as one space."""
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def damage(turns: DataFrame) -> DataFrame:
    """Turns damaged by a hash of conversation and turn, for a test of the repair: dropped, emptied,
    without sentence ends, repeated, or given the role user."""
    rows = turn_rows(turns)
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                    F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("_d", F.crc32(name.cast("binary")) % 20).filter("_d != 0")
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("_d") == 3, 2).otherwise(1).cast("int"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def _content() -> F.Column:
    return F.md5(F.concat(F.col("role").cast("binary"), F.lit("\n").cast("binary"), F.col("text").cast("binary")))


def judged(rows: DataFrame) -> DataFrame:
    """Per row its place in the conversation (``pos`` from 1), ``kind`` of role and ``fault``; no texts.

    Rows follow their turn (nulls first), then role and digest of role and text. A row is a
    duplicate if the same role and text come earlier, however far apart.
    """
    bare = F.btrim("text", F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(0)
    narrow = rows.select(
        "conv_id", "turn", "role", _content().alias("content"), kind.cast("int").alias("kind"), (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("open_end"),
        F.monotonically_increasing_id().alias("row"), F.lit(1).cast("long").alias("one"),
    )
    narrow = written(narrow, "turns")
    firsts = narrow.groupBy("conv_id", "content").agg(F.min(F.struct("turn", "row")).alias("first"))
    rows = null_safe_join(narrow, firsts, ["conv_id", "content"])
    fault = F.when(F.col("blank"), "blank").when(F.col("first.row") != F.col("row"), "duplicate").when(
        F.col("open_end"), "truncated").otherwise("none")
    rows = rows.select("conv_id", "turn", "role", "content", "row", "kind", fault.alias("fault"), "one")
    return running(rows, ["conv_id"], ["turn", "role", "content", "row"], sums={"pos": "one"})


def audits(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv_id, cost, illegal, audit`` of every conversation of ``judged`` rows."""
    bad = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", TRUNCATED).otherwise(KEEP)
    code = (F.col("kind") + 4 * bad).cast("int")
    blocks = rows.select("conv_id", F.expr(f"(pos - 1) div {block}").alias("block"), "pos", code.alias("code")).groupBy(
        "conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("rows"))
    blocks = blocks.select("conv_id", "block", F.transform("rows", lambda r: r["code"]).alias("codes"))

    def matrices(batches):
        for batch in batches:
            costs, ranks, illegal, packed = [], [], [], []
            for number, codes in zip(batch["block"].to_pylist(), batch["codes"].to_pylist()):
                codes = bytes(codes)
                # A conversation starts in one state, so its first block needs one row only.
                found = [forward(codes, s) if number or s == START else ([FAR] * 4, [0] * 4) for s in range(4)]
                costs.append([c for cost, _ in found for c in cost])
                ranks.append([r for _, rank in found for r in rank])
                illegal.append(sum(map(_breaks, codes, codes[1:])))
                packed.append(codes)
            yield {"conv_id": batch["conv_id"], "block": batch["block"], "codes": packed, "costs": costs, "ranks": ranks,
                   "illegal": illegal}

    table = written(arrow_map(blocks, "conv_id long, block long, codes binary, costs array<long>, ranks array<int>, illegal long",
                              matrices), "blocks")
    ends = F.struct("block", "costs", "ranks", "illegal", F.expr("conv(hex(substring(codes, 1, 1)), 16, 10)").cast("int").alias("first"),
                    F.expr("conv(hex(substring(codes, -1, 1)), 16, 10)").cast("int").alias("last"))
    chains = table.groupBy("conv_id").agg(F.sort_array(F.collect_list(ends)).alias("blocks"))

    def chain(batches):
        for batch in batches:
            out = []
            for blocks in batch["blocks"].to_pylist():
                rests = [_END]
                for b in reversed(blocks):
                    rests.append([min(b["costs"][4 * p + q] + rests[-1][q] for q in range(4)) for p in range(4)])
                rests.reverse()
                state, states = START, [START]
                for b, rest in zip(blocks, rests[1:]):
                    row = slice(4 * state, 4 * state + 4)
                    state = crossing(b["costs"][row], b["ranks"][row], rest)
                    states.append(state)
                illegal = sum(b["illegal"] for b in blocks) + sum(_breaks(a["last"], b["first"]) for a, b in zip(blocks, blocks[1:]))
                out.append((rests[0][START], illegal, CLOSING[state], states))
            cost, illegal, closing, states = list(zip(*out)) or [[]] * 4
            yield {"conv_id": batch["conv_id"], "cost": cost, "illegal": illegal, "closing": closing, "states": states}

    chains = written(arrow_map(chains, "conv_id long, cost long, illegal long, closing string, states array<int>", chain), "chains")
    ways = F.slice("states", F.lit(1), F.size("states") - 1)
    entries = chains.select("conv_id", "cost", "illegal", "closing", "states", F.posexplode(ways).alias("block", "entry")).select(
        "conv_id", "cost", "illegal", "closing", F.col("block").cast("long").alias("block"), "entry",
        F.element_at("states", F.col("block") + 2).alias("leave"))
    held = null_safe_join(table.select("conv_id", "block", "codes"), entries, ["conv_id", "block"], "inner")

    def rebuild(batches):
        known: dict[tuple, str] = {}  # short blocks recur
        for batch in batches:
            out = []
            for way in zip(*(batch[c].to_pylist() for c in ("codes", "entry", "leave"))):
                piece = known.get(way)
                if piece is None:
                    piece = reconstruct(*way)
                    if len(way[0]) <= 16 and len(known) < 50_000:
                        known[way] = piece
                out.append(piece)
            yield {**{c: batch[c] for c in ("conv_id", "block", "cost", "illegal", "closing")}, "piece": out}

    pieces = arrow_map(held, "conv_id long, block long, cost long, illegal long, closing string, piece string", rebuild)
    whole = F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("block", "piece"))), lambda p: p["piece"]))
    return pieces.groupBy("conv_id").agg(
        F.max("cost").alias("cost"), F.max("illegal").alias("illegal"), F.concat(whole, F.max("closing")).alias("audit"))


class Replay:
    """Applies an audit to the rows of one conversation as they come by."""

    def __init__(self, letters: str):
        self.letters, self.at, self.state = letters, 0, START

    def _turn(self) -> str:
        self.state = _TURN[self.state]
        return "user" if self.state == USER else "assistant"

    def inserts(self):
        while self.letters[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._turn(), ""

    def row(self, role: str, text: str):
        yield from self.inserts()
        letter, self.at = self.letters[self.at], self.at + 1
        if letter == "R":
            yield self._turn(), text
        elif letter == "K":
            self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            yield role, text


FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _in_order(rows: DataFrame, found: DataFrame) -> DataFrame:
    """A head row per conversation with its facts, then its rows in order, all in one task."""
    heads = found.select("conv_id", F.lit(0).alias("body"), *FACTS, "audit")
    body = rows.select("conv_id", F.lit(1).alias("body"), "turn", "role", "text", _content().alias("content"))
    both = heads.unionByName(body, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "body", "turn", "role", "content")


def _replayed(batches):
    """(head, its repaired turns) in order; one conversation's turns are read as they come, never held."""
    columns = ("conv_id", "body", *FACTS, "audit", "role", "text")
    head, replay = None, None
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in columns)):
            row = dict(zip(columns, row))
            if not row["body"]:
                if head is not None:
                    yield "turns", head, list(replay.inserts())
                    yield "end", head, []
                head, replay = row, Replay(row["audit"])
            else:
                yield "turns", head, list(replay.row(row["role"], row["text"]))
        yield "batch", None, []
    if head is not None:
        yield "turns", head, list(replay.inserts())
        yield "end", head, []
        yield "batch", None, []


def facts(turns: DataFrame, conversations: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Counts, cost and audit of each conversation of ``turns``, and of each id of ``conversations``."""
    rows = written(judged(turns), "judged")
    stats = rows.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    ids = (conversations if conversations is not None else rows).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = null_safe_join(null_safe_join(ids, stats, ["conv_id"]), audits(rows, block), ["conv_id"])
    return written(found.fillna(0, list(FACTS)).fillna("", ["audit"]).select("conv_id", *FACTS, "audit"), "audits")


def repair_digest(turns: DataFrame, conversations: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """Facts, audit and the digest of the repaired text of every conversation.

    ``conversations`` names further ids, which have zeros and an empty text if ``turns`` lacks them.
    Null roles and texts count as one space; a null turn comes first; rows of one turn are ordered by
    role and digest of their content, so equal rows are interchangeable; a null ``conv_id`` is a
    conversation like any other. Other columns are ignored; empty tables give no rows.
    """
    prepare(turns.sparkSession)
    rows = turn_rows(turns)

    def run(batches):
        out, digest, lines = [], hashlib.sha256(), 0
        for event, head, turns in _replayed(batches):
            for role, text in turns:
                digest.update((("\n" if lines else "") + f"{role}:{text}").encode())
                lines += 1
            if event == "end":
                out.append((head["conv_id"], *(head[f] for f in FACTS), head["audit"], digest.hexdigest()))
                digest, lines = hashlib.sha256(), 0
            elif event == "batch":
                yield dict(zip(("conv_id", *FACTS, "audit", "repaired_sha256"), list(zip(*out)) or [[]] * 9))
                out = []

    layout = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return arrow_map(_in_order(rows, facts(rows, conversations, block)), layout, run)


def repair(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """The repaired turns: ``conv_id, turn`` (from 0, without gaps), ``role, text``; see ``repair_digest`` for odd rows."""
    prepare(turns.sparkSession)
    rows = turn_rows(turns)

    def run(batches):
        out, turn = [], 0
        for event, head, turns in _replayed(batches):
            for role, text in turns:
                out.append((head["conv_id"], turn, role, text))
                turn += 1
            if event == "end":
                turn = 0
            elif event == "batch":
                yield dict(zip(("conv_id", "turn", "role", "text"), list(zip(*out)) or [[]] * 4))
                out = []

    return arrow_map(_in_order(rows, facts(rows, None, block)), "conv_id long, turn long, role string, text string", run)
