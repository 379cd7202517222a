"""SentencePiece BPE encoding and decoding with a table of last tokens.

For every prefix of a chunk the table stores the one token that its encoding
ends with. The candidates are the pieces that an automaton finds ending there;
a candidate is right when it may follow the last token of the prefix before it,
that is, when encoding the two pieces' joined text gives back the pair. The ids
then follow backwards from the chunk's end. No merge queue is needed and the
work is linear in the text.

A text is cut into chunks where no piece can reach across: in front of each run
of word marks, and between letters and those signs that share no piece with
them (both found from the vocabulary). Chunks are independent, so repeated ones
are looked up; a worker process keeps its table from task to task.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame

from .common import arrow_map, prepare

MARK = "▁"
#: Chunks kept by one worker process, and their length at most; the table starts anew beyond it.
CACHE, CACHED_LENGTH = 1_200_000, 48


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_vocabulary(path: str) -> dict:
    """Pieces, scores and, for each piece that can occur, the two pieces merged last.

    Bounded by the vocabulary; made once on the driver and sent with the tasks.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    plain = [i for i in range(len(pieces))
             if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ids = {pieces[i]: i for i in plain}
    scores = [model.get_score(i) for i in range(len(pieces))]
    for piece in ids:
        if MARK in piece.lstrip(MARK):
            raise ValueError(f"piece {piece!r} goes on past a word mark")
        if any(c not in ids for c in piece):
            raise ValueError(f"piece {piece!r} has a letter that is no piece")
    splits = {}
    for piece, i in ids.items():
        pair = _last_merge(piece, ids, scores)
        if pair is not None:
            splits[i] = pair
    bytes_ = {int(pieces[i][3:5], 16): i for i in range(len(pieces)) if model.is_byte(i)}
    if len(bytes_) != 256:
        raise ValueError("the vocabulary has no byte fallback")
    return {"pieces": pieces, "ids": ids, "scores": scores, "splits": splits, "bytes": bytes_,
            "signs": _separate_signs(ids)}


def _separate_signs(ids: dict) -> str:
    """Letters of the vocabulary that share pieces only with each other (and a mark before them)."""
    touching = {pair for piece in ids for pair in zip(piece, piece[1:]) if MARK not in pair}
    signs = {p for p in ids if len(p) == 1 and not p.isalpha() and p != MARK}
    while mixed := {a if a in signs else b for a, b in touching if (a in signs) != (b in signs)}:
        signs -= mixed
    return "".join(sorted(signs | {c for c in "\n\r\t" if c not in ids}))


def _last_merge(piece: str, ids: dict, scores: list) -> tuple[int, int] | None:
    """The last two parts when ``piece`` is merged step by step; None if it never becomes one token."""
    parts = list(piece)
    if len(parts) == 1:
        return (-1, -1)
    while len(parts) > 1:
        options = [(-scores[ids[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ids]
        if not options:
            return None
        _, i = min(options)
        if len(parts) == 2:
            return ids[parts[0]], ids[parts[1]]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return None


class PieceCodec:
    def __init__(self, vocabulary: dict):
        import ahocorasick

        self.pieces, self.scores = vocabulary["pieces"], vocabulary["scores"]
        self.ids, self.splits, self.bytes = vocabulary["ids"], vocabulary["splits"], vocabulary["bytes"]
        self.values = {i: b for b, i in self.bytes.items()}
        self.single = {p for p in self.ids if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for i in self.splits:
            self.automaton.add_word(self.pieces[i], (len(self.pieces[i]), i))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        signs = re.escape(vocabulary["signs"])
        self.cut = re.compile(f"{MARK}*(?:[^{MARK}{signs}]+|[{signs}]+)|{MARK}+$")
        self.strange = re.compile("[^" + re.escape("".join(sorted(self.single))) + "]")
        self.coded: dict[str, str] = {}
        self.plain: dict[str, str] = {}

    def fit(self, a: int, b: int) -> bool:
        """May token ``b`` follow token ``a``?

        Goes back in time from the two whole tokens: the one formed later is
        taken apart, and at each moment the pieces that touch must not have had
        a joining piece of higher priority than the merge that came next. Of
        equal priorities the leftmost merge is made first.
        """
        key = (a, b)
        known = self.pairs.get(key)
        if known is not None:
            return known
        pieces, ids, scores, splits = self.pieces, self.ids, self.scores, self.splits
        limit, strict, good = None, False, True
        while True:
            joined = ids.get(pieces[a] + pieces[b])
            if joined is not None:
                score = scores[joined]
                if limit is None or score > limit or (strict and score == limit):
                    good = False
                    break
            a_left, a_right = splits[a]
            b_left, b_right = splits[b]
            if a_left < 0 and b_left < 0:
                break
            if b_left >= 0 and (a_left < 0 or scores[b] <= scores[a]):
                limit, strict, b = scores[b], True, b_left
            else:
                limit, strict, a = scores[a], False, a_right
        if len(self.pairs) > 1_000_000:
            self.pairs.clear()
        self.pairs[key] = good
        return good

    def known_ids(self, text: str) -> list[int]:
        """Ids of a text whose letters are all pieces."""
        n = len(text)
        last = [-1] * n
        width = [0] * n
        fit, pairs = self.fit, self.pairs
        for end, (size, token) in self.automaton.iter(text):
            if last[end] >= 0:
                continue
            before = end - size
            if before >= 0:
                previous = last[before]
                good = pairs.get((previous, token))
                if good is None:
                    good = fit(previous, token)
                if not good:
                    continue
            last[end], width[end] = token, size
        out, end = [], n - 1
        while end >= 0:
            out.append(last[end])
            end -= width[end]
        out.reverse()
        return out

    def chunk_ids(self, text: str) -> list[int]:
        """Letters outside the vocabulary become their bytes; nothing merges across them."""
        out, at = [], 0
        for m in self.strange.finditer(text):
            if m.start() > at:
                out += self.known_ids(text[at : m.start()])
            out += [self.bytes[b] for b in m.group().encode()]
            at = m.end()
        if at < len(text):
            out += self.known_ids(text[at:] if at else text)
        return out

    def chunks(self, text: str) -> list[str]:
        return self.cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for chunk in self.chunks(text) for i in self.chunk_ids(chunk)]

    def decode(self, ids: list[int]) -> str:
        """Text of ``ids``: byte tokens in a row are one UTF-8 string, the first mark is dropped."""
        return self.marked(ids).removeprefix(MARK).replace(MARK, " ")

    def marked(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in ids:
            if i in self.values:
                run.append(self.values[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(self.pieces[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, digest of the ids, digest of the text decoded from them."""
        chunks = self.chunks(text)
        coded, plain = self.coded, self.plain
        if len(coded) > CACHE:
            coded.clear()
            plain.clear()
        once = []
        for chunk in chunks:
            if chunk not in coded:
                ids = self.chunk_ids(chunk)
                coded[chunk] = ",".join(map(str, ids))
                decoded = self.marked(ids)
                plain[chunk] = chunk if decoded == chunk else decoded
                if len(chunk) > CACHED_LENGTH:
                    once.append(chunk)
        ids = ",".join(map(coded.__getitem__, chunks))
        decoded = "".join(map(plain.__getitem__, chunks)).removeprefix(MARK).replace(MARK, " ")
        # Texts without blanks have chunks as long as a sentence or more, which seldom recur.
        for chunk in once:
            del coded[chunk], plain[chunk]
        return (ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(),
                hashlib.sha256(decoded.encode()).hexdigest())


class Shared:
    """A codec that travels as its vocabulary and is built once in each worker process."""

    def __init__(self, vocabulary: dict):
        self.vocabulary, self.built = vocabulary, None

    def __getstate__(self):
        return {"vocabulary": self.vocabulary, "built": None}

    def codec(self) -> PieceCodec:
        if self.built is None:
            self.built = PieceCodec(self.vocabulary)
        return self.built


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``ids`` and ``decoded`` for each row's whole text.

    Null text is an empty one (no ids, empty text). Null or repeated ids are kept
    row by row, other columns are ignored, an empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(Shared(read_vocabulary(model or default_path())))

    def run(batches):
        codec = shared.value.codec()
        for batch in batches:
            ids = [codec.encode(t or "") for t in batch["text"].to_pylist()]
            yield {"doc_id": batch["doc_id"], "ids": ids, "decoded": [codec.decode(x) for x in ids]}

    return arrow_map(docs.selectExpr("cast(doc_id as long) doc_id", "text"),
                     "doc_id long, ids array<int>, decoded string", run)


def digest_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """As ``encode_documents``, but only counts and SHA-256 digests leave the task."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(Shared(read_vocabulary(model or default_path())))

    def run(batches):
        codec = shared.value.codec()
        for batch in batches:
            found = [codec.digest(t or "") for t in batch["text"].to_pylist()]
            n, ids, decoded = list(zip(*found)) or [[]] * 3
            yield {"doc_id": batch["doc_id"], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded}

    return arrow_map(docs.selectExpr("cast(doc_id as long) doc_id", "text"),
                     "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", run)
