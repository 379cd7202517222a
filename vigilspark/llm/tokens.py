"""Byte-level BPE ids of whole texts, read from a public vocabulary file."""

from __future__ import annotations

import json

import numpy as np

# The split pattern of this vocabulary family, a fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """Letter -> byte: printable bytes stand for themselves, the rest are numbered from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteEncoder:
    """Ids that the tokenizers library gives for ``path`` without added special tokens.

    The vocabulary's merge order equals its id order, so the same ids come from
    its ranks alone, which is several times faster than the library on words it
    has not cached. Strings of special tokens inside a text become their id, as
    the library does by default. Texts with runs too long for the encoder's split, such as
    a million blanks, are encoded by the library itself.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        letters = _byte_letters()
        ranks = {
            bytes(letters[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special
        }
        self.encoding = tiktoken.Encoding(
            "byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special
        )
        self.path, self.library = path, None

    def _library_ids(self, text: str) -> np.ndarray:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        try:
            return self.encoding.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            return self._library_ids(text)
