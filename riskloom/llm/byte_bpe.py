"""A byte-level BPE tokenizer read from its JSON file, and the bytes of its tokens."""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import tiktoken

# Fixed value: the published pattern that byte-level BPE tokenizers of this kind cut a text with before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _alphabet() -> dict[str, int]:
    """The byte behind each character of a token: printable Latin-1 characters stand for themselves, the other bytes follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Ids of texts, with the strings of special tokens either as such or as plain text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte_of = _alphabet()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.coder = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.size = max([*ranks.values(), *special.values()]) + 1
        self.bytes = [b""] * self.size
        for raw, i in ranks.items():
            self.bytes[i] = raw
        for name, i in special.items():
            self.bytes[i] = name.encode()

    def ids(self, text: str) -> np.ndarray:
        """Ids of ``text`` in which the string of a special token gives that token."""
        return self.coder.encode_to_numpy(text, allowed_special="all")

    def plain_ids(self, text: str) -> np.ndarray:
        """Ids of ``text`` as plain text throughout."""
        return self.coder.encode_to_numpy(text, disallowed_special=())


@cache
def load(path: str) -> ByteBpe:
    return ByteBpe(path)
