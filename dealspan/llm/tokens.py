"""Token ids of whole texts by a public tokenizer file."""

from __future__ import annotations

import json
import re
from functools import cache

import numpy as np
from tokenizers import Tokenizer

#: The text rules of a word BPE file for which ``TokenCoder`` may look words up.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PRETOKENIZERS = ["Split", "ByteLevel"]

_LETTER, _NUMBER = "a-zªµºß-öø-ÿĀ-ſ", "0-9²³¹¼½¾"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+")
#: Characters whose lower case, class and composition are the same in any version of Unicode.
_PLAIN = re.compile("[\t\n\r -~¡-¬®-įı-ſ]*")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Memo(dict):
    def __init__(self, make):
        super().__init__()
        self._make = make

    def __missing__(self, key):
        value = self[key] = self._make(key)
        return value


class TokenCoder:
    """Ids of texts as little-endian unsigned 32-bit integers, without special tokens added.

    In a file with the rules above no token reaches over a piece of the split, so the ids of a text are those
    of its pieces in turn, and a piece's ids are kept once known, for about ``most`` pieces. Other files, and
    texts with other characters or with a special token's own string, go through the tokenizer as a whole.
    """

    def __init__(self, path: str, most: int = 300_000) -> None:
        self._whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self._special = [t["content"] for t in rules.get("added_tokens") or []]
        kinds = lambda part, of: [x.get("type") for x in (rules.get(part) or {}).get(of, [])]
        before = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self._by_word = (
            kinds("normalizer", "normalizers") == NORMALIZERS
            and kinds("pre_tokenizer", "pretokenizers") == PRETOKENIZERS
            and before[0].get("pattern", {}).get("Regex") == SPLIT
        )
        self._letters = _byte_letters()
        self._most = most
        self._pieces = _Memo(self._piece)

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self._letters)
        return np.array([t.id for t in self._whole.model.tokenize(shown)], "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not self._by_word or not _PLAIN.fullmatch(text) or any(s in text for s in self._special):
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self._pieces) > self._most:
            self._pieces.clear()
        return b"".join(map(self._pieces.__getitem__, _PIECES.findall(text.lower())))


@cache
def coder(path: str) -> TokenCoder:
    """One coder per file and Python process."""
    return TokenCoder(path)
