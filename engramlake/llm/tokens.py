"""Token ids by the tokenizers library, one white-space word at a time.

The vocabulary's rules never join characters across a space, so ids of a text are the ids of its words in turn. A word
is encoded by the library and remembered. Most words are letters with punctuation behind them, which the rules always
part: such letters, in lower case, and such punctuation are remembered by themselves, so that Word, word. and WORD, are
encoded once.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

#: Words, parts of words among them, that a worker remembers at most, and the longest word that it remembers.
WORDS, LONGEST = 700_000, 48
#: Letters that are composed, have one lower-case letter each and stand in the text's own encoding; then ASCII
#: punctuation, without what contractions and special tokens are made of.
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:;=?@\[-`{}~]*)")


@lru_cache(maxsize=1)
def _characters() -> dict[int, int]:
    """By byte: the character that stands for it in a byte-level vocabulary: itself where it prints, else from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in prints]
    return {b: 256 + k for k, b in enumerate(others)}


class WordIds(dict):
    """By word: its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    def __missing__(self, word: str) -> bytes:
        match = SIMPLE.fullmatch(word)
        if match is None:
            ids = self.packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        elif word in (low := match[1].lower(), match[2]):  # a part itself
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(_characters())
            ids = self.packed([t.id for t in self.model.tokenize(shown)]) if word else b""
        else:
            ids = self[low] + self[match[2]]
        if len(word) <= LONGEST:
            if len(self) >= WORDS:
                self.clear()
            self[word] = ids
        return ids

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").split(" "))) if text else b""


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One for each worker and vocabulary."""
    return WordIds(path)
