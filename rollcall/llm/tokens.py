"""Token ids of whole texts by a public tokenizer, inside tasks.

A tokenizer of the kinds used here cuts a text at white space before anything else, so a
word between two single spaces has the same ids wherever it stands.  Each worker keeps the
ids of words it has met (up to a bound) and asks the library only for new words.  A text
where a word does not stand between plain single separators goes to the library whole.
A new word of Latin letters goes straight to the library's model, which is what is left of
the tokenizer for it; a run of ASCII marks after letters is a piece of its own, whose ids are
kept as well.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from array import array
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Words in each of a cache's two generations.
CACHED_WORDS = 280_000
LONGEST_CACHED = 48
# First and last character of a word: visible ASCII, letters and digits of any script.
PLAIN = re.compile(r"[!-~\w](?:.*[!-~\w])?", re.DOTALL)
# Marks that end a word's letters; an apostrophe may begin a piece with letters after it.
MARKS = "".join(chr(k) for k in range(0x21, 0x7F) if not chr(k).isalnum() and chr(k) != "'")
CACHED_MARKS = 4096
# Letters up to this one are Latin: a run of them is one piece whatever the tokenizer's pattern.
LAST_LETTER = "ɏ"


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level models use for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


BYTE_LETTERS = byte_letters()


class _Odd(Exception):
    """The text has a word that cannot be encoded on its own."""


class _Words(dict):
    """Ids of words that follow ``before``, in two generations of bounded size."""

    def __init__(self, encode, before: str):
        super().__init__()
        self.encode, self.before = encode, before
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word, self)
        if len(word) <= LONGEST_CACHED:
            if len(self) >= CACHED_WORDS:  # words in use move on from the older generation
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class TextEncoder:
    """Ids of a text as the bytes of little-endian numbers of ``dtype``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.dtype = np.dtype("<u4" if wide else "<u2")
        self.kind = "I" if wide else "H"
        self.newline = self._library("\n")
        self.marks: dict[str, bytes] = {}
        # Tokenizers with a normalizer here lower the case and drop white space.
        self.lowers = self.tokenizer.normalizer is not None
        self.model = self.tokenizer.model
        self.space = "" if self.lowers else " ".translate(BYTE_LETTERS)
        self.later = _Words(self._word, " ")
        self.first = self.later if self.lowers else _Words(self._word, "")

    def _library(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _bytes(self, ids: list[int]) -> bytes:
        data = array(self.kind, ids)
        if sys.byteorder == "big":
            data.byteswap()
        return data.tobytes()

    def _all_letters(self, word: str) -> bool:
        """Whether the tokenizer sees letters alone: where it lowers and normalizes a word, a
        capital or a composed letter may come apart into a letter and a mark."""
        return not self.lowers or word.isascii() or unicodedata.normalize("NFC", word.lower()).isalpha()

    def _word(self, word: str, known: _Words) -> bytes:
        if word.isalpha() and (word.isascii() or max(word) <= LAST_LETTER and self._all_letters(word)):
            letters = word.lower() if self.lowers else word
            piece = letters if word.isascii() else letters.encode().decode("latin-1").translate(BYTE_LETTERS)
            if known.before:
                piece = self.space + piece
            return self._bytes([t.id for t in self.model.tokenize(piece)])
        letters = word.rstrip(MARKS)
        if letters.isalpha() and len(letters) < len(word) and self._all_letters(letters):
            return known[letters] + self._marks(word[len(letters) :])
        if not PLAIN.fullmatch(word):
            raise _Odd
        return self._library(known.before + word)

    def _marks(self, run: str) -> bytes:
        ids = self.marks.get(run)
        if ids is None:
            ids = self._library(run)
            if len(self.marks) < CACHED_MARKS and len(run) <= LONGEST_CACHED:
                self.marks[run] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """A null text counts as empty and has no ids."""
        if not text:
            return b""
        first, later = self.first, self.later
        try:
            lines = []
            for line in text.split("\n"):
                head, *rest = line.split(" ")
                lines.append(first[head] + b"".join(map(later.__getitem__, rest)))
            return self.newline.join(lines)
        except _Odd:
            return self._library(text)


@lru_cache(maxsize=4)
def encoder(path: str) -> TextEncoder:
    return TextEncoder(path)
