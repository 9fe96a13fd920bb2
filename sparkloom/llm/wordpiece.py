"""Encoding by a public word-level BPE of the tokenizers library, a distinct word at a time.

The vocabulary lower-cases, drops white space and never merges across it, so the ids of a text are those of its white-space
separated words in turn. A task keeps the ids of words that it has met (up to CACHE_BYTES); a text then costs a lookup a word.
"""

from __future__ import annotations

import sys
from array import array

from .common import caches

#: What the words that a task keeps may take, by about WORD_BYTES for each and its letters. A text that begins beyond it
#: lets the memory start anew: results do not change.
CACHE_BYTES, WORD_BYTES = 128 << 20, 200
#: ASCII punctuation without an apostrophe.
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
BIG_ENDIAN = sys.byteorder == "big"
_encoders: dict[str, "WordEncoder"] = {}


def _bytes(ids: list[int]) -> bytes:
    two = array("H", ids)
    if BIG_ENDIAN:
        two.byteswap()
    return two.tobytes()


def _forget() -> None:
    for e in _encoders.values():
        e.forget()


caches.append(_forget)


def encoder(path: str) -> "WordEncoder":
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class _Ids(dict):
    """Ids by word; make gives those of a word that is new."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.make(word)
        return ids


class WordEncoder:
    def __init__(self, path: str):
        import os
        import re

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        if self.size > 1 << 16:
            raise ValueError("ids are kept in two bytes")
        self.model, self.words = self.tokenizer.model, _Ids(self._word)
        # a stem is asked for once: the library's own memory of words would only take time
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)
        self.held = 0
        #: Letters of Latin-1 and then PUNCTUATION: such a word is at most two pre-tokens.
        self.plain = re.compile(r"([A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]*)([!-&(-/:-@\[-`{-~]*)").fullmatch
        # bytes as the library writes them: printable ones as themselves, others from U+0100 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}

    def forget(self) -> None:
        self.words.clear()
        self.held = 0

    def _word(self, word: str) -> bytes:
        """Of a word that is new: lower-case letters, or punctuation, are one pre-token; others are put together of those."""
        self.held += WORD_BYTES + 2 * len(word)
        if word.isascii():
            if word.isalpha():
                stem = word.lower()
            else:
                letters = word.rstrip(PUNCTUATION)
                if letters and not letters.isalpha() or "<|" in word:
                    return self._ids(word)
                if letters:
                    return self.words[letters.lower()] + self.words[word[len(letters) :]]
                stem = word
            if stem != word:
                return self.words[stem]
        else:
            m = self.plain(word)
            if not m or "<|" in word:
                return self._ids(word)
            if m[2]:
                return self.words[m[1].lower()] + self.words[m[2]]
            stem = word.lower()
            if stem != word:
                return self.words[stem]
            word = "".join(map(self.letters.__getitem__, word.encode()))
        return _bytes([t.id for t in self.model.tokenize(word)])

    def _ids(self, text: str) -> bytes:
        return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        """The ids of the whole text, two bytes each, the lower first."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to Python, not to the library
            return self._ids(text)
        if self.held > CACHE_BYTES:
            self.forget()
        return b"".join(map(self.words.__getitem__, text.split()))
