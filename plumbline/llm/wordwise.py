"""Ids of a BPE tokenizer with word ends, encoded a distinct word at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from tokenizers import Tokenizer

_CACHED_WORDS = 300_000
_TEXTS_AT_ONCE = 128
#: Letters of Latin-1: NFC leaves them, and each has one lower-case letter in the same block.
_PLAIN = re.compile("([a-zß-öø-ÿ]+)([!-/:-@\\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordTokenizer:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit bytes.

    For tokenizers that lower-case, drop white space and never join ids across it, so
    that a text's ids are those of its words. Words of Latin letters, with or without
    punctuation behind, go straight to the BPE model; all others through the whole
    tokenizer. Texts that may hold a special token are encoded whole.
    """

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        for at in range(0, len(texts), _TEXTS_AT_ONCE):
            yield from self._encode(texts[at : at + _TEXTS_AT_ONCE])

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        split = [None if b"<|" in t else t.lower().split() for t in texts]
        if len(self.words) > _CACHED_WORDS:
            self.words.clear()
            self.parts.clear()
        for new in set().union(*(s for s in split if s)).difference(self.words):
            self.words[new] = self._word(new.decode())
        known = self.words.__getitem__
        return [b"".join(map(known, s)) if s is not None else self._all(t.decode()) for s, t in zip(split, texts)]

    def _word(self, word: str) -> bytes:
        match = _PLAIN.fullmatch(word.lower()) if word.isascii() or max(word) <= "ÿ" else None
        if not match or "'" in match[2]:
            return self._all(word)
        return self._part(match[1]) + (self._part(match[2]) if match[2] else b"")

    def _part(self, text: str) -> bytes:
        ids = self.parts.get(text)
        if ids is None:
            level = text.encode().decode("latin-1").translate(self.letters)
            ids = self.parts[text] = np.array([t.id for t in self.model.tokenize(level)], "<u4").tobytes()
        return ids

    def _all(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
