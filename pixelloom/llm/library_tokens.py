"""Ids by the tokenizers library, as little-endian uint32 bytes, one tokenizer a worker process."""

from __future__ import annotations

import os
from array import array

import numpy as np

from pixelloom.llm import store
from pixelloom.llm.chunks import MARKS, Bounded, chunk_text, chunks


#: Bytes of words and chunks whose ids a worker keeps.
CACHE_BYTES = 256 << 20


def _spelling() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


BYTE_SPELLING = _spelling()


class LibraryEncoder:
    """``ids(text)`` equals ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    A chunk goes through the library's own normalizer, pre-tokenizer and model, in that order; texts with unusual
    white space, and those that hold an added token's string (which the library maps to its id), go through ``encode``
    whole.
    """

    def __init__(self, path: str, cache: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.vocab_size = self.tok.get_vocab_size()
        self.normalizer, self.pre, self.model = self.tok.normalizer, self.tok.pre_tokenizer, self.tok.model
        self.marks = Bounded(self._word, 1 << 20, 1 << 20)
        self.cache = Bounded(self._key, cache * 3 // 4, cache // 4)

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        keys = None if any(t in text for t in self.added) else chunks(text)
        return self._whole(text) if keys is None else b"".join(map(self.cache.__getitem__, keys))

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """One pre-token, spelt as the byte-level pre-tokenizer does: a printable character for each UTF-8 byte."""
        spelt = word.encode().decode("latin-1").translate(BYTE_SPELLING)
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def _key(self, key: str) -> bytes:
        chunk = chunk_text(key)
        if self.normalizer is not None:  # drops white space and case
            chunk = chunk.lstrip(" \n").lower() if chunk.isascii() else self.normalizer.normalize_str(chunk).lstrip(" ")
        body = chunk.removeprefix(" ")
        word = body.rstrip(MARKS)
        if word.isalpha():
            marks = len(body) - len(word)
            return self._word(chunk[:-marks]) + self.marks[chunk[-marks:]] if marks else self._word(chunk)
        return b"".join(self._spelt(w) for w, _ in self.pre.pre_tokenize_str(chunk)) if chunk else b""

    def _spelt(self, spelt: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()


def encoder(path: str, cache: int = CACHE_BYTES) -> LibraryEncoder:
    return store.resident(f"library encoder {path} {cache}", lambda: LibraryEncoder(path, cache))
