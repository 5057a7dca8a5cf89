"""Encoding by chunks: most of a text is words seen before, so chunks are encoded once and looked up after that.

A chunk is a run of non-space characters with the one white-space character before it.  Both families of pattern
used here start a new match at every single blank or newline that stands between two other characters, so encoding
chunk by chunk gives the ids of the whole text.  A text with any other white space is encoded whole by ``whole``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

def chunks(text: str) -> list[str] | None:
    """Keys of a text's chunks: the first is marked by NUL, newline chunks keep it, the others imply a blank.

    None where the text has white space other than single blanks and newlines between other characters.
    """
    if "\x00" in text:
        return None
    keys = text.split()
    lines = text.count("\n")
    # as many white-space characters as gaps between words, and all of them blanks and newlines
    if not keys or len(text) - sum(map(len, keys)) != len(keys) - 1 or text.count(" ") + lines != len(keys) - 1:
        return None
    if lines:
        keys = text.replace("\n", " \n").split(" ")
    keys[0] = "\x00" + keys[0]
    return keys


def chunk_text(key: str) -> str:
    return key[1:] if key[0] == "\x00" else key if key[0] == "\n" else " " + key


#: ASCII characters that are neither letters, digits nor white space.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def parts(chunk: str) -> list[str] | None:
    """Pattern matches of the commonest kind of chunk, a blank, letters and marks after them; None for any other."""
    lead = chunk[:1] == " "
    body = chunk[1:] if lead else chunk
    word = body.rstrip(MARKS)
    if not word.isalpha():  # exactly the letter categories
        return None
    first = " " + word if lead else word
    return [first] if len(word) == len(body) else [first, body[len(word) :]]


class Bounded(dict):
    """Key to bytes in bounded memory: the entries of the first ``frozen`` bytes stay, later ones go when they pass ``young`` bytes."""

    #: Of an entry beside its characters and bytes: two objects' heads and a place in the table.
    ENTRY = 180

    def __init__(self, make: Callable[[str], bytes], frozen: int, young: int):
        super().__init__()
        self.make, self.frozen, self.most, self.young = make, frozen, young, {}
        self.used = self.young_used = 0

    def __missing__(self, key: str) -> bytes:
        found = self.young.get(key)
        if found is None:
            self.store(key, found := self.make(key))
        return found

    def store(self, key: str, value: bytes) -> None:
        size = self.ENTRY + len(key) + len(value)
        if self.used + size <= self.frozen:
            self[key] = value
            self.used += size
        elif self.most:
            if self.young_used >= self.most:
                self.young.clear()
                self.young_used = 0
            self.young[key] = value
            self.young_used += size

    def unknown(self, keys: Iterable[str]) -> set[str]:
        return {k for k in keys if k not in self and k not in self.young}
