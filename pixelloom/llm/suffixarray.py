"""Suffix arrays of batches of text, in a logarithmic family of levels.

A batch's array holds the starts of its suffixes in the order of their bytes, to a depth of ``LENGTH``: two suffixes
match in ``LENGTH`` bytes if and only if they are neighbours (or tied) in that order with equal bytes.  A new batch is
sorted, merge-scanned against every level, and then becomes a level itself; levels that are not larger than the new
one are merged into it, so there are never more levels than the logarithm of the number of suffixes.  Every comparison
is one of bytes; no hash takes part.
"""

from __future__ import annotations

import numpy as np

LENGTH = 50
#: Larger than every document's place in the order of doc_ids; that of a null doc_id as well.
LAST = np.int64((1 << 63) - 1)


def suffixes(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The first LENGTH bytes of the suffixes, as strings of fixed width, which numpy orders byte by byte."""
    if not len(starts):
        return np.zeros(0, dtype=f"S{LENGTH}")
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, LENGTH)[starts]).view(f"S{LENGTH}").ravel()


class Batch:
    """The suffix array of a batch; ``order`` is where a suffix's document stands in the order of doc_ids."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, order: np.ndarray):
        bytes_ = suffixes(text, starts)
        self.array = np.lexsort((order, bytes_)) if len(order) and (np.diff(order) < 0).any() else np.argsort(bytes_, kind="stable")
        bytes_ = bytes_[self.array]
        new = np.ones(len(bytes_), dtype=bool)
        new[1:] = bytes_[1:] != bytes_[:-1]
        self.of = np.cumsum(new) - 1  # which distinct suffix each place of the array holds
        self.bytes, self.least = bytes_[new], order[self.array][new]


class Family:
    """Levels of sorted distinct suffixes, each with the first document that has it."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def scan(self, batch: Batch) -> np.ndarray:
        """For every distinct suffix of the batch the first document in the levels that has it, LAST where none has."""
        found = np.full(len(batch.bytes), LAST)
        for bytes_, least in self.levels:
            at = np.minimum(np.searchsorted(bytes_, batch.bytes), len(bytes_) - 1)
            hit = bytes_[at] == batch.bytes
            found[hit] = np.minimum(found[hit], least[at[hit]])
        return found

    def add(self, bytes_: np.ndarray, least: np.ndarray) -> None:
        """Sorted distinct suffixes become a level, and take in every level that isn't larger."""
        while self.levels and len(self.levels[-1][0]) <= len(bytes_):
            b, d = self.levels.pop()
            if not len(bytes_):
                bytes_, least = b, d
                continue
            # each side's places in the merged order; what both have stands twice
            at = np.searchsorted(b, bytes_) + np.arange(len(bytes_))
            merged = np.empty(len(b) + len(bytes_), dtype=b.dtype)
            firsts = np.empty(len(merged), dtype=np.int64)
            mine = np.zeros(len(merged), dtype=bool)
            mine[at] = True
            merged[at], firsts[at] = bytes_, least
            merged[~mine], firsts[~mine] = b, d
            del b, d
            new = np.ones(len(merged), dtype=bool)
            new[1:] = merged[1:] != merged[:-1]
            bytes_, least = (merged, firsts) if new.all() else (merged[new], np.minimum.reduceat(firsts, np.nonzero(new)[0]))
        if len(bytes_):
            self.levels.append((bytes_, least))

    def earlier(self, batch: Batch, order: np.ndarray) -> np.ndarray:
        """Of each suffix of the batch: has a document that comes before its own the same LENGTH bytes?

        ``order`` is that of the suffixes as given to the batch.  Batches come in ascending order of documents, so what
        is in the levels or the batch is all that can come before.  The batch is added.
        """
        seen = self.scan(batch)
        least = np.minimum(seen, batch.least)
        out = np.zeros(len(batch.array), dtype=bool)
        out[batch.array] = least[batch.of] < order[batch.array]
        fresh = seen == LAST
        self.add(batch.bytes[fresh], batch.least[fresh])
        return out
