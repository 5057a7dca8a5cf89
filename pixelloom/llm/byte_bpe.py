"""Operator 2: byte-level BPE encoding and decoding.

Each match of the split pattern is merged on its own.  A segment tree over the byte positions of a word holds, at
every live position, the rank of the pair that starts there; its root is the leftmost pair of least rank.  A merge
touches three leaves (the merged pair, the one before and the one swallowed) and so costs three paths of log2(n)
nodes.  Words of similar length are merged side by side: one numpy step does one merge of every unfinished word.

Rows: null text counts as empty and gives no ids; repeated rows and doc_ids each give their own row; a null doc_id
stays null; extra columns are ignored; an empty table gives an empty table.  Map-only: nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pixelloom.llm import store
from pixelloom.llm.chunks import Bounded, chunk_text, chunks, parts

NONE = np.int64(1) << 60


class _Two(dict):
    """The cache, and what this slice alone has met."""

    def __init__(self, cache: dict, own: dict):
        super().__init__(own)
        self.cache = cache

    def __missing__(self, key: str) -> bytes:
        return self.cache[key]


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.token = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.token[r] = t
        self.decimal = [str(i) for i in range(len(self.token))]
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        pairs = {}
        for t, r in self.ranks.items():
            for cut in range(1, len(t)):
                a, b = self.ranks.get(t[:cut]), self.ranks.get(t[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = r
        # open addressing; a lookup probes until it meets the key or an empty slot
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.slot_key = np.full(1 << self.bits, -1, dtype=np.int64)
        self.slot_rank = np.full(1 << self.bits, NONE, dtype=np.int64)
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        values = np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))
        at = self._slot(keys)
        while len(keys):
            free = self.slot_key[at] == -1
            first = np.zeros(len(keys), dtype=bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.slot_key[at[put]], self.slot_rank[at[put]] = keys[put], values[put]
            keys, values, at = keys[~put], values[~put], (at[~put] + 1) & ((1 << self.bits) - 1)
        self.cache = Bounded(lambda k: self.words_ids([chunk_text(k)])[0], 64 << 20, 0)
        self.words = Bounded(lambda w: self.words_ids([w])[0], 80 << 20, 24 << 20)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 20 | b
        at = self._slot(keys)
        out = np.full(len(keys), NONE, dtype=np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            found = self.slot_key[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.slot_rank[at[hit]]
            on = ~hit & (found != -1)
            todo, at = todo[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def _merge(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids of words of 2..width bytes (width a power of two), by one segment tree a word, all in step."""
        n, size = len(words), np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        inside = np.arange(width)[None, :] < size[:, None]
        ids = np.full((n, width + 1), -1, dtype=np.int64)
        ids[:, :width][inside] = self.byte_id[flat]
        nxt = np.broadcast_to(np.arange(1, width + 2), (n, width + 1)).copy()
        prv = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
        tree = np.full((n, 2 * width), NONE, dtype=np.int64)
        pair = np.arange(width - 1)[None, :] < (size - 1)[:, None]
        rank = self.pair_rank(ids[:, : width - 1][pair], ids[:, 1:width][pair])
        r, c = np.nonzero(pair)
        tree[r, width + c] = np.where(rank == NONE, NONE, rank * width + c)
        level = width
        while level > 1:
            half = level >> 1
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        live = np.nonzero(tree[:, 1] < NONE)[0]
        while len(live):
            root = tree[live, 1]
            i = root % width
            j = nxt[live, i]
            k = nxt[live, j]
            p = prv[live, i]
            ids[live, i], ids[live, j] = root // width, -1
            nxt[live, i], prv[live, np.minimum(k, width)] = k, i
            before, after = p >= 0, k < size[live]
            # the pair that starts here, the one that starts before, the one swallowed
            here = np.full(len(live), NONE, dtype=np.int64)
            at = live[after]
            rank = self.pair_rank(ids[at, i[after]], ids[at, k[after]])
            here[after] = np.where(rank == NONE, NONE, rank * width + i[after])
            ahead = np.full(len(live), NONE, dtype=np.int64)
            at = live[before]
            rank = self.pair_rank(ids[at, p[before]], ids[at, i[before]])
            ahead[before] = np.where(rank == NONE, NONE, rank * width + p[before])
            rows = np.concatenate([live, live[before], live])
            node = np.concatenate([i, p[before], j]) + width
            tree[rows, node] = np.concatenate([here, ahead[before], np.full(len(live), NONE)])
            while node[0] > 1:
                node >>= 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            live = live[tree[live, 1] < NONE]
        kept = ids[:, :width]
        found, ends = kept[kept >= 0].astype("<u4").tobytes(), (4 * np.cumsum((kept >= 0).sum(axis=1))).tolist()
        return [found[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def words_ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes; equal words are merged once."""
        split = [parts(t) or self.pattern.findall(t) for t in texts]
        by_width: dict[int, list[str]] = {}
        done: dict[str, bytes] = {}
        for w in {w for words in split for w in words}:
            known = self.words.get(w) or self.words.young.get(w)
            if known is not None:
                done[w] = known
                continue
            raw = w.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                done[w] = rank.to_bytes(4, "little")
                self.words.store(w, done[w])
            else:
                by_width.setdefault(max(4, 1 << (len(raw) - 1).bit_length()), []).append(w)
        for width, words in by_width.items():
            step = max(1, (1 << 19) // width)
            for s in range(0, len(words), step):
                part = words[s : s + step]
                for w, ids in zip(part, self._merge([w.encode() for w in part], width), strict=True):
                    done[w] = ids
                    self.words.store(w, ids)
        return [b"".join([done[w] for w in words]) for words in split]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        keyed = [chunks(t) if t else [] for t in texts]
        fresh = list(self.cache.unknown(k for keys in keyed if keys for k in keys))
        known = dict(zip(fresh, self.words_ids([chunk_text(k) for k in fresh]), strict=True))
        for k in fresh:
            self.cache.store(k, known[k])
        known = {k: v for k, v in known.items() if k not in self.cache}
        look = _Two(self.cache, known).__getitem__ if known else self.cache.__getitem__
        return [self.words_ids([t])[0] if keys is None else b"".join(map(look, keys)) for t, keys in zip(texts, keyed, strict=True)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def codec(path: str, pattern: str) -> ByteBpe:
    return store.resident(f"byte codec {path} {pattern}", lambda: ByteBpe(path, pattern))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array<int>) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for rows, texts in store.slices(batches):
            found = [np.frombuffer(b, dtype="<u4").astype(np.int32) for b in bpe.encode_many(texts)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return store.texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, bytes of every row of ids; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for b in batches:
            found = [bpe.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], names=["doc_id", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, decode the ids again and return both digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for rows, texts in store.slices(batches):
            count, ids_sha, out_sha = [], [], []
            for b in bpe.encode_many(texts):
                ids = np.frombuffer(b, dtype="<u4").tolist()
                count.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
                out_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(count, pa.int64()), pa.array(ids_sha), pa.array(out_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return store.texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
