"""Operator 1: removal of long repeated passages with logarithmic families of suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller doc_id.  Texts are
first written as block files in shared storage, and no text is shuffled but what may repeat.  Two rounds:

1. filter: of each window of ``LENGTH`` bytes the ``GRAM``-byte string of least hash (its anchor) is taken; two equal
   windows always have equal anchors.  Blocks send 32 bits of every distinct anchor to the partition of its hash and get
   one bit back: may another document have it?  Equal hashes of different anchors only let more through.
2. match: the suffixes that start in windows of a repeated anchor go, as bytes, to the partition of the anchor: the
   consecutive windows that share one anchor as one string of at most ``2 * LENGTH - GRAM`` bytes, equal strings of a block
   once with their least doc_id.  The partition feeds them in batches, ascending by doc_id, to a logarithmic family of
   suffix arrays (``suffixarray``): a batch gets its array, is merge-scanned against the levels, and equal-sized levels
   merge.  One bit a suffix goes back.  An anchor with more than ``HEAVY`` different strings would fill a partition,
   so its windows are dealt one by one by their own hash.

Hashes only choose partitions and let suffixes through the filter; every match is one of bytes.  Texts that are equal
as a whole are told by SHA-256.  The number of partitions grows with the bytes (``PARTITION`` each), so the memory of a
task does not grow with the input; exchanges go through ``mail``, so their rows grow with the bytes as well, not with
blocks times partitions.

Rows: null text counts as empty; a null doc_id counts as larger than any other; rows that share a doc_id remove
nothing from each other; of two equal texts the one with the larger doc_id goes whole if it has ``LENGTH`` bytes;
extra columns are ignored, or pass through where rows are rewritten; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import mail, store
from pixelloom.llm.suffixarray import LAST, LENGTH, Batch, Family

GRAM, HEAVY = 24, 2048
#: Bytes of text that numpy handles at once; bytes of all texts a partition; suffixes of a batch.
PIECE, PARTITION, BATCH = 1 << 16, 2 << 20, 1 << 17
#: Pieces whose windows are looked at together.
CHUNK = 1 << 15
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(29))


def _words(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one integer, by doubling."""
    a = buf.astype(_U)
    for n in (1, 2, 4):
        a = a[:-n] | (a[n:] << _U(8 * n))
    return a


def _hash(w: np.ndarray, at: np.ndarray | slice, length: int) -> np.ndarray:
    """Hashes of the ``length`` bytes from each position of the words."""
    offsets = [*range(0, length - 8, 8), length - 8]
    if isinstance(at, slice):
        parts = [w[off : off + at.stop] for off in offsets]
    else:
        parts = [w[at + off] for off in offsets]
    out = parts[0] * _U(0x9E3779B97F4A7C15)
    for i, p in enumerate(parts[1:], start=1):
        out ^= out >> _U(32)
        out *= _U(0xD6E8FEB86659FD93 + 2 * i)
        out += p
    return _mix(out * _U(0x94D049BB133111EB))


class Runs:
    """Runs of windows of a block that share one anchor occurrence: h (its hash), r (hash of the run), doc, first and last start."""

    def __init__(self, texts: list[bytes], skip: np.ndarray):
        found: list[tuple[np.ndarray, ...]] = []
        buf: list[bytes] = []
        docs: list[tuple[int, int]] = []
        size = 0
        for d, text in enumerate(texts):
            if skip[d] or len(text) < LENGTH:
                continue
            for start in range(0, len(text) - LENGTH + 1, PIECE):
                part = text[start : start + PIECE + LENGTH - 1]
                buf.append(part)
                docs.append((d, start))
                size += len(part)
                if size >= PIECE:
                    found.append(self._runs(buf, docs))
                    buf, docs, size = [], [], 0
        if buf:
            found.append(self._runs(buf, docs))
        kinds = (np.uint64, np.uint64, np.int32, np.int32, np.int32)
        columns = list(zip(*found, strict=True)) if found else [()] * 5
        self.h, self.r, self.doc, self.first, self.last = (np.concatenate(c).astype(k) if c else np.zeros(0, k) for c, k in zip(columns, kinds, strict=True))

    @staticmethod
    def _runs(parts: list[bytes], docs: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
        sizes = np.array([len(p) for p in parts])
        begins = np.cumsum(sizes) - sizes
        w = _words(np.frombuffer(b"".join(parts), dtype=np.uint8))
        gram = _hash(w, slice(len(w) - (GRAM - 8)), GRAM)
        # the least hash in reach of each window, with its place in the low bits
        m = (gram & ~_U((1 << 24) - 1)) | np.arange(len(gram), dtype=_U)
        span, reach = LENGTH - GRAM + 1, 1
        while 2 * reach <= span:
            m = np.minimum(m[:-reach], m[reach:])
            reach *= 2
        if span > reach:
            m = np.minimum(m[: -(span - reach)], m[span - reach :])
        anchor = (m & _U((1 << 24) - 1)).astype(np.int64)
        part = np.repeat(np.arange(len(parts)), sizes)[: len(anchor)]
        valid = np.arange(len(anchor)) <= (begins + sizes - LENGTH)[part]
        new = np.ones(len(anchor), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])
        starts = np.nonzero(new & valid)[0]
        end = np.ones(len(anchor), dtype=bool)
        end[:-1] = new[1:] | ~valid[1:]
        ends = np.nonzero(end & valid)[0]
        run = _mix(_hash(w, starts, LENGTH) * _U(3) + _hash(w, ends, LENGTH) + (ends - starts).astype(_U))
        which = part[starts]
        doc, origin = np.array([d for d, _ in docs]), np.array([s for _, s in docs]) - begins
        return gram[anchor[starts]], run, doc[which], starts + origin[which], ends + origin[which]


def _parts(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((_mix(keys * _U(0xC2B2AE3D27D4EB4F)) >> _U(24)) % _U(parts)).astype(np.int64)


def _ranges(parts: np.ndarray) -> dict[int, tuple[int, int]]:
    """Begin and end of each number in a sorted array."""
    cuts = np.concatenate([[0], np.nonzero(np.diff(parts))[0] + 1, [len(parts)]])
    return {int(parts[a]): (a, z) for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if z > a}


def _bits(replies: list[bytes] | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Partition, yes bits and crowded bits of the messages that came back."""
    for parcel in replies or []:
        for p, body in mail.frames(parcel):
            n = int.from_bytes(body[:4], "little")
            yield p, np.unpackbits(np.frombuffer(body, np.uint8, count=n, offset=4)), np.unpackbits(np.frombuffer(body, np.uint8, offset=4 + n))


def _reply(yes: np.ndarray, crowded: np.ndarray | None = None) -> bytes:
    bits = np.packbits(yes).tobytes()
    return len(bits).to_bytes(4, "little") + bits + (np.packbits(crowded).tobytes() if crowded is not None and crowded.any() else b"")


class Work:
    """A block with the replies of the rounds so far."""

    def __init__(self, row: dict, column: int, id_column: int, parts: int):
        store.vacate()
        self.table, self.column, self.parts = store.read_block(row["path"]), column, parts
        self.ids = self.table.column(id_column).cast(pa.int64())
        self.order = self.ids.fill_null(int(LAST)).to_numpy().astype(np.int64)
        self.texts = store.block_texts(self.table, column)
        self.copy = np.zeros(len(self.texts), dtype=bool)
        self.copy[np.array(row["copies"] or [], dtype=np.int64)] = True
        self.runs = Runs(self.texts, self.copy)
        self._anchors()

    def _anchors(self) -> None:
        """The distinct anchors by partition: 32 bits each, kinds of runs (to 127), and whether two documents here have it."""
        runs = self.runs
        keys, at = np.unique(runs.h, return_inverse=True)
        kinds = np.bincount(at[np.unique(_mix(runs.h ^ (runs.r * _U(0x9E3779B97F4A7C15))), return_index=True)[1]], minlength=len(keys))
        low, high = np.full(len(keys), LAST), np.full(len(keys), np.int64(-1))
        np.minimum.at(low, at, runs.doc)
        np.maximum.at(high, at, runs.doc)
        p = _parts(keys, self.parts)
        by = np.argsort(p, kind="stable")
        place = np.empty(len(keys), np.int64)
        place[by] = np.arange(len(by))
        self.anchor_at, self.ranges = place[at], _ranges(p[by])
        self.sent_keys = (keys[by] & _U(0xFFFFFFFF)).astype(np.uint32)
        self.sent_kinds = (np.minimum(kinds, 127) | ((low != high) << 7)).astype(np.uint8)[by]

    def anchor_rows(self) -> Iterator[tuple[int, bytes]]:
        for p, (a, z) in self.ranges.items():
            yield p, self.sent_keys[a:z].tobytes() + self.sent_kinds[a:z].tobytes()

    def match(self, replies: list[bytes] | None) -> Pieces:
        yes, crowded = np.zeros(len(self.sent_keys), dtype=bool), np.zeros(len(self.sent_keys), dtype=bool)
        for p, y, c in _bits(replies):
            a, z = self.ranges[p]
            yes[a:z] = y[: z - a]
            if len(c):
                crowded[a:z] = c[: z - a]
        live = yes[self.anchor_at]
        one = live & crowded[self.anchor_at]
        return Pieces(self, np.nonzero(live & ~one)[0], np.nonzero(one)[0])


class Pieces:
    """What a block sends to the second round: distinct strings by partition, each with its least document."""

    def __init__(self, work: Work, whole: np.ndarray, single: np.ndarray):
        runs, texts = work.runs, work.texts
        n = (runs.last - runs.first + 1)[single]
        at = np.repeat(runs.first[single] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        doc = np.concatenate([runs.doc[whole], np.repeat(runs.doc[single], n)])
        start = np.concatenate([runs.first[whole], at]).astype(np.int64)
        size = np.concatenate([(runs.last - runs.first + LENGTH)[whole], np.full(len(at), LENGTH)]).astype(np.int64)
        part = _parts(np.concatenate([runs.h[whole], _window_hash(texts, doc[len(whole) :], at)]), work.parts)
        by = np.argsort(part, kind="stable")
        self.work, self.doc, self.start, self.size = work, doc[by].astype(np.int32), start[by].astype(np.int32), size[by].astype(np.uint8)
        self.of = np.zeros(len(by), dtype=np.int32)
        first = [np.zeros(0, np.int64)]  # of each distinct string, the first piece that is it
        self.ranges: dict[int, tuple[int, int]] = {}  # of distinct strings, by partition
        count = 0
        for p, (a, z) in _ranges(part[by]).items():
            known: dict[bytes, int] = {}  # equal strings have equal anchors, so they are in one partition
            own = np.fromiter((known.setdefault(raw, len(known)) for raw in self._strings(range(a, z))), np.int32, z - a)
            first.append(a + np.unique(own, return_index=True)[1])
            self.of[a:z] = own + count
            self.ranges[p] = (count, count + len(known))
            count += len(known)
        self.first = np.concatenate(first)
        self.least = np.full(len(self.first), LAST)
        np.minimum.at(self.least, self.of, work.order[self.doc])
        self.suffixes = np.concatenate([[0], np.cumsum(self.size[self.first].astype(np.int64) - (LENGTH - 1))])

    def _strings(self, pieces: range | np.ndarray) -> Iterator[bytes]:
        texts = self.work.texts
        own = slice(pieces.start, pieces.stop) if isinstance(pieces, range) else pieces
        for d, s, n in zip(self.doc[own].tolist(), self.start[own].tolist(), self.size[own].tolist(), strict=True):
            yield texts[d][s : s + n]

    def rows(self) -> Iterator[tuple[int, bytes]]:
        pack = zstandard.ZstdCompressor(level=1)
        for p, (a, z) in self.ranges.items():
            own = self.first[a:z]
            yield p, int(z - a).to_bytes(4, "little") + pack.compress(self.least[a:z].tobytes() + self.size[own].tobytes() + b"".join(self._strings(own)))

    def covered(self, replies: list[bytes] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, start and end of what goes: all runs of windows that an earlier document has."""
        yes = np.zeros(self.suffixes[-1], dtype=bool)
        for p, y, _ in _bits(replies):
            a, z = (self.suffixes[i] for i in self.ranges[p])
            yes[a:z] = y[: z - a]
        later = self.work.order[self.doc] > self.least[self.of]
        out = [(self.doc[later], self.start[later].astype(np.int64), self.start[later] + self.size[later].astype(np.int64))]
        asked = np.nonzero(~later)[0]
        for own in np.split(asked, range(CHUNK, len(asked), CHUNK)):  # a row for each window, but of some pieces at a time
            n = (self.suffixes[1:] - self.suffixes[:-1])[self.of[own]]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hit = yes[np.repeat(self.suffixes[self.of[own]], n) + at]
            inner = at > 0  # the window before is one of the same piece
            begins, ends = hit.copy(), hit.copy()
            begins[1:] &= ~(hit[:-1] & inner[1:])
            ends[:-1] &= ~(hit[1:] & inner[1:])
            place = np.repeat(self.start[own].astype(np.int64), n) + at
            out.append((np.repeat(self.doc[own], n)[begins], place[begins], place[ends] + LENGTH))
        doc, start, end = (np.concatenate(c) for c in zip(*out, strict=True))
        return doc, start, end


def _window_hash(texts: list[bytes], doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the window at each place; places of one document follow each other."""
    out = np.zeros(len(doc), _U)
    cuts = np.nonzero(np.diff(doc))[0] + 1
    for own in np.split(np.arange(len(doc)), cuts) if len(doc) else []:
        for piece in np.split(own, range(4096, len(own), 4096)):
            low, high = int(at[piece].min()), int(at[piece].max()) + LENGTH
            out[piece] = _hash(_words(np.frombuffer(texts[int(doc[piece[0]])], np.uint8)[low:high]), at[piece] - low, LENGTH)
    return out


def _filter(messages: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """First round: the anchors of one partition that two documents may have, and those with very many runs."""
    keys = [np.frombuffer(b, np.uint32, count=len(b) // 5) for _, b in messages]
    kinds = [np.frombuffer(b, np.uint8, offset=4 * k.size) for (_, b), k in zip(messages, keys, strict=True)]
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    every = np.concatenate(kinds).astype(np.int64)
    yes = (np.bincount(at, weights=1 + (every >> 7)) >= 2)[at]
    crowded = (np.bincount(at, weights=every & 127) > HEAVY)[at]
    end = 0
    for (blk, _), k in zip(messages, keys, strict=True):
        begin, end = end, end + k.size
        if yes[begin:end].any():
            yield blk, _reply(yes[begin:end], crowded[begin:end])


def _match(messages: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """Second round: which suffixes of one partition an earlier document has, by one family of suffix arrays."""
    unpack = zstandard.ZstdDecompressor()
    least, sizes, raw = [], [], []
    for _, body in messages:
        n, plain = int.from_bytes(body[:4], "little"), unpack.decompress(body[4:])
        least.append(np.frombuffer(plain, np.int64, count=n))
        sizes.append(np.frombuffer(plain, np.uint8, count=n, offset=8 * n).astype(np.int64))
        raw.append(plain[9 * n :])
    text = np.frombuffer(b"".join(raw), np.uint8)
    del raw
    counts = [int((s - (LENGTH - 1)).sum()) for s in sizes]
    order, size = np.concatenate(least), np.concatenate(sizes)
    n = size - (LENGTH - 1)
    begin, first = np.cumsum(size) - size, np.cumsum(n) - n
    yes = np.zeros(int(n.sum()), dtype=bool)
    family = Family()
    by = np.argsort(order, kind="stable")
    cuts = np.searchsorted(np.cumsum(n[by]), np.arange(BATCH, int(n.sum()), BATCH))
    for own in np.split(by, cuts):
        if len(own):
            step = np.arange(n[own].sum()) - np.repeat(np.cumsum(n[own]) - n[own], n[own])
            whose = np.repeat(order[own], n[own])
            yes[np.repeat(first[own], n[own]) + step] = family.earlier(Batch(text, np.repeat(begin[own], n[own]) + step, whose), whose)
    end = 0
    for (blk, _), c in zip(messages, counts, strict=True):
        start, end = end, end + c
        if yes[start:end].any():
            yield blk, _reply(yes[start:end])


Messages = Iterator[tuple[int, bytes]]


class Removals:
    """The documents as block files, and the answers of both rounds."""

    def __init__(self, docs: DataFrame, text: str = "text", key: str = "doc_id"):
        self.schema = docs.schema
        self.column, self.key = docs.columns.index(text), docs.columns.index(key)
        blocks = self._copies(store.blocks(docs, "suffix-blocks", text))
        wanted = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        size, self.count = blocks.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
        self.parts = max(2 * wanted, size // PARTITION)
        one = self._ask(blocks, "r1", lambda w, row: w.anchor_rows(), _filter)
        self.blocks = self._ask(one, "r2", lambda w, row: w.match(row["r1"]).rows(), _match)

    def _copies(self, blocks: DataFrame) -> DataFrame:
        """The block table with the rows of each that repeat the whole text of a document with a smaller doc_id."""
        column, key = self.column, self.key

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    table = store.read_block(row["path"])
                    texts = store.block_texts(table, column)
                    ids = table.column(key).cast(pa.int64()).fill_null(int(LAST)).combine_chunks()
                    long = [i for i, t in enumerate(texts) if len(t) >= LENGTH]
                    digest = [hashlib.sha256(texts[i]).digest() for i in long]
                    at = pa.array(long, pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array([row["blk"]] * len(long), pa.int64()), at, ids.take(at), pa.array(digest, pa.binary())], names=["blk", "row", "place", "h"])

        meta = store.staged(store.dealt(blocks).mapInArrow(run, "blk long, row int, place long, h binary"), "suffix-meta")
        first = meta.groupBy("h").agg(F.min("place").alias("least"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("h", "least")
        first = store.staged(first, "suffix-copies")  # written, so that the join can split a text that very many rows have
        copies = meta.join(first, "h").filter("place > least").groupBy("blk").agg(F.collect_list("row").alias("copies"))
        return store.staged(blocks.join(copies, "blk", "left"), "suffix-table")

    def _ask(self, blocks: DataFrame, name: str, rows_of: Callable[[Work, dict], Messages], answer: Callable[[list[tuple[int, bytes]]], Messages]) -> DataFrame:
        """One round: blocks write to partitions, partitions answer, and the answers join the block table."""
        work, parts, count = self._work(), self.parts, self.count

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    yield from mail.post(row["blk"], rows_of(work(row), row), parts)

        def resolve(table: pa.Table) -> pa.Table:
            store.vacate()
            messages = sorted(m for parcel in table.column("parcel").to_pylist() for m in mail.frames(parcel))
            return pa.Table.from_batches(mail.post(table.column("to")[0].as_py(), answer(messages), count))

        asked = mail.deliver(store.dealt(blocks).mapInArrow(send, mail.POSTED), parts)
        replies = mail.deliver(asked.groupBy("to").applyInArrow(resolve, mail.POSTED), count)
        grouped = replies.groupBy(F.col("to").alias("blk")).agg(F.collect_list("parcel").alias(name))
        # Spark takes the answers for as small as the block table that they come from, and would broadcast them all by way of the driver
        return store.staged(blocks.join(grouped.hint("merge"), "blk", "left"), f"suffix-{name}")

    def _work(self) -> Callable[[dict], Work]:
        column, key, parts = self.column, self.key, self.parts
        return lambda row: Work(row, column, key, parts)

    def each(self, rows_of: Callable[[Work, list[tuple[np.ndarray, np.ndarray]]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
        """The rows that ``rows_of`` makes of each block and its removed spans."""
        work = self._work()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    own = work(row)
                    yield from rows_of(own, _spans(own, row))

        return store.dealt(self.blocks).mapInArrow(run, schema)


def _spans(work: Work, row: dict) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each document of the block the starts and ends of its maximal removed runs of bytes."""
    doc, start, end = work.match(row["r1"]).covered(row["r2"])
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    cuts = np.searchsorted(doc, np.arange(len(work.texts) + 1))
    out = []
    for d, text in enumerate(work.texts):
        s, e = start[cuts[d] : cuts[d + 1]], end[cuts[d] : cuts[d + 1]]
        if work.copy[d]:
            s, e = np.array([0]), np.array([len(text)])
        elif len(s):
            e = np.maximum.accumulate(e)
            new = np.concatenate([[True], s[1:] > e[:-1]])
            s, e = s[new], e[np.concatenate([np.nonzero(new)[0][1:] - 1, [len(e) - 1]])]
        out.append((s, e))
    return out


def _kept(text: bytes, s: np.ndarray, e: np.ndarray) -> bytes:
    bounds = [0, *(int(x) for pair in zip(s, e, strict=True) for x in pair), len(text)]
    return b"".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True))


def rewritten(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows, all columns as they are, with the removed runs cut out of the text; a character of which a part is cut goes whole.

    Every row is one of its own, rows that share a doc_id included.  A null text stays null.
    """

    def rows_of(work: Work, spans: list) -> Iterator[pa.RecordBatch]:
        old = work.table.column(work.column).to_pylist()
        new = (t if not len(s) else _kept(raw, s, e).decode("utf-8", "ignore") for t, raw, (s, e) in zip(old, work.texts, spans, strict=True))
        yield from store.with_text(work.table, work.column, new)

    found = Removals(docs, text)
    return found.each(rows_of, docs.schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, starts, ends (maximal removed runs of bytes), kept (the remaining bytes) of every document."""

    def rows_of(work: Work, spans: list) -> Iterator[pa.RecordBatch]:
        ids, size, begin = work.ids.combine_chunks(), 0, 0
        for i, t in enumerate(work.texts):
            size += len(t)
            if size >= store.SLICE_BYTES or i + 1 == len(work.texts):
                texts, own = work.texts[begin : i + 1], spans[begin : i + 1]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": ids.slice(begin, len(texts)),
                        "n_bytes": pa.array(map(len, texts), pa.int64()),
                        "starts": pa.array([s for s, _ in own], pa.list_(pa.int64())),
                        "ends": pa.array([e for _, e in own], pa.list_(pa.int64())),
                        "kept": pa.array([_kept(x, s, e) for x, (s, e) in zip(texts, own, strict=True)], pa.binary()),
                    }
                )
                size, begin = 0, i + 1

    found = Removals(store.texts(docs))
    return found.each(rows_of, "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""

    def rows_of(work: Work, spans: list) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": work.ids.combine_chunks(),
                "n_bytes": pa.array(map(len, work.texts), pa.int64()),
                "n_removed": pa.array([int((e - s).sum()) for s, e in spans], pa.int64()),
                "n_spans": pa.array([len(s) for s, _ in spans], pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(_kept(t, s, e)).hexdigest() for t, (s, e) in zip(work.texts, spans, strict=True)]),
            }
        )

    found = Removals(store.texts(docs))
    return found.each(rows_of, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
