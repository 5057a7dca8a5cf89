"""Operator 10: lines that many documents share, by range partitioning and secondary sort.

Documents are written as block files; a row is known by its block and its place there.  Every row emits one record a
distinct line key: 128-bit hash, row, number of lines, packed positions.  Records are dealt by ranges of (key, row), so
that one very common line is spread over many tasks, and sorted inside each range by key, row and position.  A task
streams its records and settles every key that lies wholly inside it, holding back at most ``least`` records; its first
and last key may go on in the next range, so their records leave undecided with a partial count, and a table of at
most two counts a task settles them.  What comes out is a compressed bitmap a document of the lines that stay, not
text; texts are never shuffled, the bitmaps go to the blocks that hold them.

Every row is a document of its own, rows that share a doc_id included.  Null or empty text is one empty line, whose
key is empty and never dropped.  A null doc_id stays null.  Extra columns are ignored, or pass through where rows are
rewritten; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import store

BLANKS = b" \t\n\x0b\x0c\r"
RECORD = "key binary, blk long, row int, lines int, pos binary"
MARKED = f"kind int, {RECORD}, n long"
_MARKED = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("blk", pa.int64()), ("row", pa.int32()), ("lines", pa.int32()), ("pos", pa.binary()), ("n", pa.int64())])
_RECORD = pa.schema(list(_MARKED)[1:-1])
DECIDED, OPEN, COUNT = 0, 1, 2


def line_keys(text: bytes) -> list[bytes]:
    return [line.strip(BLANKS).lower() for line in text.split(b"\n")]


def _records(column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store.vacate()
        for b in batches:
            for block in b.to_pylist():
                rows: list[tuple] = []
                for i, text in enumerate(store.block_texts(store.read_block(block["path"]), column)):
                    at: dict[bytes, list[int]] = {}
                    keys = line_keys(text)
                    for line, key in enumerate(keys):
                        if key:
                            at.setdefault(key, []).append(line)
                    rows += [(xxhash.xxh3_128_digest(k), block["blk"], i, len(keys), np.array(p, dtype="<u4").tobytes()) for k, p in at.items()]
                    if len(rows) >= 20_000:
                        yield _batch(rows, _RECORD)
                        rows = []
                yield _batch(rows, _RECORD)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * len(schema), schema.types, strict=True)], schema=schema)


def _mark(least: int):
    """Stream sorted records: those of settled keys with enough documents, the open ones, and the open ones' counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind: int, rows: list[tuple], n: int | None = None) -> pa.RecordBatch:
            return _batch([(kind, *row, n) for row in rows], _MARKED)

        key, held, count, first = None, [], 0, True
        for b in batches:
            decided: list[tuple] = []
            opened: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] != key:
                    if key is not None and first:
                        opened += held
                        yield out(COUNT, [(key, None, None, None, None)], count)
                        first = False
                    key, held, count = row[0], [], 0
                count += 1
                if first:
                    opened.append(row)
                elif count < least:
                    held.append(row)
                else:
                    decided += [*held, row]
                    held = []
            yield out(DECIDED, decided)
            yield out(OPEN, opened)
        if key is not None:
            # the last key may go on: what it already sent is right if it is common, and what it holds stays open
            yield out(OPEN, held)
            yield out(COUNT, [(key, None, None, None, None)], count)

    return run


def dropped_lines(blocks: DataFrame, column: int, least: int = 10) -> DataFrame:
    """(blk, row, lines, pos): packed positions of the lines whose key at least ``least`` rows hold."""
    # written once: dealing by range reads its input twice
    lines = store.staged(store.dealt(blocks).mapInArrow(_records(column), RECORD), "line-records")
    ordered = lines.repartitionByRange("key", "blk", "row").sortWithinPartitions("key", "blk", "row", "pos")
    marked = store.staged(ordered.mapInArrow(_mark(least), MARKED), "line-marks")
    # two keys a task at most, so the table of totals is bounded by the number of tasks
    totals = marked.filter(F.col("kind") == COUNT).groupBy("key").agg(F.sum("n").alias("total")).filter(F.col("total") >= least)
    settled = marked.filter(F.col("kind") == DECIDED).select("blk", "row", "lines", "pos")
    late = marked.filter(F.col("kind") == OPEN).join(F.broadcast(totals.select("key")), "key", "left_semi")
    return settled.unionByName(late.select("blk", "row", "lines", "pos"))


def keep_bitmap(n_lines: int, dropped: list[bytes]) -> bytes:
    """Deflated bitmap, bit i of byte i div 8 for line i, 1 where the line stays."""
    keep = np.ones(n_lines, dtype=np.uint8)
    for p in dropped:
        keep[np.frombuffer(p, dtype="<u4")] = 0
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 1)


def kept_flags(n_lines: int, bitmap: bytes | None) -> np.ndarray:
    """One flag a line; without a bitmap every line stays."""
    if bitmap is None:
        return np.ones(n_lines, dtype=np.uint8)
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[:n_lines]


def kept_lines(text: bytes, bitmap: bytes | None) -> list[bytes]:
    lines = text.split(b"\n")
    if bitmap is None:
        return lines
    return [line for line, k in zip(lines, kept_flags(len(lines), bitmap).tolist(), strict=True) if k]


def keep_runs(n_lines: int, bitmap: bytes | None) -> str:
    """Lengths of the runs of lines that stay and go by turns; the first is of lines that stay."""
    flags = kept_flags(n_lines, bitmap)
    turns = np.nonzero(np.diff(flags, prepend=np.uint8(1)))[0]
    return ",".join(map(str, np.diff(np.concatenate([[0], turns, [n_lines]])).tolist()))


def _bitmaps(table: pa.Table) -> pa.Table:
    """The bitmaps of one block's rows that lose lines: at most as many positions as the block has lines."""
    own: dict[int, tuple[int, list[bytes]]] = {}
    for row, n, pos in zip(*(table.column(c).to_pylist() for c in ("row", "lines", "pos")), strict=True):
        own.setdefault(row, (n, []))[1].append(pos)
    rows = sorted(own)
    maps = pa.array([[keep_bitmap(*own[r]) for r in rows]], pa.list_(pa.binary()))
    return pa.table({"blk": table.column("blk").slice(0, 1), "rows": pa.array([rows], pa.list_(pa.int32())), "keep": maps})


def _with_bitmaps(docs: DataFrame, column: int, least: int) -> DataFrame:
    """The block table with the rows of each that lose lines, and their bitmaps."""
    blocks = store.blocks(docs, "line-blocks", docs.columns[column])
    maps = dropped_lines(blocks, column, least).groupBy("blk").applyInArrow(_bitmaps, "blk long, rows array<int>, keep array<binary>")
    return store.dealt(store.staged(blocks.join(maps, "blk", "left"), "line-bitmaps"))


def _keep_of(block: dict, n: int) -> list[bytes | None]:
    out: list[bytes | None] = [None] * n
    for row, keep in zip(block["rows"] or [], block["keep"] or [], strict=True):
        out[row] = keep
    return out


def line_bitmaps(docs: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, n_lines and ``keep`` (see ``keep_bitmap``) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in b.to_pylist():
                table = store.read_block(block["path"])
                n = [t.count(b"\n") + 1 for t in store.block_texts(table, 1)]
                keep = [k or keep_bitmap(size, []) for size, k in zip(n, _keep_of(block, len(n)), strict=True)]
                yield pa.RecordBatch.from_arrays([table.column(0).combine_chunks(), pa.array(n, pa.int32()), pa.array(keep, pa.binary())], names=["doc_id", "n_lines", "keep"])

    return _with_bitmaps(store.texts(docs), 1, least).mapInArrow(run, "doc_id long, n_lines int, keep binary")


def without_common_lines(docs: DataFrame, least: int = 10, text: str = "text") -> DataFrame:
    """The rows, all columns as they are, but for the common lines of the text; a text that loses none stays as it is, null too."""
    column = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in b.to_pylist():
                table = store.read_block(block["path"])
                old = table.column(column).to_pylist()
                keep = _keep_of(block, table.num_rows)
                new = (t if k is None else b"\n".join(kept_lines(t.encode(), k)).decode() for t, k in zip(old, keep, strict=True))
                yield from store.with_text(table, column, new)

    return _with_bitmaps(docs, column, least).mapInArrow(run, docs.schema)


def digests(docs: DataFrame, least: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 and keep_runs of every document, by its bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in b.to_pylist():
                table = store.read_block(block["path"])
                texts = store.block_texts(table, 1)
                keep = _keep_of(block, len(texts))
                n_lines, n_dropped, sha, runs = [], [], [], []
                for raw, bitmap in zip(texts, keep, strict=True):
                    kept = kept_lines(raw, bitmap)
                    n = raw.count(b"\n") + 1
                    n_lines.append(n)
                    n_dropped.append(n - len(kept))
                    sha.append(hashlib.sha256(b"\n".join(kept)).hexdigest())
                    runs.append(str(n) if bitmap is None else keep_runs(n, bitmap))
                yield pa.RecordBatch.from_arrays(
                    [table.column(0).combine_chunks(), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sha), pa.array(runs)],
                    names=["doc_id", "n_lines", "n_dropped", "kept_sha256", "keep_runs"],
                )

    return _with_bitmaps(store.texts(docs), 1, least).mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string, keep_runs string")
